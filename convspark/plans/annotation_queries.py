"""Keys, time codes, checks, annotation merge and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark.functions import keys as K
from convspark.functions.vocab import LABELS, MODEL_IDS
from convspark.operators import agreement as G
from convspark.operators import annotation as A
from convspark.operators import corpus
from convspark.operators import quality as Q
from convspark.plans.fixtures import fixture, sheets, with_sql
from convspark.plans.registry import query
from convspark.sources.checkpoints import cut

ANN, CONV = with_sql("ann"), with_sql("conv")
STRIPPED = "string_split(replace({}, ' ', ''), ',')"
MAP_IDS = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in MODEL_IDS.items()) + "}"
SPELLINGS = {"Happy": "Happiness", "Sad": "Sadness"}


def ann(spark, d):
    return fixture(spark, d, "ann")


def filled(spark, d):
    return A.fill_labels_forward(A.sheet_labels(sheets(ann(spark, d))))


def aligned(spark, d):
    """p1, p2, p3 of the wide fixture, filled in one window pass."""
    w = ann(spark, d)
    for k in (1, 2, 3):
        w = w.withColumn(f"p{k}", F.last(K.parse_labels(F.col(f"l{k}")), ignorenulls=True).over(A.in_dialog()))
    return w


def voted(spark, d):
    return A.vote_labels(aligned(spark, d))


def select(name, sql, source="ann", **columns):
    """A query of scalar functions over a fixture, with the same in SQL."""

    @query(name, with_sql(source) + " " + sql)
    def run(spark, d):
        made = {c: f() for c, f in columns.items()}
        return fixture(spark, d, source).select(*[v.alias(c) for c, v in made.items()])


c = F.col
select("K1_dialog_id", "SELECT utt_id, string_split(utt_id, '_')[1] || '_' || string_split(utt_id, '_')[2] AS dialog FROM ann", utt_id=lambda: c("utt_id"), dialog=lambda: K.dialog_id(c("utt_id")))
select("K2_utt_key", "SELECT speaker || '_' || utt_id AS k, string_split(utt_id, '_')[1] AS movie FROM ann", k=lambda: K.utt_key(c("speaker"), c("utt_id")), movie=lambda: K.movie_of(K.utt_key(c("speaker"), c("utt_id"))))
_FACE = "speaker || '_' || utt_id || '_' || CAST(f0 AS STRING) || '_' || CAST(pos % 3 AS STRING)"
select("K3_parse_face_name", f"SELECT split_part({_FACE}, '_', 1) AS speaker, split_part({_FACE}, '_', 3) AS dialog, CAST(split_part({_FACE}, '_', 5) AS INT) AS frame, CAST(split_part({_FACE}, '_', 6) AS INT) AS face FROM ann", **{f: (lambda f=f: K.parse_face_name(F.expr(_FACE))[f]) for f in ("speaker", "dialog", "frame", "face")})
select("K5_clean_text", "SELECT utt_id, translate(text, ',.?!() ', '，。？！（），') AS t FROM ann", utt_id=lambda: c("utt_id"), t=lambda: K.clean_text(c("text")))
select("K6_norm_speaker", "SELECT pos, replace(' ' || speaker || ' x', ' ', '') AS s FROM conv", source="conv", pos=lambda: c("pos"), s=lambda: K.norm_speaker(F.expr("' ' || speaker || ' x'")))


@query("K7_parse_labels", f"{ANN} SELECT utt_id, array_to_string(list_transform({STRIPPED.format('l1')}, lambda x: CASE x WHEN 'Happy' THEN 'Happiness' WHEN 'Sad' THEN 'Sadness' ELSE x END), '|') AS labels, len(list_filter(list_transform({STRIPPED.format('l1')}, lambda x: CASE x WHEN 'Happy' THEN 'Happiness' WHEN 'Sad' THEN 'Sadness' ELSE x END), lambda x: x NOT IN ('Neutral','Anger','Disgust','Fear','Surprise','Other'))) AS unknown FROM ann WHERE l1 IS NOT NULL")
def k7(spark, d):
    labels = K.parse_labels(c("l1"), SPELLINGS)
    return ann(spark, d).filter("l1 IS NOT NULL").select("utt_id", F.array_join(labels, "|").alias("labels"), F.size(K.unknown_labels(labels)).cast("long").alias("unknown"))


@query("K4_drop_blank_rows", f"{ANN} SELECT a.utt_id, b.utt_id IS NOT NULL AS before_blank FROM ann a LEFT JOIN (SELECT utt_id FROM (SELECT utt_id, sum(CASE WHEN l1 IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY dialog_id ORDER BY pos) AS blanks FROM ann) WHERE blanks = 0) b USING (utt_id) WHERE a.l1 IS NOT NULL")
def k4(spark, d):
    rows = ann(spark, d)
    early = K.until_first_blank(rows, "l1", ["dialog_id"], "pos").select("utt_id", F.lit(True).alias("early"))
    return K.drop_blank_rows(rows, "l1").join(early, "utt_id", "left").select("utt_id", F.coalesce("early", F.lit(False)).alias("before_blank"))


@query("K8_label_to_id", f"{ANN} SELECT utt_id, {MAP_IDS}[{STRIPPED.format('l1')}[1]] AS id, array_to_string(list_transform({STRIPPED.format('l1')}, lambda x: coalesce({MAP_IDS}[x], -1)), ',') AS ids FROM ann WHERE l1 IS NOT NULL")
def k8(spark, d):
    labels = K.parse_labels(c("l1"))
    ids = F.transform(K.labels_to_ids(labels), lambda x: F.coalesce(x, F.lit(-1)).cast("string"))
    return ann(spark, d).filter("l1 IS NOT NULL").select("utt_id", K.label_to_id(labels[0]).alias("id"), F.array_join(ids, ",").alias("ids"))


_NAMES = "CASE b " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS)) + " END"
_CODES = "CASE " + _NAMES + " " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(sorted(LABELS)[1:])) + " END"
select("K9_remap_vocabulary", f"SELECT utt_id, CAST({_CODES} AS BIGINT) AS code FROM ann", utt_id=lambda: c("utt_id"), code=lambda: K.remap_vocabulary(c("b").cast("int"), dict(enumerate(LABELS)), sorted(LABELS)[1:]))


@query("K10_build_label_vocab", "SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events WHERE event_type IS NOT NULL)")
def k10(spark, d):
    return K.build_label_vocab(spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "label"), "label")


@query("K11_dense_ids_by_flag", "SELECT s_suppkey, s_suppkey % 2 AS flag, row_number() OVER (ORDER BY s_suppkey % 2 DESC, s_suppkey) - 1 AS id FROM supplier")
def k11(spark, d):
    rows = spark.read.parquet(f"{d}/supplier.parquet").withColumn("flag", c("s_suppkey") % 2)
    return K.dense_ids_by_flag(rows, "s_suppkey", "flag", "s_suppkey")


select("K12_encode_speaker", "SELECT dialog_id, pos, CASE speaker WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END AS id, CASE speaker WHEN 'user' THEN '1,0' WHEN 'assistant' THEN '0,1' ELSE '0,0' END AS hot FROM conv", source="conv", dialog_id=lambda: c("dialog_id"), pos=lambda: c("pos"), id=lambda: K.encode_speaker(c("speaker"), ["user", "assistant"]), hot=lambda: F.array_join(K.onehot(K.encode_speaker(c("speaker"), ["user", "assistant"]), 2).cast("array<string>"), ","))
select("K13_norm_demographics", "SELECT utt_id, CASE WHEN speaker = 'A' THEN 'female' ELSE 'B' END AS gender FROM ann", utt_id=lambda: c("utt_id"), gender=lambda: K.norm_demographics(F.expr("' ' || speaker || ' '"), {"A": "female"}))
select("K14_count_stars", "SELECT utt_id, pos % 6 AS stars FROM ann", utt_id=lambda: c("utt_id"), stars=lambda: K.count_stars(F.expr("'x' || repeat('★', CAST(pos % 6 AS INT)) || '☆'")))
_ALIAS = "CASE pos % 4 WHEN 0 THEN 'Li Bo(old)' WHEN 1 THEN 'Li；Bo' WHEN 2 THEN 'Li Bo，Wu' ELSE NULL END"
select("K15_alias_list", "SELECT utt_id, dialog_id || CASE pos % 4 WHEN 0 THEN '|Li|Bo' WHEN 1 THEN '|Li|Bo' WHEN 2 THEN '|Li Bo|Wu' ELSE '' END AS names FROM ann", utt_id=lambda: c("utt_id"), names=lambda: F.array_join(K.alias_list(c("dialog_id"), F.expr(_ALIAS)), "|"))
select("K16_mask_names", "SELECT utt_id, replace(replace(text, event_type2, '[NAME]'), 'o', '[NAME]') AS t FROM (SELECT *, string_split(text, ' ')[1] AS event_type2 FROM ann)", utt_id=lambda: c("utt_id"), t=lambda: K.mask_names(c("text"), F.array(F.split(c("text"), " ")[0], F.lit("o"))))
select("T1_tc_seconds", "SELECT utt_id, round(CAST(split_part(end_tc, ':', 2) AS INT) * 60 + CAST(split_part(end_tc, ':', 3) AS INT) + CAST(split_part(end_tc, ':', 4) AS INT) / 25, 6) AS s FROM ann", utt_id=lambda: c("utt_id"), s=lambda: F.round(K.tc_seconds(c("end_tc")), 6))
select("T2_tc_seconds_cut", "SELECT utt_id, round(CAST(split_part(end_tc, ':', 2) AS INT) * 60 + CAST(split_part(end_tc, ':', 3) AS INT) + (CAST(split_part(end_tc, ':', 4) AS INT) + 1) * CAST(0.04 AS DOUBLE), 6) AS s FROM ann", utt_id=lambda: c("utt_id"), s=lambda: F.round(K.tc_seconds_cut(c("end_tc")), 6))
select("T3_tc_seconds_centi", "SELECT utt_id, round(CAST(split_part(end_tc, ':', 2) AS INT) * 60 + CAST(split_part(end_tc, ':', 3) AS INT) + CAST(split_part(end_tc, ':', 4) AS INT) * CAST(0.01 AS DOUBLE), 6) AS s FROM ann", utt_id=lambda: c("utt_id"), s=lambda: F.round(K.tc_seconds_centi(c("end_tc")), 6))
select("T4_tc_frame", "SELECT utt_id, f1 AS frame FROM ann", utt_id=lambda: c("utt_id"), frame=lambda: K.tc_frame(c("end_tc")))
_MS = "substr(end_tc, 1, 8) || ',' || lpad(CAST(event_id * 7 % 1000 AS STRING), 3, '0')"
select("T5_srt_to_tc", "SELECT utt_id, substr(end_tc, 1, 8) || ':' || lpad(CAST(CAST(floor(event_id * 7 % 1000 / 40) AS INT) AS STRING), 2, '0') AS a, substr(end_tc, 1, 8) || ':' || lpad(CAST(CAST(ceil(event_id * 7 % 1000 / 40) AS INT) AS STRING), 2, '0') AS b FROM ann", utt_id=lambda: c("utt_id"), a=lambda: K.srt_to_tc(F.expr(_MS), True), b=lambda: K.srt_to_tc(F.expr(_MS), False))
select("T6_format_duration", "SELECT utt_id, format('0:{:d}:{:05.2f}', f1 // 1500, CAST(f1 % 1500 AS DOUBLE) / 25) AS t FROM ann", utt_id=lambda: c("utt_id"), t=lambda: K.format_duration(c("f1") / 25))
select("T7_sample_range", "SELECT utt_id, CAST(floor((f0 * 40 + 50) * 16) AS BIGINT) AS a, CAST(floor((f1 * 40 + 50) * 16) AS BIGINT) AS b FROM ann", utt_id=lambda: c("utt_id"), a=lambda: K.sample_range(c("f0") * 40 + 0, c("f1") * 40, 16, 50)[0], b=lambda: K.sample_range(c("f0") * 40, c("f1") * 40, 16, 50)[1])
_SCORES = "array(CAST(b AS DOUBLE), CAST(pos % 5 AS DOUBLE), CAST(event_id % 6 AS DOUBLE))"
_LIST = "[CAST(b AS DOUBLE), CAST(pos % 5 AS DOUBLE), CAST(event_id % 6 AS DOUBLE)]"
select("K17_argmax", f"SELECT utt_id, list_position({_LIST}, list_max({_LIST})) - 1 AS best, round(exp(b - list_max({_LIST})) / (exp(b - list_max({_LIST})) + exp(pos % 5 - list_max({_LIST})) + exp(event_id % 6 - list_max({_LIST}))), 6) AS p FROM ann", utt_id=lambda: c("utt_id"), best=lambda: K.argmax(F.expr(_SCORES)), p=lambda: F.round(K.softmax(F.expr(_SCORES))[0], 6))

# checks


@query("Q1_check_speaker_domain", f"{CONV} SELECT dialog_id || '_' || CAST(pos AS STRING) AS utt_id, speaker FROM conv WHERE speaker IS NULL OR speaker NOT IN ('user', 'assistant')")
def q1(spark, d):
    return Q.check_speaker_domain(fixture(spark, d, "conv").withColumn("utt_id", F.concat_ws("_", "dialog_id", "pos")), ["user", "assistant"])


@query("Q2_check_first_speaker", f"{CONV} SELECT dialog_id, min_by(speaker, pos) AS first_speaker FROM conv GROUP BY 1 HAVING min_by(speaker, pos) <> 'user'")
def q2(spark, d):
    return Q.check_first_speaker(fixture(spark, d, "conv"), "user")


@query("Q3_check_unique_utts", f"{ANN} SELECT dialog_id, pos % 40 AS key, count(*) AS times FROM ann GROUP BY 1, 2 HAVING count(*) > 1")
def q3(spark, d):
    return Q.check_unique_utts(ann(spark, d), c("pos") % 40)


@query("Q4_check_annotators_aligned", f"{ANN}, s AS (SELECT unnest([1, 2, 3]) AS k, * FROM ann), kept AS (SELECT * FROM s WHERE NOT (k = 2 AND event_id % 97 = 0)), t AS (SELECT k, dialog_id, count(*) AS u, 1 + sum(ch) AS t FROM (SELECT k, dialog_id, CASE WHEN speaker <> lag(speaker, 1, 'A') OVER (PARTITION BY k, dialog_id ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM kept) GROUP BY 1, 2) SELECT dialog_id, count(*) AS n_annotators, count(DISTINCT u) AS utt_counts, count(DISTINCT t) AS turn_counts FROM t GROUP BY 1 HAVING count(*) < 3 OR count(DISTINCT u) > 1 OR count(DISTINCT t) > 1")
def q4(spark, d):
    wide = ann(spark, d)
    kept = sheets(wide).join(wide.filter("event_id % 97 = 0").select("utt_id", F.lit(2).alias("annotator")), ["utt_id", "annotator"], "left_anti")
    return Q.check_annotators_aligned(kept)


@query("Q5_check_first_label_present", f"{ANN} SELECT k AS annotator, dialog_id FROM ann, (SELECT unnest([1, 2, 3]) AS k) WHERE pos = 1 AND event_id % (k + 8) = 0")
def q5(spark, d):
    lacking = {f"l{k}": F.when(c("event_id") % (k + 8) != 0, c(f"l{k}")) for k in (1, 2, 3)}
    return Q.check_first_label_present(sheets(ann(spark, d).withColumns(lacking)))


@query("Q6_check_label_vocab", f"{ANN} SELECT label, count(*) AS times FROM (SELECT unnest({STRIPPED.format('l1')}) AS label FROM ann UNION ALL SELECT unnest({STRIPPED.format('l2')}) FROM ann UNION ALL SELECT unnest({STRIPPED.format('l3')}) FROM ann) WHERE label IS NULL OR label NOT IN ('Happy', 'Neutral', 'Sad') GROUP BY 1")
def q6(spark, d):
    return Q.check_label_vocab(A.sheet_labels(sheets(ann(spark, d))), LABELS[:3])


@query("Q7_check_two_speakers", f"{CONV} SELECT dialog_id, count(DISTINCT speaker) AS n_speakers FROM conv GROUP BY 1 HAVING count(DISTINCT speaker) <> 2")
def q7(spark, d):
    return Q.check_two_speakers(fixture(spark, d, "conv"))


@query("Q8_check_row_conservation", f"{ANN} SELECT utt_id, CASE WHEN event_id % 13 = 0 THEN 'lost' ELSE 'added' END AS what FROM ann WHERE (event_id % 13 = 0) <> (event_id % 17 = 0)")
def q8(spark, d):
    rows = ann(spark, d)
    return Q.check_row_conservation(rows.filter("event_id % 17 <> 0"), rows.filter("event_id % 13 <> 0"), "utt_id")


@query("Q9_check_timecode_format", f"{ANN} SELECT utt_id, substr(end_tc, 1, 8) AS tc FROM ann WHERE event_id % 9 = 0")
def q9(spark, d):
    return Q.check_timecode_format(ann(spark, d).withColumn("tc", F.expr("CASE WHEN event_id % 9 = 0 THEN substr(end_tc, 1, 8) ELSE end_tc END")), "tc")


@query("Q10_check_contiguous_dialogs", f"{ANN} SELECT dialog_id, count(*) AS starts FROM (SELECT dialog_id, lag(dialog_id) OVER (PARTITION BY movie ORDER BY event_id) AS p FROM ann) WHERE p IS NULL OR p <> dialog_id GROUP BY 1 HAVING count(*) > 1")
def q10(spark, d):
    return Q.check_contiguous_dialogs(ann(spark, d), "movie", "event_id")


# merge, votes and agreement

FILL = ", ".join(f"{STRIPPED.format(f'last_value(l{k} IGNORE NULLS) OVER (PARTITION BY dialog_id ORDER BY pos ROWS UNBOUNDED PRECEDING)')} AS p{k}" for k in (1, 2, 3))
ALIGNED = f"{ANN}, al AS (SELECT *, {FILL} FROM ann)"
VOTED = f"""{ALIGNED}, cnt AS (SELECT utt_id, lab, min(o) AS o, least(count(*), 3) AS k FROM (SELECT utt_id, unnest(list_concat(p1, p2, p3)) AS lab, generate_subscripts(list_concat(p1, p2, p3), 1) AS o FROM al) GROUP BY 1, 2),
two AS (SELECT utt_id, list(lab ORDER BY o) FILTER (WHERE k = 3) AS c3, list(lab ORDER BY o) FILTER (WHERE k = 2) AS c2 FROM cnt GROUP BY 1),
agreed AS (SELECT al.*, coalesce(c3, []) AS c3, coalesce(c2, []) AS c2, CASE WHEN p1[1] = p2[1] OR p1[1] = p3[1] THEN p1[1] WHEN p2[1] = p3[1] THEN p2[1] END AS top FROM al JOIN two USING (utt_id)),
voted AS (SELECT *, CASE WHEN len(c3) = 1 THEN list_concat(c3, c2) WHEN len(c3) > 1 THEN c3 WHEN len(c2) > 0 THEN c2 ELSE ['NotSure'] END AS multi,
CASE WHEN len(c3) = 1 THEN c3[1] WHEN len(c3) > 1 THEN coalesce(top, c3[1]) WHEN len(c2) = 1 THEN c2[1] WHEN len(c2) > 1 THEN coalesce(top, c2[1]) ELSE 'NotSure' END AS main FROM agreed)"""
TURNS = f"{ANN}, turns AS (SELECT *, row_number() OVER (PARTITION BY dialog_id, turn_no ORDER BY pos) AS pos_in_turn FROM (SELECT *, 1 + sum(ch) OVER (PARTITION BY dialog_id ORDER BY pos) AS turn_no FROM (SELECT *, CASE WHEN speaker <> lag(speaker, 1, 'A') OVER (PARTITION BY dialog_id ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM ann)))"


@query("A1_dialog_turn_counts", f"{TURNS} SELECT movie, count(*) AS n_dialogs, CAST(sum(t) AS BIGINT) AS n_turns, CAST(sum(u) AS BIGINT) AS n_utts FROM (SELECT movie, dialog_id, max(turn_no) AS t, count(*) AS u FROM turns GROUP BY 1, 2) GROUP BY 1")
def a1(spark, d):
    return A.dialog_turn_counts(ann(spark, d), ["movie"])


@query("A2_segment_turns", f"{TURNS} SELECT utt_id, CAST(turn_no AS BIGINT) AS turn_no, pos_in_turn FROM turns")
def a2(spark, d):
    return A.segment_turns(ann(spark, d)).select("utt_id", "turn_no", "pos_in_turn")


@query("A3_fill_labels_forward", f"{ALIGNED} SELECT utt_id, unnest([1, 2, 3]) AS annotator, unnest([array_to_string(p1, '|'), array_to_string(p2, '|'), array_to_string(p3, '|')]) AS labels FROM al")
def a3(spark, d):
    return filled(spark, d).select("utt_id", "annotator", F.array_join("labels", "|").alias("labels"))


@query("A4_label_volume", f"{ALIGNED} SELECT annotator, CAST(sum(n) AS BIGINT) AS n_labels FROM (SELECT unnest([1, 2, 3]) AS annotator, unnest([len(p1), len(p2), len(p3)]) AS n FROM al) GROUP BY 1")
def a4(spark, d):
    return A.label_volume(filled(spark, d))


@query("A5_align_annotators", f"{ALIGNED} SELECT utt_id, dialog_id, speaker, start_tc, array_to_string(p1, '|') AS p1, array_to_string(p2, '|') AS p2, array_to_string(p3, '|') AS p3 FROM al")
def a5(spark, d):
    got = A.merge_sheets(A.sheet_labels(sheets(ann(spark, d))))
    return got.select("utt_id", "dialog_id", "speaker", "start_tc", *[F.array_join(p, "|").alias(p) for p in ("p1", "p2", "p3")])


@query("A6_agreement_all", f"{ALIGNED} SELECT movie, count(*) FILTER (WHERE s) AS all_same, count(*) FILTER (WHERE s OR f) AS all_first, count(*) FILTER (WHERE s OR f OR o) AS all_overlap FROM (SELECT movie, p1 = p2 AND p2 = p3 AS s, p1[1] = p2[1] AND p2[1] = p3[1] AS f, len(list_intersect(list_intersect(p1, p2), p3)) > 0 AS o FROM al) GROUP BY 1")
def a6(spark, d):
    return A.agreement_all(aligned(spark, d), ["movie"])


@query("A7_agreement_any_pair", f"{ALIGNED} SELECT movie, count(*) FILTER (WHERE p1 = p2 OR p1 = p3 OR p2 = p3) AS pair_same, count(*) FILTER (WHERE p1[1] = p2[1] OR p1[1] = p3[1] OR p2[1] = p3[1]) AS pair_first, count(*) FILTER (WHERE list_has_any(p1, p2) OR list_has_any(p1, p3) OR list_has_any(p2, p3)) AS pair_overlap FROM al GROUP BY 1")
def a7(spark, d):
    return A.agreement_any_pair(aligned(spark, d), ["movie"])


@query("A8_vote_labels", f"{VOTED} SELECT utt_id, array_to_string(multi, '|') AS multi, main FROM voted")
def a8(spark, d):
    return voted(spark, d).select("utt_id", F.array_join("multi", "|").alias("multi"), "main")


def _fleiss(by, where="TRUE"):
    g = f"{by}, " if by else ""
    return f"""{ALIGNED}, r AS (SELECT movie, utt_id, [p1[1], p2[1], p3[1]] AS r FROM al), ok AS (SELECT * FROM r WHERE {where}),
po AS (SELECT {g}count(*) AS n, avg((CAST(r[1] = r[2] AS INT) + CAST(r[1] = r[3] AS INT) + CAST(r[2] = r[3] AS INT)) / 3) AS po FROM ok {'GROUP BY ' + by if by else ''}),
pe AS (SELECT {g}sum(share * share) AS pe FROM (SELECT {g}label, count(*) / sum(count(*)) OVER ({'PARTITION BY ' + by if by else ''}) AS share FROM (SELECT movie, unnest(r) AS label FROM ok) GROUP BY {g}label) {'GROUP BY ' + by if by else ''})
SELECT {g}n, round((po - pe) / (1 - pe), 6) AS kappa FROM po {'JOIN pe USING (' + by + ')' if by else ', pe'}"""


@query("A9_fleiss_kappa", _fleiss("movie"))
def a9(spark, d):
    return G.fleiss_kappa(aligned(spark, d), ["movie"]).withColumn("kappa", F.round("kappa", 6))


@query("A10_fleiss_kappa_exclude", _fleiss("movie", "NOT list_contains(r, 'Other')"))
def a10(spark, d):
    return G.fleiss_kappa(aligned(spark, d), ["movie"], "Other").withColumn("kappa", F.round("kappa", 6))


@query("A11_fleiss_kappa_global", _fleiss(""))
def a11(spark, d):
    return G.fleiss_kappa(aligned(spark, d)).withColumn("kappa", F.round("kappa", 6))


_RATES = "SELECT movie, a.pair, a.x, a.y, a.o FROM (SELECT movie, unnest([" + ", ".join(f"{{'pair': '{a}_{b}', 'x': {'main' if a == 'vote' else a + '[1]'}, 'y': {'main' if b == 'vote' else b + '[1]'}, 'o': list_has_any({'multi' if a == 'vote' else a}, {'multi' if b == 'vote' else b})}}" for a, b in G.VOTED) + "]) AS a FROM voted)"


@query("A12_cohen_kappa_pairs", f"{VOTED}, r AS ({_RATES}), n AS (SELECT movie, pair, count(*) AS n, count(*) FILTER (WHERE x = y) AS same FROM r GROUP BY 1, 2), mx AS (SELECT movie, pair, x AS l, count(*) AS k FROM r GROUP BY 1, 2, 3), my AS (SELECT movie, pair, y AS l, count(*) AS k FROM r GROUP BY 1, 2, 3), pe AS (SELECT mx.movie, mx.pair, sum(mx.k * my.k) AS s FROM mx JOIN my USING (movie, pair, l) GROUP BY 1, 2) SELECT movie, pair, round((same / n - coalesce(s, 0) / n / n) / (1 - coalesce(s, 0) / n / n), 6) AS kappa FROM n LEFT JOIN pe USING (movie, pair)")
def a12(spark, d):
    return G.cohen_kappa_pairs(voted(spark, d), ["movie"]).withColumn("kappa", F.round("kappa", 6))


@query("A13_overlap_similarity_pairs", f"{VOTED}, r AS ({_RATES}) SELECT pair, round(avg(CAST(o AS INT)), 6) AS overlap FROM r GROUP BY 1")
def a13(spark, d):
    return G.overlap_similarity_pairs(voted(spark, d)).withColumn("overlap", F.round("overlap", 6))


OVERLAP = "SELECT movie, dialog_id, avg(CAST(len(list_intersect(list_intersect(p1, p2), p3)) > 0 AS INT)) AS overlap FROM al GROUP BY 1, 2"


@query("A14_overlap_similarity_dialog", f"{ALIGNED} SELECT movie, dialog_id, round(overlap, 6) AS overlap FROM ({OVERLAP})")
def a14(spark, d):
    return G.overlap_similarity_dialog(aligned(spark, d)).withColumn("overlap", F.round("overlap", 6))


FEEDBACK = " UNION ALL ".join(f"SELECT {k} AS annotator, dialog_id FROM ann GROUP BY 2 HAVING bool_or(length(fb{k}) > 1)" for k in (1, 2, 3))
GOLD = f"chosen AS (SELECT dialog_id, arg_min(annotator, CASE annotator WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END) AS source FROM ({FEEDBACK}) GROUP BY 1), gold AS (SELECT al.*, source, CASE source WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END AS gold FROM al JOIN chosen USING (dialog_id))"


@query("A15_feedback_dialogs", f"{ANN} {FEEDBACK}")
def a15(spark, d):
    return A.feedback_dialogs(sheets(ann(spark, d)))


@query("A16_gold_from_feedback", f"{ALIGNED}, {GOLD} SELECT utt_id, array_to_string(gold, '|') AS gold, source FROM gold")
def a16(spark, d):
    return A.gold_from_feedback(filled(spark, d)).withColumn("gold", F.array_join("gold", "|"))


@query("A17_similarity_to_gold", f"{ALIGNED}, {GOLD} SELECT movie, " + ", ".join(f"round(avg(CAST(list_has_any({p}, gold) AS INT)), 6) AS {p}_gold" for p in ("p1", "p2", "p3")) + " FROM gold GROUP BY 1")
def a17(spark, d):
    got = A.similarity_to_gold(aligned(spark, d), A.gold_from_feedback(filled(spark, d)), ["movie"])
    return got.withColumns({p: F.round(p, 6) for p in ("p1_gold", "p2_gold", "p3_gold")})


A18_SQL = f"""{VOTED}, r AS ({_RATES}), d AS ({OVERLAP}), {GOLD},
n AS (SELECT movie, pair, count(*) AS n, count(*) FILTER (WHERE x = y) AS same, avg(CAST(o AS INT)) AS overlap FROM r GROUP BY 1, 2),
mx AS (SELECT movie, pair, x AS l, count(*) AS k FROM r GROUP BY 1, 2, 3), my AS (SELECT movie, pair, y AS l, count(*) AS k FROM r GROUP BY 1, 2, 3),
pe AS (SELECT mx.movie, mx.pair, sum(mx.k * my.k) AS s FROM mx JOIN my USING (movie, pair, l) GROUP BY 1, 2),
kp AS (SELECT movie, pair, overlap, (same / n - coalesce(s, 0) / n / n) / (1 - coalesce(s, 0) / n / n) AS kappa FROM n LEFT JOIN pe USING (movie, pair)),
wide AS (SELECT movie, {", ".join(f"round(max({v}) FILTER (WHERE pair = '{a}_{b}'), 6) AS {v}_{a}_{b}" for v in ("kappa", "overlap") for a, b in G.VOTED)} FROM kp GROUP BY 1),
f1 AS (WITH r AS{_fleiss("movie").split(", r AS", 1)[1]}), f2 AS (WITH r AS{_fleiss("movie", "NOT list_contains(r, 'Other')").split(", r AS", 1)[1]}),
dd AS (SELECT movie, round(min(overlap), 6) AS least_dialog, round(avg(overlap), 6) AS mean_dialog FROM d GROUP BY 1),
u AS (SELECT movie, count(*) FILTER (WHERE main = 'NotSure') AS n_not_sure FROM voted GROUP BY 1),
gs AS (SELECT movie, {", ".join(f"round(avg(CAST(list_has_any({p}, gold) AS INT)), 6) AS {p}_gold" for p in ("p1", "p2", "p3"))} FROM gold GROUP BY 1),
st AS (SELECT movie, count(*) % 6 AS stars1, count(*) % 5 AS stars2, count(*) % 4 AS stars3 FROM ann GROUP BY 1)
SELECT wide.*, f1.kappa AS fleiss, f2.kappa AS fleiss_no_other, least_dialog, mean_dialog, n_not_sure, p1_gold, p2_gold, p3_gold, stars1, stars2, stars3
FROM wide JOIN f1 USING (movie) LEFT JOIN f2 USING (movie) JOIN dd USING (movie) JOIN u USING (movie) LEFT JOIN gs USING (movie) LEFT JOIN st USING (movie)"""


def doubles_rounded(df):
    return df.select(*[F.round(name, 6).alias(name) if kind == "double" else name for name, kind in df.dtypes])


def stars(spark, d):
    """The wide table of annotators, one row a movie."""
    n = ann(spark, d).groupBy("movie").agg(F.count("*").cast("int").alias("n"))
    return n.select("movie", *[F.lit(f"n{k}").alias(f"name{k}") for k in (1, 2, 3)], *[F.expr(f"repeat('★', n % {7 - k})").alias(f"rating{k}") for k in (1, 2, 3)])


@query("A18_decision_report", A18_SQL)
def a18(spark, d):
    got = G.decision_report(cut(voted(spark, d)), A.annotator_quality(stars(spark, d)), A.gold_from_feedback(filled(spark, d)))
    return doubles_rounded(got)


@query("A20_annotator_quality", f"{ANN} SELECT movie, unnest([1, 2, 3]) AS annotator, unnest(['n1', 'n2', 'n3']) AS name, unnest([n % 6, n % 5, n % 4]) AS stars FROM (SELECT movie, count(*) AS n FROM ann GROUP BY 1)")
def a20(spark, d):
    return A.annotator_quality(stars(spark, d))


LOW = f"k AS (SELECT movie, kappa FROM ({_fleiss('movie').split(', r AS', 1)[1].join(['WITH r AS', ''])})) , low AS (SELECT movie, dialog_id, round(overlap, 6) AS overlap FROM ({OVERLAP}) JOIN k USING (movie) WHERE overlap < CASE WHEN kappa > 0.45 THEN 0.3 ELSE 0.5 END)"


def _low(spark, d):
    rows = aligned(spark, d)
    return A.low_agreement_dialogs(G.overlap_similarity_dialog(rows), G.fleiss_kappa(rows, ["movie"]))


@query("A21_low_agreement_dialogs", f"{ALIGNED}, {LOW} SELECT al.movie, dialog_id, utt_id, speaker, text, overlap FROM al JOIN low USING (dialog_id)")
def a21(spark, d):
    low = _low(spark, d).withColumn("overlap", F.round("overlap", 6))
    return A.low_agreement_utterances(ann(spark, d).select("movie", "dialog_id", "utt_id", "speaker", "text"), low)


@query("A22_low_agreement_by_annotator", f"{ALIGNED}, {LOW} SELECT unnest(['P1', 'P2', 'P3']) AS annotator, movie, dialog_id FROM low")
def a22(spark, d):
    return A.low_agreement_by_annotator(_low(spark, d))


COUNTED = {
    "all_same": "p1 = p2 AND p2 = p3", "all_first": "p1 = p2 AND p2 = p3 OR p1[1] = p2[1] AND p2[1] = p3[1]",
    "all_overlap": "p1 = p2 AND p2 = p3 OR p1[1] = p2[1] AND p2[1] = p3[1] OR len(list_intersect(list_intersect(p1, p2), p3)) > 0",
    "pair_same": "p1 = p2 OR p1 = p3 OR p2 = p3", "pair_first": "p1[1] = p2[1] OR p1[1] = p3[1] OR p2[1] = p3[1]",
    "pair_overlap": "list_has_any(p1, p2) OR list_has_any(p1, p3) OR list_has_any(p2, p3)",
}
A19_SQL = f"""{VOTED}, t AS ({TURNS.split(', turns AS (', 1)[1][:-1]}),
n AS (SELECT movie, count(*) AS n_dialogs, CAST(sum(t) AS BIGINT) AS n_turns, CAST(sum(u) AS BIGINT) AS n_utts
  FROM (SELECT movie, dialog_id, max(turn_no) AS t, count(*) AS u FROM t GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT movie, {", ".join(f"count(*) FILTER (WHERE {x}) AS {k}" for k, x in COUNTED.items())}, count(*) FILTER (WHERE main = 'NotSure') AS n_not_sure FROM voted GROUP BY 1)
SELECT n.*, s.* EXCLUDE (movie), round(n_turns / n_dialogs, 6) AS turns_per_dialog, round(n_utts / n_turns, 6) AS utts_per_turn, {", ".join(f"round({k} / n_utts, 6) AS {k}_rate" for k in COUNTED)}
FROM n JOIN s USING (movie)"""


@query("A19_movie_statistics", A19_SQL)
def a19(spark, d):
    return doubles_rounded(corpus.movie_statistics(voted(spark, d)))


@query("A23_smooth_uncertain", f"{VOTED} SELECT utt_id, CASE WHEN main IN ('NotSure', 'Other') AND ms = speaker AND mm NOT IN ('NotSure', 'Other') THEN mm ELSE main END AS smoothed FROM (SELECT utt_id, main, speaker, CASE WHEN row_number() OVER w = 1 THEN lead(main) OVER w ELSE lag(main) OVER w END AS mm, CASE WHEN row_number() OVER w = 1 THEN lead(speaker) OVER w ELSE lag(speaker) OVER w END AS ms FROM voted WINDOW w AS (PARTITION BY movie ORDER BY dialog_id, pos))")
def a23(spark, d):
    return A.smooth_uncertain(voted(spark, d)).select("utt_id", "smoothed")


@query("A24_speaker_annotation_template", f"{ANN} SELECT dialog_id, utt_id, start_tc, text FROM ann WHERE pos = 1")
def a24(spark, d):
    return A.speaker_annotation_template(ann(spark, d))


@query("A25_uncertain_count", f"{VOTED} SELECT movie, count(*) FILTER (WHERE main = 'NotSure') AS n_not_sure FROM voted GROUP BY 1")
def a25(spark, d):
    return A.uncertain_count(voted(spark, d))

"""Corpus statistics, dynamics and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark.functions import keys as K
from convspark.functions.vocab import LABELS
from convspark.operators import corpus as C
from convspark.operators import split as S
from convspark.plans.annotation_queries import ANN, TURNS, VOTED, _fleiss, ann, voted
from convspark.plans.fixtures import TABLES, fixture
from convspark.plans.registry import query
from convspark.sources.checkpoints import cut

SIZES = {"train": 7, "val": 1, "test": 2}
SETS = f"sets AS ({TABLES['movie_set'][0]})"
TV = f"{VOTED}, ch AS (SELECT *, CASE WHEN speaker <> lag(speaker, 1, 'A') OVER (PARTITION BY dialog_id ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM voted), tn AS (SELECT *, 1 + sum(ch) OVER (PARTITION BY dialog_id ORDER BY pos) AS turn_no FROM ch), turns AS (SELECT *, row_number() OVER (PARTITION BY dialog_id, turn_no ORDER BY pos) AS pit, max(turn_no) OVER (PARTITION BY dialog_id) AS last_turn FROM tn)"
KIND = "CASE WHEN f = main THEN 'inertia' ELSE 'shift' END"
TURN_MOVES = "tm AS (SELECT * FROM (SELECT *, lag(main) OVER (PARTITION BY dialog_id ORDER BY pos) AS f FROM turns WHERE pit = 1) WHERE f IS NOT NULL)"
WITHIN = "wm AS (SELECT * FROM (SELECT *, lag(main) OVER (PARTITION BY dialog_id, turn_no ORDER BY pos) AS f FROM turns WHERE turn_no < last_turn) WHERE f IS NOT NULL)"
PROFILE = f"""{TV}, {TURN_MOVES}, {WITHIN}, per AS (SELECT movie, dialog_id, max(turn_no) AS t, count(*) AS u FROM turns GROUP BY 1, 2), cn AS (SELECT movie, count(*) AS d, CAST(sum(t) AS BIGINT) AS t, CAST(sum(u) AS BIGINT) AS u FROM per GROUP BY 1),
prof AS (SELECT movie, 'count' AS what, 'n_dialogs' AS key, d AS n FROM cn UNION ALL SELECT movie, 'count', 'n_turns', t FROM cn UNION ALL SELECT movie, 'count', 'n_utts', u FROM cn UNION ALL SELECT movie, 'label', main, count(*) FROM voted GROUP BY 1, 3
UNION ALL SELECT movie, 'turn_' || {KIND}, f || '_' || main, count(*) FROM tm GROUP BY 1, 2, 3 UNION ALL SELECT movie, 'within_' || {KIND}, f || '_' || main, count(*) FROM wm GROUP BY 1, 2, 3)"""


@query("C1_duration_stats", f"{ANN}, p AS (SELECT movie, dialog_id, sum(f1 - f0) AS s, count(*) AS n, sum(length(text)) AS chars, max_by(f1, pos) - min_by(f0, pos) AS span FROM ann GROUP BY 1, 2) SELECT movie, round(sum(s) / 25, 6) AS utt_seconds, round(sum(s) / 25 / sum(n), 6) AS mean_utt_seconds, round(sum(chars) / sum(n), 6) AS mean_chars, round(sum(span) / 25, 6) AS dialog_seconds, round(avg(span) / 25, 6) AS mean_dialog_seconds FROM p GROUP BY 1")
def c1(spark, d):
    got = C.duration_stats(ann(spark, d), K.tc_frame(F.col("start_tc")) / 25, K.tc_frame(F.col("end_tc")) / 25, ["movie"])
    return got.select("movie", *[F.round(x, 6).alias(x) for x in got.columns[1:]])


@query("C2_label_distribution", f"{VOTED} SELECT main, count(*) AS n FROM voted GROUP BY 1")
def c2(spark, d):
    return C.label_distribution(voted(spark, d))


MULTI = "SELECT array_to_string(multi, '_') AS labels, count(*) AS n FROM voted WHERE len(multi) > 1 GROUP BY 1 HAVING count(*) >= 5"


@query("C3_multi_label_distribution", f"{VOTED} {MULTI}")
def c3(spark, d):
    return C.multi_label_distribution(voted(spark, d))


@query("C4_multi_label_rate", f"{VOTED} SELECT CAST(sum(n) AS BIGINT) AS kept, (SELECT count(*) FROM voted) AS n_utts, round(sum(n) / (SELECT count(*) FROM voted), 6) AS rate FROM ({MULTI})")
def c4(spark, d):
    return C.multi_label_rate(voted(spark, d)).withColumn("rate", F.round("rate", 6))


@query("C5_turn_transitions", f"{TV}, {TURN_MOVES} SELECT dialog_id, pos, f AS from_label, main AS to_label, {KIND} AS kind FROM tm")
def c5(spark, d):
    return C.turn_transitions(voted(spark, d)).select("dialog_id", "pos", "from_label", "to_label", "kind")


@query("C6_within_turn_transitions", f"{TV}, {WITHIN} SELECT dialog_id, pos, f AS from_label, main AS to_label, {KIND} AS kind FROM wm")
def c6(spark, d):
    return C.within_turn_transitions(voted(spark, d)).select("dialog_id", "pos", "from_label", "to_label", "kind")


@query("C7_transition_counts", f"{TV}, {TURN_MOVES} SELECT {KIND} AS kind, f || '_' || main AS move, count(*) AS n FROM tm GROUP BY 1, 2")
def c7(spark, d):
    return C.transition_counts(C.turn_transitions(voted(spark, d)))


@query("C8_corpus_rollup", f"{TURNS}, {SETS}, n AS (SELECT movie, dialog_id, max(turn_no) AS t, count(*) AS u FROM turns GROUP BY 1, 2) SELECT count(*) AS n_dialogs, CAST(sum(t) AS BIGINT) AS n_turns, CAST(sum(u) AS BIGINT) AS n_utts, round(sum(t) / count(*), 6) AS turns_per_dialog, round(sum(u) / sum(t), 6) AS utts_per_turn, round(sum(u) / count(*), 6) AS utts_per_dialog FROM n WHERE movie IN (SELECT movie FROM sets WHERE set_name = 'train')")
def c8(spark, d):
    got = C.corpus_rollup(C.movie_statistics(voted(spark, d)), fixture(spark, d, "movie_set").filter("set_name = 'train'"))
    return got.select("n_dialogs", "n_turns", "n_utts", *[F.round(x, 6).alias(x) for x in ("turns_per_dialog", "utts_per_turn", "utts_per_dialog")])


@query("C9_speaker_demographics", "WITH s AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'child' WHEN 1 THEN 'young' ELSE 'old' END AS age, CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender FROM customer) SELECT 'age' AS kind, age AS value, count(*) AS n FROM s GROUP BY 2 UNION ALL SELECT 'gender', gender, count(*) FROM s GROUP BY 2")
def c9(spark, d):
    people = spark.read.parquet(f"{d}/customer.parquet")
    age = K.norm_demographics(F.expr("CASE c_nationkey % 3 WHEN 0 THEN 'chlid' WHEN 1 THEN 'young ' ELSE 'old' END"), {"chlid": "child"})
    return C.speaker_demographics(people.select(age.alias("age"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'female' ELSE 'male' END").alias("gender")))


@query("C10_dynamics_for_onehot_corpus", f"{VOTED}, m AS (SELECT dialog_id, CAST(speaker <> first_value(speaker) OVER w AS INT) AS o, CAST(lag(main) OVER w <> main AS INT) AS mv FROM voted WINDOW w AS (PARTITION BY dialog_id ORDER BY pos)), p AS (SELECT dialog_id, 1 + sum(o) AS t, sum(mv) AS s, count(mv) AS k FROM m GROUP BY 1) SELECT count(*) AS n_dialogs, CAST(sum(t) AS BIGINT) AS n_turns, CAST(sum(s) AS BIGINT) AS shift, CAST(sum(k) - sum(s) AS BIGINT) AS inertia FROM p")
def c10(spark, d):
    coded = voted(spark, d).withColumn("speaker", K.encode_speaker(F.col("speaker")))
    return C.not_first_speaker_count(coded)


_TAGS = "CASE event_id % 4 WHEN 0 THEN 'joy + sad' WHEN 1 THEN 'joy' WHEN 2 THEN 'sad+ fear' ELSE 'calm' END"


@query("C11_selection_stats", f"{ANN} SELECT tag, count(*) AS n_clips, round(sum(s), 6) AS seconds FROM (SELECT unnest(string_split(replace({_TAGS}, ' ', ''), '+')) AS tag, (f1 - f0) / 25 AS s FROM ann) GROUP BY 1")
def c11(spark, d):
    clips = ann(spark, d).select(F.expr(_TAGS).alias("tags"), ((F.col("f1") - F.col("f0")) / 25).alias("seconds"))
    return C.selection_stats(clips).withColumn("seconds", F.round("seconds", 6))


def profile(spark, d):
    """Some hundred rows a movie, which are read more than once."""
    return cut(C.movie_profile(voted(spark, d)))


def map_text(x):
    return F.array_join(F.transform(F.map_entries(x), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), " ")


MAP_SQL = ", ".join(f"coalesce(string_agg(key || ':' || CAST(n AS VARCHAR), ' ' ORDER BY key) FILTER (WHERE what = '{x}'), '') AS {x}" for x in C.MAPS)
FLEISS = _fleiss("movie").split(", r AS", 1)[1]
C12_SQL = f"""{PROFILE}, kappas AS (WITH r AS{FLEISS})
SELECT movie, max(n) FILTER (WHERE key = 'n_dialogs') AS n_dialogs, max(n) FILTER (WHERE key = 'n_turns') AS n_turns,
       max(n) FILTER (WHERE key = 'n_utts') AS n_utts, max(kappa) AS kappa, {MAP_SQL}
FROM prof JOIN (SELECT movie, kappa FROM kappas) USING (movie) GROUP BY movie"""


@query("C12_movie_profile", C12_SQL)
def c12(spark, d):
    got = C.profile_maps(C.movie_profile(voted(spark, d), ("p1", "p2", "p3")))
    return got.select("movie", "n_dialogs", "n_turns", "n_utts", F.round("kappa", 6).alias("kappa"), *[map_text(x).alias(x) for x in C.MAPS])


@query("C13_subset_profile", f"{PROFILE}, {SETS} SELECT what, key, CAST(sum(n) AS BIGINT) AS n FROM prof JOIN sets USING (movie) WHERE set_name = 'test' GROUP BY 1, 2")
def c13(spark, d):
    return C.subset_profile(C.movie_profile(voted(spark, d)), fixture(spark, d, "movie_set").filter("set_name = 'test'"))


@query("C14_share_of_total", f"{PROFILE}, {SETS} SELECT what, key, round(coalesce(sum(n) FILTER (WHERE set_name = 'val'), 0) / sum(n), 4) AS share FROM prof JOIN sets USING (movie) GROUP BY 1, 2")
def c14(spark, d):
    whole = profile(spark, d)
    total = whole.groupBy("what", "key").agg(F.sum("n").alias("n"))
    return C.share_of_total(C.subset_profile(whole, fixture(spark, d, "movie_set").filter("set_name = 'val'")), total)


RANGES = "CASE WHEN r <= 7 THEN 'train' WHEN r <= 8 THEN 'val' WHEN r <= 10 THEN 'test' END"


@query("C15_group_split", f"{ANN} SELECT movie, {RANGES} AS set_name FROM (SELECT movie, row_number() OVER (ORDER BY md5('7:' || movie), movie) AS r FROM (SELECT DISTINCT movie FROM ann)) WHERE r <= 10")
def c15(spark, d):
    return S.group_split(ann(spark, d), SIZES, seed=7)


@query("C16_split_balance", f"{PROFILE}, {SETS}, tot AS (SELECT what, key, sum(n) AS a FROM prof GROUP BY 1, 2), s AS (SELECT set_name, what, key, sum(n) AS n FROM prof JOIN sets USING (movie) GROUP BY 1, 2, 3) SELECT q.set_name, what, key, round(coalesce(n, 0) / a, 4) AS share FROM (SELECT DISTINCT set_name FROM s) q CROSS JOIN tot LEFT JOIN s USING (set_name, what, key)")
def c16(spark, d):
    return S.split_balance(profile(spark, d), fixture(spark, d, "movie_set"))


SEARCH = f"""{PROFILE}, dl AS (SELECT seed, movie, {RANGES} AS set_name FROM
(SELECT seed, movie, row_number() OVER (PARTITION BY seed ORDER BY md5(CAST(seed AS STRING) || ':' || movie), movie) AS r FROM (SELECT DISTINCT movie FROM prof), (SELECT unnest(range(50)) AS seed)) WHERE r <= 10),
lb AS (SELECT movie, key, n FROM prof WHERE what = 'label'), tot AS (SELECT key, sum(n) AS a FROM lb GROUP BY 1), sh AS (SELECT seed, set_name, key, sum(n) AS n FROM lb JOIN dl USING (movie) GROUP BY 1, 2, 3),
dv AS (SELECT seed, round(sum(abs(n / a - CASE set_name WHEN 'train' THEN 0.7::DOUBLE WHEN 'val' THEN 0.1::DOUBLE ELSE 0.2::DOUBLE END)), 6) AS deviation FROM sh JOIN tot USING (key) GROUP BY 1)"""


@query("C17_search_split", f"{SEARCH} SELECT seed, deviation FROM dv ORDER BY deviation, seed LIMIT 1")
def c17(spark, d):
    return S.search_split(profile(spark, d), SIZES, 50)


@query("C18_apply_group_split", f"{ANN}, {SETS} SELECT set_name, count(*) AS n_utts, count(DISTINCT dialog_id) AS n_dialogs FROM ann JOIN sets USING (movie) GROUP BY 1")
def c18(spark, d):
    rows = S.apply_group_split(ann(spark, d), fixture(spark, d, "movie_set"))
    return rows.groupBy("set_name").agg(F.count("*").alias("n_utts"), F.countDistinct("dialog_id").alias("n_dialogs"))


@query("C19_length_stats", f"{ANN}, {SETS}, r AS (SELECT set_name, f1 - f0 AS n, row_number() OVER (PARTITION BY set_name ORDER BY f1 - f0) - 1 AS i, count(*) OVER (PARTITION BY set_name) AS k FROM ann JOIN sets USING (movie)) SELECT set_name, round(avg(n), 6) AS mean, max(n) FILTER (WHERE i = floor(k * 0.5)) AS p50, max(n) FILTER (WHERE i = floor(k * 0.8)) AS p80, max(n) FILTER (WHERE i = floor(k * 0.95)) AS p95 FROM r GROUP BY 1")
def c19(spark, d):
    rows = S.apply_group_split(ann(spark, d), fixture(spark, d, "movie_set")).withColumn("n", F.col("f1") - F.col("f0"))
    return C.length_stats(rows, "n", ["set_name"]).withColumn("mean", F.round("mean", 6))


@query("C20_class_weights", f"{VOTED}, {SETS} SELECT main, count(*) AS n, round(sum(count(*)) OVER () / count(*), 6) AS weight FROM voted JOIN sets USING (movie) WHERE set_name = 'train' GROUP BY 1")
def c20(spark, d):
    rows = S.apply_group_split(voted(spark, d), fixture(spark, d, "movie_set")).filter("set_name = 'train'")
    return C.class_weights(rows, "main").withColumn("weight", F.round("weight", 6))


@query("C21_dataset_label_counts", f"{VOTED}, {SETS} SELECT set_name, count(DISTINCT dialog_id) AS n_dialogs, count(*) AS n_utts, " + ", ".join(f"count(*) FILTER (WHERE main = '{x}') AS \"{x}\"" for x in LABELS) + " FROM voted JOIN sets USING (movie) GROUP BY 1")
def c21(spark, d):
    return C.dataset_label_counts(S.apply_group_split(voted(spark, d), fixture(spark, d, "movie_set")), LABELS)


@query("C22_fixed_range_split", "WITH r AS (SELECT DISTINCT conv_id, CASE WHEN conv_id BETWEEN 0 AND 59 THEN 'train' WHEN conv_id >= 60 THEN 'test' END AS s FROM conversations) SELECT conv_id, CASE WHEN s = 'train' AND row_number() OVER (PARTITION BY s ORDER BY conv_id DESC) <= 20 THEN 'val' ELSE s END AS set_name FROM r")
def c22(spark, d):
    dialogs = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct()
    return S.tail_validation_split(S.fixed_range_split(dialogs, F.col("conv_id"), {"train": (0, 59), "test": (60, 1 << 62)}), "conv_id")


@query("C23_kfold_tables", "SELECT f.fold, CASE WHEN vec_id % 10 = f.fold THEN 'test' WHEN vec_id % 10 = (f.fold + 1) % 10 THEN 'val' ELSE 'train' END AS set_name, vec_id, label FROM embeddings, (SELECT unnest(range(10)) AS fold) f")
def c23(spark, d):
    emb = spark.read.parquet(f"{d}/embeddings.parquet")
    folds = emb.select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("fold"))
    k = F.col("vec_id") % 10
    folds = folds.withColumn("set_name", F.when(k == F.col("fold"), "test").when(k == (F.col("fold") + 1) % 10, "val").otherwise("train"))
    return S.kfold_tables(emb, folds, "vec_id", ["label"])

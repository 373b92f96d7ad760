"""Feature vectors, frames and faces."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark.functions import vectors as V
from convspark.operators import faces as X
from convspark.operators import features as T
from convspark.operators import ml
from convspark.plans.annotation_queries import ANN, ann
from convspark.plans.evaluation_queries import conv, rounded
from convspark.plans.fixtures import TABLES, fixture, with_sql
from convspark.plans.registry import query
from convspark.sources.checkpoints import cut

c = F.col
EMB = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT *, list_transform(range(8), lambda i: v[i * 8 + 1 : i * 8 + 8]) AS m FROM e)"
FACES, SETS = with_sql("faces"), TABLES["movie_set"][0]


def emb(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("v", V.doubles(c("embedding")))
    return rows.withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8))))


def text(v):
    """A vector as text of its values in millionths, which is the same in either engine."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 1000).cast("long").cast("string")), ",")


def sql_text(v):
    return f"array_to_string(list_transform({v}, lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',')"


def vector(name, expr, sql, where=None):
    @query(name, f"{EMB} SELECT vec_id, {sql_text(sql)} AS out FROM q" + (f" WHERE {where}" if where else ""))
    def run(spark, d):
        rows = emb(spark, d)
        return (rows.filter(where) if where else rows).select("vec_id", text(expr()).alias("out"))


AVG = "list_transform(range(1, 9), lambda j: list_avg(list_transform({}, lambda r: r[j])))"
vector("V1_pool_mean", lambda: F.concat(V.pool_mean(c("m")), V.pool_mean(c("m"), True)), f"list_concat({AVG.format('m')}, {AVG.format('m[2:7]')})")
vector("V2_pool_first_last", lambda: F.concat(V.pool_first(c("m")), V.pool_last(c("m"))), "list_concat(m[1], m[8])")
vector("V3_zero_if_missing", lambda: V.zero_if_missing(F.when(c("vec_id") % 3 == 0, F.lit(None)).when(c("vec_id") % 3 == 1, F.slice("v", 1, 0)).otherwise(c("v")), 64), "CASE WHEN vec_id % 3 < 2 THEN list_transform(range(64), lambda x: CAST(0 AS DOUBLE)) ELSE v END")
vector("V4_squeeze_batch", lambda: V.pool_first(V.squeeze_batch(F.array("m"))), "m[1]")
vector("V5_downsample_mean", lambda: F.flatten(V.downsample_mean(c("m"), 3)), f"list_concat(list_concat({AVG.format('m[1:3]')}, {AVG.format('m[4:6]')}), {AVG.format('m[7:8]')})")
vector("V6_clip_pad", lambda: F.concat(F.flatten(V.clip_to(c("m"), 3)), V.pad_to(V.pool_first(c("m")), 12)), "list_concat(v[1:24], list_concat(v[1:8], [0, 0, 0, 0]))")
vector("V9_zscore_rowwise", lambda: V.zscore(c("v")), "list_transform(v, lambda x: (x - list_avg(v)) / list_stddev_pop(v))")
vector("V10_scale", lambda: F.concat(V.scale_minmax(c("v"), 0, 2), V.scale_by(c("v"), 4.0)), "list_concat(list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v)) * 2), list_transform(v, lambda x: x / 4))")
vector("V16_fuse_modalities", lambda: V.fuse(c("v"), V.pool_first(c("m")), F.array(c("vec_id").cast("double"))), "list_concat(list_concat(v, m[1]), [CAST(vec_id AS DOUBLE)])")

STATS = "st AS (SELECT dim, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS sd FROM (SELECT unnest(r) AS x, generate_subscripts(r, 1) AS dim FROM (SELECT m[g % 8 + 1] AS r FROM (SELECT DISTINCT j * (n - 1) // (n // 4 - 1) AS g FROM (SELECT count(*) * 8 AS n FROM q WHERE vec_id % 5 < 4), LATERAL (SELECT unnest(range(n // 4)) AS j)) JOIN (SELECT m, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM q WHERE vec_id % 5 < 4) ON place = g // 8)) GROUP BY 1)"


@query("V7_fit_standardizer", f"{EMB}, {STATS} SELECT dim - 1 AS dim, round(mean, 6) AS mean, round(sd, 6) AS std FROM st")
def v7(spark, d):
    model = T.fit_standardizer(emb(spark, d).filter("vec_id % 5 < 4"), "m", "vec_id")
    return rounded(model.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")).select(c("dim").cast("long").alias("dim"), "s.mean", "s.std"), "mean", "std")


@query("V8_apply_standardizer", f"{EMB}, {STATS}, o AS (SELECT list(mean ORDER BY dim) AS mu, list(sd ORDER BY dim) AS sd FROM st) SELECT vec_id, {sql_text('list_transform(range(1, 65), lambda i: (v[i] - mu[(i - 1) % 8 + 1]) / sd[(i - 1) % 8 + 1])')} AS out FROM q, o")
def v8(spark, d):
    rows = emb(spark, d)
    done = T.apply_standardizer(rows, T.fit_standardizer(rows.filter("vec_id % 5 < 4"), "m", "vec_id"), "m")
    return done.select("vec_id", text(F.flatten("m")).alias("out"))


@query("V11_corpus_mean_std", f"{EMB} SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(v) AS x FROM e WHERE vec_id % 2 = 0)")
def v11(spark, d):
    return rounded(T.corpus_mean_std(emb(spark, d), "embedding", c("vec_id")), "mean", "std")


@query("V12_mean_of_means", f"{EMB} SELECT label, round(avg(list_avg(v)), 6) AS mean FROM e GROUP BY 1")
def v12(spark, d):
    return rounded(T.mean_of_means(emb(spark, d), "embedding", ["label"]), "mean")


@query("V13_join_split_features", "SELECT vec_id, label, CASE WHEN vec_id % 10 < 7 THEN 'train' ELSE 'test' END AS set_name FROM embeddings WHERE vec_id % 3 > 0")
def v13(spark, d):
    rows = emb(spark, d).select("vec_id", "label")
    split = rows.filter("vec_id % 3 > 0").select("vec_id", F.when(c("vec_id") % 10 < 7, "train").otherwise("test").alias("set_name"))
    return T.join_split_features(split, rows, "vec_id")


@query("V14_repair_keys", f"{ANN} SELECT speaker || '_' || utt_id AS k, text FROM ann UNION ALL SELECT CASE speaker WHEN 'A' THEN 'B' ELSE 'A' END || '_' || utt_id, text FROM ann WHERE pos = 2")
def v14(spark, d):
    rows = ann(spark, d).select(F.concat_ws("_", "speaker", "utt_id").alias("k"), "text", "pos", "speaker", "utt_id")
    fixes = rows.filter("pos = 2").select(c("k").alias("wrong"), F.concat_ws("_", F.when(c("speaker") == "A", "B").otherwise("A"), "utt_id").alias("right"))
    return T.repair_keys(rows.select("k", "text"), fixes, "k")


def packs(spark, d):
    rows = conv(spark, d).withColumn("k", F.concat_ws("_", "dialog_id", "pos"))
    return T.pack_dialogs(rows.select("dialog_id", "pos", "speaker", "k"), rows.select("k", F.length("text").alias("n")), "k", ["n"])


CONV = with_sql("conv")
PACK = f"{CONV}, p AS (SELECT dialog_id, list(CAST(pos AS STRING) || ':' || speaker || ':' || CAST(length(text) AS STRING) ORDER BY pos) AS t FROM conv GROUP BY 1)"


def turns_text(turns="turns"):
    return F.array_join(F.transform(turns, lambda t: F.concat_ws(":", t["pos"].cast("string"), t["speaker"], t["n"].cast("string"))), " ")


@query("V15_pack_dialogs", f"{PACK} SELECT dialog_id, array_to_string(t, ' ') AS turns FROM p")
def v15(spark, d):
    return packs(spark, d).select("dialog_id", turns_text().alias("turns"))


@query("V17_fused_dims", "SELECT user_id, 'A' AS modality, CASE user_id % 2 WHEN 0 THEN 1582 ELSE 1024 END AS dim, CAST(CASE user_id % 2 WHEN 0 THEN 1582 ELSE 1024 END + 768 AS BIGINT) AS total FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT user_id, 'L', 768, CAST(CASE user_id % 2 WHEN 0 THEN 1582 ELSE 1024 END + 768 AS BIGINT) FROM (SELECT DISTINCT user_id FROM events)")
def v17(spark, d):
    names = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().withColumn("name", F.expr("IF(user_id % 2 = 0, 'AIS10-Lbert', 'Awav2vec-Lbert')"))
    dims = names.withColumn("dims", V.fused_dims(c("name"), {"IS10": 1582, "wav2vec": 1024, "bert": 768}))
    sums = F.aggregate(F.map_values("dims"), F.lit(0).cast("long"), lambda a, x: a + x)
    return dims.select("user_id", F.explode("dims").alias("modality", "dim"), sums.alias("total"))


V18_SQL = f"""{CONV}, p AS (
  SELECT dialog_id, count(*) AS n, list({{'label': pos % 7, 'tokens': list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:MOST]}} ORDER BY pos) AS t
  FROM conv GROUP BY 1),
b AS (SELECT *, (row_number() OVER (ORDER BY dialog_id) - 1) // 7 AS batch FROM p),
l AS (SELECT *, max(n) OVER w AS longest, max(list_max(list_transform(t, lambda x: len(x.tokens)))) OVER w AS width, count(*) OVER w AS k FROM b WINDOW w AS (PARTITION BY batch))
SELECT dialog_id, batch, longest, array_to_string(list_transform(range(longest), lambda i: CASE WHEN i < n THEN '1' ELSE '0' END), '') AS mask,
  array_to_string(list_transform(range(longest), lambda i: CAST(CASE WHEN i < n THEN t[i + 1].label ELSE -1 END AS VARCHAR)), ' ') AS labels,
  array_to_string(list_transform(range(longest), lambda i: CASE WHEN i < n THEN 'f' ELSE 't' END), '') AS padded,
  array_to_string(list_transform(range(longest), lambda i: array_to_string(CASE WHEN i < n
    THEN list_concat(t[i + 1].tokens, list_transform(range(width - len(t[i + 1].tokens)), lambda j: '_')) ELSE list_transform(range(width), lambda j: '_') END, ' ')), '|') AS tokens
FROM l WHERE k = 7""".replace("MOST", "9")


@query("V18_batch_and_pad", V18_SQL)
def v18(spark, d):
    tokens = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = conv(spark, d).withColumns({"k": F.concat_ws("_", "dialog_id", "pos"), "label": (c("pos") % 7).cast("long"), "tokens": tokens})
    dialogs = T.pack_dialogs(rows.select("dialog_id", "pos", "speaker", "k"), rows.select("k", "label", "tokens"), "k", ["label", "tokens"])
    pad = F.struct(F.lit(None).cast("long").alias("pos"), F.lit("").alias("k"), F.lit("").alias("speaker"), F.lit(-1).cast("long").alias("label"), F.array().cast("array<string>").alias("tokens"))
    done = T.batch_and_pad(dialogs, "turns", "dialog_id", 7, pad, drop_last=True, tokens="tokens", max_tokens=9, filler=F.lit("_"))
    line = lambda f: F.transform("turns", f)
    return done.select(
        "dialog_id", "batch", c("longest").cast("long").alias("longest"), F.array_join(c("mask").cast("array<string>"), "").alias("mask"), F.array_join(line(lambda t: t["label"].cast("string")), " ").alias("labels"),
        F.array_join(F.transform("padded", lambda x: F.when(x, "t").otherwise("f")), "").alias("padded"), F.array_join(line(lambda t: F.array_join(t["tokens"], " ")), "|").alias("tokens"),
    )


@query("V19_length_mask", f"{PACK} SELECT dialog_id, len(t) AS n FROM p")
def v19(spark, d):
    mask = V.length_mask(c("turns"))
    return packs(spark, d).select("dialog_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))


@query("V20_chunk_rows", f"{CONV} SELECT dialog_id, chunk, array_to_string(list(pos ORDER BY pos), ',') AS rows FROM (SELECT dialog_id, pos, (row_number() OVER (PARTITION BY dialog_id ORDER BY pos) - 1) // 3 AS chunk FROM conv) GROUP BY 1, 2")
def v20(spark, d):
    got = T.chunk_rows(conv(spark, d), ["dialog_id"], "pos", 3)
    return got.withColumn("rows", F.array_join(F.transform("rows", lambda r: r["pos"].cast("string")), ","))


@query("V21_drop_missing_keys", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn >= 5)")
def v21(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    return T.drop_missing_keys(rows.select("conv_id").distinct(), rows.filter("turn >= 5"), "conv_id")


@query("V22_shuffle_rows", "SELECT vec_id, label, row_number() OVER (ORDER BY md5('3:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place FROM embeddings")
def v22(spark, d):
    return T.shuffle_rows(emb(spark, d).select("vec_id", "label"), "vec_id", 3)


# frames and faces: utterance u of a dialog covers frames 7u to 7u + 8

UTTS = "utts AS (SELECT dialog, u AS utt, CASE WHEN u % 2 = 0 THEN 'A' ELSE 'B' END AS speaker, u AS pos, u * 7 AS f0, u * 7 + 8 AS f1 FROM (SELECT DISTINCT dialog, CAST((frame - frame % 7) / 7 AS BIGINT) AS u FROM faces) x)"
F_UTTS = f"{FACES}, {UTTS}"
ASSIGNED = "asg AS (SELECT dialog, frame, utt, speaker FROM (SELECT *, row_number() OVER (PARTITION BY dialog, frame ORDER BY seen DESC, f0 DESC, utt DESC) AS k FROM (SELECT *, unnest(range(f0, f1 + 1)) AS frame FROM (SELECT *, min(pos) OVER (PARTITION BY dialog, speaker) AS seen FROM utts))) WHERE k = 1)"
MATCHED = "mt AS (SELECT dialog, frame, max(face_idx) AS face_idx FROM faces WHERE tracked AND score > 0 GROUP BY 1, 2)"
F_ALL = f"{F_UTTS}, {ASSIGNED}, {MATCHED}"


def face_rows(spark, d):
    return fixture(spark, d, "faces").withColumn("emb", c("embedding"))


def utterances(spark, d):
    rows = face_rows(spark, d).select("dialog", F.floor(c("frame") / 7).alias("utt")).distinct()
    return rows.select("dialog", "utt", F.when(c("utt") % 2 == 0, "A").otherwise("B").alias("speaker"), c("utt").alias("pos"), (c("utt") * 7).alias("f0"), (c("utt") * 7 + 8).alias("f1"))


def detections(spark, d):
    box = F.array(*[x.cast("double") + 0.4 for x in (c("x1"), c("x1"), c("x2"), c("x2"))])
    return face_rows(spark, d).select("dialog", "frame", "face_idx", "vec_id", box.alias("bbox"), "score", "tracked")


def matches(spark, d):
    found = detections(spark, d)
    tracks = found.filter("tracked").select("dialog", "frame", F.transform("bbox", lambda x: x + 0.3).alias("bbox"), c("vec_id").alias("crop_id"), "score")
    return X.match_tracks(found, tracks)


def assigned(spark, d):
    """Of the frames that have faces."""
    return X.assign_frames(utterances(spark, d), face_rows(spark, d))


def active(spark, d):
    return X.active_faces_by_speaker(matches(spark, d), assigned(spark, d))


def anchors(spark, d, faces=None):
    return X.pick_anchors(active(spark, d) if faces is None else faces).join(face_rows(spark, d).select("dialog", "frame", "face_idx", "emb"), ["dialog", "frame", "face_idx"])


@query("F1_speaker_timeline", f"{F_UTTS} SELECT dialog, speaker, array_to_string(list(CAST(f0 AS STRING) || '-' || CAST(f1 AS STRING) || '-' || CAST(utt AS STRING) ORDER BY f0, f1, utt), ' ') AS intervals FROM utts GROUP BY 1, 2")
def f1(spark, d):
    line = F.array_join(F.transform("intervals", lambda i: F.concat_ws("-", *[i[x].cast("string") for x in ("f0", "f1", "utt")])), " ")
    return X.speaker_timeline(utterances(spark, d)).select("dialog", "speaker", line.alias("intervals"))


@query("F2_interval_frames", f"{F_UTTS} SELECT dialog, utt, unnest(range(f0, f1 + 1)) AS frame FROM utts")
def f2(spark, d):
    return X.interval_frames(utterances(spark, d)).select("dialog", "utt", "frame")


@query("F3_assign_frames", f"{F_UTTS}, {ASSIGNED} SELECT * FROM asg")
def f3(spark, d):
    return X.assign_frames(utterances(spark, d))


@query("F4_match_tracks", f"{FACES}, {MATCHED} SELECT * FROM mt")
def f4(spark, d):
    return matches(spark, d)


ACTIVE = "act AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY dialog, speaker) AS n FROM mt JOIN asg USING (dialog, frame)) WHERE n >= 10)"
ANCHORS = "anc AS (SELECT a.*, e.v FROM (SELECT *, row_number() OVER (PARTITION BY dialog, speaker ORDER BY frame, face_idx) - 1 AS i, CASE WHEN n > 300 THEN n // 3 WHEN n > 100 THEN n // 2 ELSE n END AS k FROM act) a JOIN (SELECT dialog, frame, face_idx, CAST(embedding AS DOUBLE[]) AS v FROM faces) e USING (dialog, frame, face_idx) WHERE k = n OR list_contains(list_transform(range(k), lambda j: j * (n - 1) // (k - 1)), i))"


@query("F5_active_faces_by_speaker", f"{F_ALL}, {ACTIVE} SELECT dialog, frame, face_idx, speaker, n FROM act")
def f5(spark, d):
    return active(spark, d).select("dialog", "frame", "face_idx", "speaker", "n")


@query("F6_pick_anchors", f"{F_ALL}, {ACTIVE}, {ANCHORS} SELECT dialog, speaker, frame, face_idx FROM anc")
def f6(spark, d):
    return anchors(spark, d).select("dialog", "speaker", "frame", "face_idx")


@query("F7_cosine_euclidean", f"{EMB} SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cos, round(list_distance(a.v, b.v), 6) AS dist FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def f7(spark, d):
    rows = emb(spark, d)
    pairs = rows.select("vec_id", "v").join(rows.select((c("vec_id") - 1).alias("vec_id"), c("v").alias("w")), "vec_id")
    return pairs.select("vec_id", F.round(V.cosine(c("v"), c("w")), 6).alias("cos"), F.round(V.euclidean(c("v"), c("w")), 6).alias("dist"))


SIMS = f"{F_ALL}, {ACTIVE}, {ANCHORS}, sims AS (SELECT f.dialog, f.frame, f.face_idx, anc.speaker, avg(list_cosine_similarity(CAST(f.embedding AS DOUBLE[]), anc.v)) AS sim FROM faces f JOIN anc ON f.dialog = anc.dialog GROUP BY 1, 2, 3, 4)"


def sims(spark, d):
    return X.mean_similarity(face_rows(spark, d), anchors(spark, d))


@query("F8_mean_similarity", f"{SIMS} SELECT dialog, frame, face_idx, speaker, round(sim, 6) AS sim FROM sims")
def f8(spark, d):
    return rounded(sims(spark, d), "sim")


@query("F9_best_worst_match", f"{SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY dialog, frame, speaker ORDER BY round(sim, 9) DESC, face_idx) AS b, row_number() OVER (PARTITION BY dialog, frame, speaker ORDER BY round(sim, 9), face_idx) AS w FROM sims) SELECT dialog, frame, speaker, max(face_idx) FILTER (WHERE b = 1) AS best, max(face_idx) FILTER (WHERE w = 1) AS worst FROM r GROUP BY 1, 2, 3")
def f9(spark, d):
    return X.best_match(sims(spark, d), F.round("sim", 9))


def links(spark, d):
    met, frames = cut(matches(spark, d)), cut(assigned(spark, d))
    return X.link_faces(face_rows(spark, d), met, frames, anchors(spark, d, X.active_faces_by_speaker(met, frames)))


LINKS = f"""{SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY dialog, frame, speaker ORDER BY round(sim, 9) DESC, face_idx) AS b, row_number() OVER (PARTITION BY dialog, frame, speaker ORDER BY round(sim, 9), face_idx) AS w FROM sims),
fr AS (SELECT faces.dialog, faces.frame, utt, speaker, count(*) AS n, list_sort(list(face_idx)) AS ids FROM faces JOIN asg ON faces.dialog = asg.dialog AND faces.frame = asg.frame GROUP BY 1, 2, 3, 4),
us AS (SELECT dialog, utt, min(face_idx) AS usual FROM mt JOIN asg USING (dialog, frame) GROUP BY 1, 2 HAVING min(face_idx) = max(face_idx)),
lk AS (SELECT fr.dialog, fr.frame, fr.utt, fr.speaker, CASE WHEN fr.n = 1 THEN ids[1] WHEN mt.face_idx IS NOT NULL THEN mt.face_idx WHEN s.sim IS NOT NULL THEN CASE WHEN s.sim > 0.6 THEN usual ELSE coalesce(list_filter(ids, lambda i: i <> usual)[1], usual) END WHEN o.face_idx IS NOT NULL THEN o.face_idx WHEN w.face_idx IS NOT NULL THEN w.face_idx ELSE ids[CAST('0x' || md5('0:' || CAST(fr.dialog AS STRING) || ':' || CAST(fr.frame AS STRING))[1:8] AS BIGINT) % len(ids) + 1] END AS face_idx,
CASE WHEN fr.n = 1 THEN 'single' WHEN mt.face_idx IS NOT NULL THEN 'active' WHEN s.sim IS NOT NULL THEN 'same_utterance' WHEN o.face_idx IS NOT NULL THEN 'own' WHEN w.face_idx IS NOT NULL THEN 'other' ELSE 'random' END AS "case"
FROM fr LEFT JOIN mt ON fr.dialog = mt.dialog AND fr.frame = mt.frame LEFT JOIN us ON fr.dialog = us.dialog AND fr.utt = us.utt
LEFT JOIN sims s ON s.dialog = fr.dialog AND s.frame = fr.frame AND s.speaker = fr.speaker AND s.face_idx = us.usual
LEFT JOIN r o ON o.dialog = fr.dialog AND o.frame = fr.frame AND o.speaker = fr.speaker AND o.b = 1 LEFT JOIN r w ON w.dialog = fr.dialog AND w.frame = fr.frame AND w.speaker <> fr.speaker AND w.w = 1)"""


@query("F10_link_faces", f"{LINKS} SELECT dialog, frame, utt, speaker, \"case\", face_idx FROM lk")
def f10(spark, d):
    return links(spark, d)


@query("F11_link_case_counts", f"{LINKS} SELECT \"case\", count(*) AS n FROM lk GROUP BY 1")
def f11(spark, d):
    return X.link_case_counts(links(spark, d))


@query("F12_utterance_faces", f"{LINKS} SELECT dialog, utt, coalesce(n, 0) AS n, first_frame FROM utts LEFT JOIN (SELECT dialog, utt, count(*) AS n, min(frame) AS first_frame FROM lk GROUP BY 1, 2) x USING (dialog, utt)")
def f12(spark, d):
    return X.utterance_faces(links(spark, d), utterances(spark, d)).select("dialog", "utt", F.size("faces").cast("long").alias("n"), F.get("faces", F.lit(0))["frame"].alias("first_frame"))


@query("F13_clamp_boxes", f"{FACES} SELECT vec_id, CAST(greatest(x1, 0) AS STRING) || ',' || CAST(greatest(x2, 0) AS STRING) AS box FROM faces")
def f13(spark, d):
    return X.clamp_boxes(detections(spark, d)).select("vec_id", F.concat_ws(",", c("bbox")[0].cast("string"), c("bbox")[2].cast("string")).alias("box"))


@query("F14_face_density", f"{F_UTTS}, {ASSIGNED} SELECT dialog, count(DISTINCT frame) AS n_frames, count(*) AS n_faces, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM asg WHERE asg.dialog = faces.dialog AND asg.frame = faces.frame)) AS n_in_utterances FROM faces GROUP BY 1")
def f14(spark, d):
    return X.face_density(detections(spark, d), assigned(spark, d))


@query("F15_cluster_kmeans")
def f15(spark, d):
    return ml.cluster_kmeans(emb(spark, d).select("vec_id", "label", "embedding"), "embedding", 4).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


EPS, MIN_SAMPLES = 7.5, 4
DBSCAN = f"""WITH RECURSIVE pts AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), np AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM pts a JOIN pts b ON a.label = b.label AND list_distance(a.v, b.v) <= {EPS}),
core AS (SELECT a FROM np GROUP BY 1 HAVING count(*) >= {MIN_SAMPLES}), cl AS (SELECT a, b FROM np WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach AS (SELECT a, a AS b FROM core UNION SELECT reach.a, cl.b FROM reach JOIN cl ON reach.b = cl.a), lab AS (SELECT a, min(b) AS l FROM reach GROUP BY 1)"""


def dbscan(spark, d):
    return X.cluster_dbscan(emb(spark, d), "vec_id", "embedding", "label", EPS, MIN_SAMPLES)


@query("F16_cluster_dbscan", f"{DBSCAN} SELECT pts.label, vec_id, coalesce((SELECT l FROM lab WHERE a = vec_id), (SELECT min(l) FROM np JOIN lab ON np.b = lab.a WHERE np.a = vec_id), -1) AS cluster FROM pts")
def f16(spark, d):
    return dbscan(spark, d)


@query("F17_cluster_label_table", "SELECT label % 3 AS cluster, count(*) FILTER (WHERE vec_id % 10 = 0) AS suffix_0, count(*) FILTER (WHERE vec_id % 10 <> 0) AS others FROM embeddings GROUP BY 1")
def f17(spark, d):
    return X.cluster_label_table(emb(spark, d).withColumn("cluster", c("label") % 3), c("vec_id").cast("string").endswith("0"))

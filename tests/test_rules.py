"""Hand-written cases of rules that are easy to get wrong."""

import time

import pytest
from pyspark.sql import functions as F

from convspark.functions import keys as K
from convspark.functions import vectors as V
from convspark.operators import agreement, annotation, context, corpus, evaluation, faces, features, quality, split
from convspark.sources import files


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(
    ("p1", "p2", "p3", "multi", "main"),
    [
        (["X"], ["Y"], ["Z"], ["NotSure"], "NotSure"),
        (["X", "Y"], ["X"], ["Y", "X"], ["X", "Y"], "X"),
        (["X", "Y", "Z"], ["X", "Y", "Z"], ["Y", "Z"], ["Y", "Z"], "X"),
        (["X"], ["X"], ["Y"], ["X"], "X"),
        (["X", "Y"], ["Y", "X"], ["Z"], ["X", "Y"], "X"),
        (["X", "Y"], ["X", "Y"], ["Z"], ["X", "Y"], "X"),
        (["X", "X", "X", "X"], ["Y"], ["Z"], ["X"], "X"),
    ],
)
def test_vote(spark, p1, p2, p3, multi, main):
    row = one(annotation.vote_labels(spark.createDataFrame([(p1, p2, p3)], "p1 array<string>, p2 array<string>, p3 array<string>")))
    assert (row.multi, row.main) == (multi, main)


def utts(spark, speakers, labels, dialog="m0_1", movie="m0"):
    return spark.createDataFrame([(movie, dialog, i + 1, s, x) for i, (s, x) in enumerate(zip(speakers, labels, strict=True))], "movie string, dialog_id string, pos long, speaker string, main string")


def test_turns_and_transitions(spark):
    df = utts(spark, "AABBAA", ["a", "b", "b", "c", "c", "d"])
    assert [(r.turn_no, r.pos_in_turn) for r in annotation.segment_turns(df).orderBy("pos").collect()] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert [(r.from_label, r.to_label) for r in corpus.turn_transitions(df).orderBy("pos").collect()] == [("a", "b"), ("b", "c")]
    assert [r.to_label for r in corpus.within_turn_transitions(df).orderBy("pos").collect()] == ["b", "c"]
    assert corpus.within_turn_transitions(df, include_last_turn=True).count() == 3
    # a dialog that B opens has an empty first turn of A
    assert one(annotation.dialog_turn_counts(utts(spark, "BB", "ab"))).n_turns == 2


def test_smoothing_crosses_dialogs_and_does_not_cascade(spark):
    first = utts(spark, "AA", ["Other", "Sad"], "m0_1")
    second = utts(spark, "AAA", ["NotSure", "NotSure", "Happy"], "m0_2")
    got = annotation.smooth_uncertain(first.union(second)).orderBy("dialog_id", "pos").collect()
    assert [r.smoothed for r in got] == ["Sad", "Sad", "Sad", "NotSure", "Happy"]


@pytest.mark.parametrize(("n", "k"), [(99, 99), (101, 50), (300, 150), (301, 100)])
def test_anchor_counts(spark, n, k):
    df = spark.range(n).select(F.lit(1).alias("dialog"), F.lit("A").alias("speaker"), F.col("id").alias("frame"), F.lit(0).alias("face_idx"))
    got = sorted(r.frame for r in faces.pick_anchors(df).collect())
    want = sorted({j * (n - 1) // (k - 1) for j in range(k)}) if k < n else list(range(n))
    assert got == want and got[0] == 0 and got[-1] == n - 1


def test_index_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 4, 2, 3)], "n long")
    row = one(corpus.length_stats(df, "n"))
    assert (row.mean, row.p50, row.p80, row.p95) == (3, 3, 5, 5)


def test_kappa_of_equal_raters(spark):
    rows = [(f"u{i}", [x], [x], [x]) for i, x in enumerate("aabbc")]
    df = spark.createDataFrame(rows, "utt_id string, p1 array<string>, p2 array<string>, p3 array<string>")
    assert one(agreement.fleiss_kappa(df)).kappa == pytest.approx(1)
    assert {r.kappa for r in agreement.cohen_kappa_pairs(annotation.vote_labels(df)).collect()} == {1.0}
    assert one(agreement.fleiss_kappa(df.filter("p1[0] = 'a'"))).kappa is None


def test_metrics_of_masked_classes(spark):
    df = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (2, 3, 0)], "label int, pred int, mask int")
    got = one(evaluation.summary_scores(evaluation.confusion_matrix(df, weight=F.col("mask"))))
    assert (got.wa, got.uar, got.macro_f1) == (1, 0.5, 0.5)  # classes of weight 0 still count
    assert one(evaluation.accuracy(evaluation.confusion_matrix(df))).wa == pytest.approx(2 / 3)


def test_names_and_times(spark):
    df = spark.createDataFrame([("01:02:03:24", "00:00:01,999", "Li；Bo，Wu(x)")], "tc string, srt string, names string")
    got = one(df.select(K.tc_seconds(F.col("tc")).alias("a"), K.tc_frame(F.col("tc")).alias("b"), K.srt_to_tc(F.col("srt"), False).alias("c"), K.srt_to_tc(F.col("srt"), True).alias("d"), K.alias_list(F.lit("Q"), F.col("names")).alias("e")))
    assert (got.a, got.b, got.c, got.d, got.e) == (123.96, 3099, "00:00:01:25", "00:00:01:24", ["Q", "Li；Bo", "Wu"])


def test_vectors(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [5.0, 9.0]],)], "m array<array<double>>")
    got = one(df.select(V.pool_mean(F.col("m")).alias("a"), V.pool_mean(F.col("m"), True).alias("b"), V.downsample_mean(F.col("m"), 2).alias("c"), V.scale_minmax(F.array(F.lit(2.0), F.lit(2.0))).alias("d"), V.pool_first(F.filter("m", lambda x: F.lit(False))).alias("e")))
    assert (got.a, got.b, got.c, got.d, got.e) == ([3, 5], [3, 4], [[2, 3], [5, 9]], [0, 0], None)
    # of the four steps of two matrices end to end every second one: places 0 and 3
    pair = spark.createDataFrame([(2, [[5.0, 9.0]]), (1, [[1.0, 2.0], [3.0, 4.0], [7.0, 0.0]])], "k long, m array<array<double>>")
    model = one(features.fit_standardizer(pair, "m", "k", 2))
    assert (model["mean"], model["std"]) == ([3, 5.5], [2, 3.5])


def test_split_sizes_and_checks(spark):
    movies = spark.range(56).select(F.concat(F.lit("m"), "id").alias("movie"))
    sizes = {r.set_name: r["count"] for r in split.group_split(movies, {"train": 38, "val": 7, "test": 11}, 1).groupBy("set_name").count().collect()}
    assert sizes == {"train": 38, "val": 7, "test": 11}
    df = utts(spark, "AB", "ab").union(utts(spark, "A", "a", "m0_2")).union(utts(spark, "A", "a").withColumn("pos", F.lit(9).cast("long")))
    assert [r.dialog_id for r in quality.check_contiguous_dialogs(df.withColumn("o", F.monotonically_increasing_id()), "movie", "o").collect()] == ["m0_1"]


def test_edges(spark):
    df = utts(spark, "ABA", "abc")
    got = {(r.src, r.dst) for r in context.window_edges(df, 1, 0).collect()}
    assert got == {(1, 1), (2, 1), (2, 2), (3, 2), (3, 3)}
    assert context.window_edges(df, -1, -1).count() == 9


def test_subtitle_files(spark, tmp_path):
    (tmp_path / "film_2.srt").write_text("1\n00:00:01,000 --> 00:00:02,010\nHello\n\n\n00:00:03,000 --> 00:00:04,000\nno index\n\n2\n00:00:05,000 --> 00:00:06,000\nBye\n\n")
    got = files.annotation_template(files.parse_subtitles(spark, str(tmp_path))).collect()
    assert [(r.utt_id, r.start_tc, r.end_tc, r.text) for r in got] == [("film_2_1", "00:00:01:00", "00:00:02:01", "Hello"), ("film_2_2", "00:00:05:00", "00:00:06:00", "Bye")]


def test_row_values_are_computed_once(spark):
    """A row's mean, deviation, ends and length are not computed for each entry: 20,000 entries would take their square or cube."""
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda x: x.cast("double")).alias("v"))
    sums = [V.total(V.zscore(F.col("v"))), V.total(V.scale_minmax(F.col("v")))]
    began = time.monotonic()
    z, s, u = df.select(*sums, V.norm(V.unit(F.col("v")))).first()
    assert time.monotonic() - began < 60
    assert z == pytest.approx(0, abs=1e-6) and s == pytest.approx(10_000) and u == pytest.approx(1)
    odd = df.select(V.zscore(F.lit(None).cast("array<double>")).alias("a"), V.zscore(F.array(F.lit(2.0), F.lit(2.0))).alias("b"), V.zscore(F.array().cast("array<double>")).alias("c"), V.unit(F.array(F.lit(0.0))).alias("d")).first()
    assert odd.a is None and odd.b == [0.0, 0.0] and odd.c == [] and odd.d is None

"""Order over whole movies and dialogs without a task that sees them: neighbours, edges and their counts."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convspark.operators import annotation, context, evaluation, features, quality
from convspark.operators.numbering import with_neighbours


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_one_large_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 1900, "a").when(F.col("id") < 1901, "b").alias("g"), (F.col("id") * 7 % 2003).alias("k"), F.col("id").alias("v")).repartition(7)
    w = Window.partitionBy("g").orderBy("k")
    want = df.select("v", F.lag("v").over(w).alias("x"), F.lead("v").over(w).alias("y"))
    got = with_neighbours(df, "g", ["k"], ["v"]).select("v", F.col("before.v").alias("x"), F.col("after.v").alias("y"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def movie(spark, n=300):
    draw = random.Random(4)
    rows = [("m0", f"d{k // 9:03d}", k % 9, draw.choice("AB"), draw.choice(["NotSure", "Other", "Sad", "Happy"]), k) for k in range(n)]
    return spark.createDataFrame(rows, "movie string, dialog_id string, pos long, speaker string, main string, line long").repartition(5)


def test_smoothing_of_one_movie(spark):
    df = movie(spark)
    rows = sorted(df.collect(), key=lambda r: (r.dialog_id, r.pos))
    want = {}
    for k, r in enumerate(rows):
        mate = rows[k - 1] if k else rows[1]
        takes = r.main in ("NotSure", "Other") and mate.speaker == r.speaker and mate.main not in ("NotSure", "Other")
        want[r.line] = mate.main if takes else r.main
    smoothed = annotation.smooth_uncertain(df)
    assert {r.line: r.smoothed for r in smoothed.collect()} == want
    assert "movie" not in "".join(x for x in plan(smoothed).split("\n") if "Window [" in x and "_range" not in x)
    assert annotation.smooth_uncertain(df.limit(1)).count() == 1 and annotation.smooth_uncertain(df.limit(0)).count() == 0


def test_dialogs_in_pieces_of_one_movie(spark):
    df = movie(spark).withColumn("dialog_id", F.when(F.col("line") == 200, "d001").otherwise(F.col("dialog_id")))
    found = quality.check_contiguous_dialogs(df, "movie", "line")
    assert sorted(map(tuple, found.collect())) == [("d001", 2), ("d022", 2)]


def dialogs(spark):
    draw = random.Random(5)
    rows = [("d0", k, draw.choice(["A", "B", None])) for k in range(40)] + [("d1", 3, "A"), ("d1", 3, "B"), ("d1", 900, "A"), ("d2", 5, None)]
    return spark.createDataFrame(rows, "dialog_id string, pos long, speaker string")


@pytest.mark.parametrize(("past", "future"), [(2, 1), (0, 0), (-1, -1), (1, -1), (-1, 0), (700, 0), (-1, 500)])
def test_edges_and_their_counts(spark, monkeypatch, past, future):
    monkeypatch.setattr(context, "BLOCK", 16)
    rows = dialogs(spark).collect()
    want = sorted((a.dialog_id, a.pos, b.pos, str(a.speaker), str(b.speaker)) for a in rows for b in rows if a.dialog_id == b.dialog_id and (past < 0 or b.pos >= a.pos - past) and (future < 0 or b.pos <= a.pos + future))
    got = context.window_edges(dialogs(spark), past, future)
    assert sorted((r.dialog_id, r.src, r.dst, str(r.src_speaker), str(r.dst_speaker)) for r in got.collect()) == want
    counts = context.edge_counts(dialogs(spark), past, future)
    assert {r.dialog_id: r.n_edges for r in counts.collect()} == {d: sum(w[0] == d for w in want) for d in ("d0", "d1", "d2")}
    assert "Join" not in plan(counts)


def test_pair_counts(spark):
    df = dialogs(spark)
    got = context.context_pair_counts(df)
    assert {r.mode: r.n for r in got.collect()} == {m: context.context_pairs(df, m).count() for m in ("global", "intra", "inter", "local")}
    assert "Join" not in plan(got)
    assert {r.n for r in context.context_pair_counts(df.limit(0)).collect()} == {0}


def test_report_averages(spark):
    df = spark.createDataFrame([(0, 0, 4), (0, 1, 2), (1, 1, 3), (2, 1, 1)], "label int, pred int, n long")
    got = {r["class"]: r for r in evaluation.report_with_averages(df).collect()}
    assert set(got) == {"0", "1", "2", "macro", "weighted", "micro"}
    assert got["micro"].f1 == pytest.approx(0.7) and got["micro"].support == 10
    assert got["macro"].recall == pytest.approx((4 / 6 + 1 + 0) / 3)
    assert got["weighted"].precision == pytest.approx((6 * 1 + 3 * 0.5 + 0) / 10)


def test_shuffled_places(spark):
    df = spark.range(500).withColumn("label", F.col("id") % 3)
    a, b = (sorted((r.place, r.id, r.label) for r in features.shuffle_rows(df.repartition(k), "id", 3).collect()) for k in (3, 5))
    assert a == b and [r[0] for r in a] == list(range(500)) and [r[1] for r in a] != list(range(500))
    assert all(r[1] % 3 == r[2] for r in a)

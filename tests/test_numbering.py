"""Running sums by ranges, evenly spaced steps, checks with nulls."""

import random

from pyspark.sql import functions as F

from convspark.operators import features, quality
from convspark.operators.numbering import with_sum_before


def test_sum_before(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(5)) for k in rng.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "k long, n long").repartition(7)
    want, total = {}, 0
    for k, n in sorted(rows):
        want[k] = total
        total += n
    assert {r.k: r.s for r in with_sum_before(df, [F.asc("k")], F.col("n"), "s").collect()} == want
    assert with_sum_before(df.limit(0), [F.asc("k")], F.col("n"), "s").count() == 0
    first = with_sum_before(df, [F.desc("n"), F.asc("k")], F.lit(1), "s").orderBy("s").collect()
    assert [(r.k, r.s) for r in first] == [(k, at) for at, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]


def test_standardizer_steps(spark):
    """One step in four of all matrices joined end to end, evenly spaced with both ends."""
    rng = random.Random(2)
    for sizes in ([3, 1, 9, 0, 7, 21], [1, 2], [4]):
        matrices = [(k, [[float(rng.randrange(50)), 1.0] for _ in range(n)]) for k, n in enumerate(sizes)]
        steps = [row for _, m in matrices for row in m]
        k = max(1, len(steps) // 4)
        chosen = [steps[j * (len(steps) - 1) // (k - 1)] for j in range(k)] if k > 1 else [steps[0]]
        got = features.fit_standardizer(spark.createDataFrame(matrices, "k long, m array<array<double>>"), "m", "k").first()
        mean = sum(r[0] for r in chosen) / k
        std = (sum((r[0] - mean) ** 2 for r in chosen) / k) ** 0.5
        assert abs(got.mean[0] - mean) < 1e-9 and abs(got.std[0] - (std or 1)) < 1e-9 and got.std[1] == 1


def test_nulls_fail_checks(spark):
    utts = spark.createDataFrame([("a", "A"), ("b", None), ("c", "C")], "utt_id string, speaker string")
    assert {r.utt_id for r in quality.check_speaker_domain(utts).collect()} == {"b", "c"}
    sheet = spark.createDataFrame([(["Happy", None, "x"],)], "labels array<string>")
    assert {r.label for r in quality.check_label_vocab(sheet).collect()} == {None, "x"}

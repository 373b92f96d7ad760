"""Whitening against its definition, and rows that have no vector."""

import numpy as np
import pytest

from convspark.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, whitened string"


def vectors(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims))
    return [(i, v.tolist(), "x") for i, v in enumerate(base)]


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], {})[r[0]] = r
    return out


@pytest.mark.parametrize("block", [1 << 19, 90])
def test_brute(spark, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    monkeypatch.setattr(whitening, "GROUP", 3)
    rows = vectors(120, 6)
    rows += [(1000 + i, rows[0][1], "copy") for i in range(60)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    want = by_component(whitening.brute([r[:2] for r in rows]))
    assert len(got) == 180 * 6
    for k, found in by_component(got).items():
        first = max(found, key=lambda i: abs(found[i].whitened))
        sign = np.sign(found[first].whitened * want[k][first][4])
        for i, r in found.items():
            assert (r.n, r.deviation) == want[k][i][2:4]
            assert r.whitened == pytest.approx(sign * want[k][i][4], abs=1e-9)
            assert r.explained == pytest.approx(want[k][i][5], rel=1e-9)
            assert r.identity_error < 1e-9


def test_rows_without_a_vector(spark):
    rows = [(1, None, ""), (2, [], ""), (3, [1.0, None], ""), (4, [float("nan"), 1.0], ""), (5, [1.0, float("inf")], ""), (6, [1.0], "")]
    rows += [(7, [1.0, 2.0], ""), (None, [1.5, 2.0], ""), (8, [1.0, 3.0], ""), (8, [1.0, 3.0], "")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (0, 2, 3), (7, 1, 3), (7, 2, 3), (8, 1, 3), (8, 1, 3), (8, 2, 3), (8, 2, 3)]


def test_without_variance(spark):
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)).collect()
    assert {tuple(r)[2:] for r in got} == {(1, 0, None, None, None)} and len(got) == 4
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [2.0, 2.0], "")], SCHEMA)).collect()
    assert [(r.component, r.whitened is None) for r in sorted(got, key=lambda r: (r.vec_id, r.component))] == [(1, False), (2, True)] * 2
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_deviations_beyond_64_bits(spark):
    got = whitening.whiten(spark.createDataFrame([(i, [1e300 * i, 0.0], "") for i in range(3)], SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} and all(np.isfinite(r.whitened) for r in got if r.component == 1)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = whitening.whiten(docs).collect()
    assert len(got) == 16 * docs.count()
    assert max(r.identity_error for r in got) < 1e-9

"""Density clusters against brute force, and dense cells without pairs."""

import random

import pytest

from convspark.operators import faces

SCHEMA = "label long, k long, v array<double>"


def brute(rows, eps, least):
    near = {k: [j for g2, j, w in rows if g2 == g and sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) ** 0.5 <= eps] for g, k, v in rows}
    core = {k for k, n in near.items() if len(n) >= least}
    root = {k: k for k in core}
    changed = True
    while changed:
        changed = False
        for k in core:
            low = min(root[j] for j in near[k] if j in core)
            changed |= low < root[k]
            root[k] = low
    return {k: root[k] if k in core else min((root[j] for j in near[k] if j in core), default=-1) for k in near}


def points(n, spread, seed, dims=2):
    draw = random.Random(seed)
    centres = [[draw.uniform(-4, 4) for _ in range(dims)] for _ in range(5)]
    rows = [(k % 2, k, [draw.gauss(c, spread) for c in draw.choice(centres)]) for k in range(n)]
    return rows + [(0, 1000 + k, rows[0][2]) for k in range(4)] + [(1, 2000, [99.0] * dims)]


@pytest.mark.parametrize(("spread", "eps", "dims"), [(0.5, 0.4, 2), (0.1, 0.6, 2), (1.5, 0.5, 2), (0.3, 0.7, 3), (0.05, 5.0, 3)])
def test_clusters(spark, spread, eps, dims):
    rows = points(150, spread, 3, dims)
    got = faces.cluster_dbscan(spark.createDataFrame(rows, SCHEMA), "k", "v", "label", eps, 4)
    assert {r.k: r.cluster for r in got.collect()} == brute(rows, eps, 4)


def test_dense_cell(spark):
    draw = random.Random(8)
    rows = [(0, k, [1.0, 1.0]) for k in range(10_000)] + [(0, 10_000 + k, [1 + draw.random() / 100, 1.0]) for k in range(3000)] + [(0, -5, [1.3, 1.0]), (0, -6, [9.0, 9.0])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = faces.cluster_dbscan(df, "k", "v", "label", 0.5, 5)
    found = {r.k: r.cluster for r in got.collect()}
    assert len(found) == len(rows) and {c for k, c in found.items() if k != -6} == {-5} and found[-6] == -1
    folded = df.selectExpr("label", "v AS _v").groupBy("label", "_v").count().selectExpr("label", "_v", "count AS w", "monotonically_increasing_id() AS p")
    pairs = faces.near_pairs(faces._indexed(folded.checkpoint(), "label", 0.5), "label", 0.5)
    assert pairs.count() <= 2 * folded.count() * 2


def test_no_points(spark):
    df = spark.createDataFrame([(0, 1, None)], SCHEMA)
    assert faces.cluster_dbscan(df, "k", "v", "label").count() == 0

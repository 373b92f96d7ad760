"""Repeated windows against their definition, and the index against counting."""

import random

import numpy as np
import pytest

from convspark.llm import substrings as s

SCHEMA = "doc_id long, text string, key string"


def texts(n=50, seed=7):
    draw = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["ÉTÉ", "W1", "a"]
    passages = [[draw.choice(words) for _ in range(draw.randrange(10, 40))] for _ in range(6)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            parts += draw.choice(passages) if draw.random() < 0.6 else [draw.choice(words) for _ in range(draw.randrange(1, 30))]
        out.append((n - i, draw.choice([" ", "\n", " \t "]).join(parts), "x"))
    same = out[3][1]
    periodic = [(200, "a b " * 40, ""), (201, "b a " * 30, ""), (202, "a " * 100, ""), (203, "a " * 14, ""), (199, "a " * 13, "")]
    return out + periodic + [(300, same, ""), (300, same, ""), (301, None, ""), (302, "", ""), (None, same, ""), (None, None, ""), (5, out[9][1] + " more", ""), (6, "w1 w2", "")]


@pytest.mark.parametrize("frequent,shard", [(2048, 1 << 20), (3, 60)])
def test_brute(spark, monkeypatch, frequent, shard):
    monkeypatch.setattr(s, "FREQUENT", frequent)
    monkeypatch.setattr(s, "SHARD", shard)
    monkeypatch.setattr(s, "FOLD", 100)
    rows = texts()
    got = [tuple(r) for r in s.kept_digest(s.without_repeated_windows(spark.createDataFrame(rows, SCHEMA))).collect()]
    want = s.brute([r[:2] for r in rows])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in want) > 300


def test_empty_table(spark):
    assert s.without_repeated_windows(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = s.kept_digest(s.without_repeated_windows(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    assert sorted(map(tuple, got)) == sorted(s.brute(rows))


def test_index_counts_runs():
    rng = np.random.default_rng(1)
    for symbols in (2, 3, 70):
        text = np.append(rng.integers(0, symbols, 700), 0)
        index = s.Index(text, symbols)
        at = np.array([i for i in range(690) if (text[i : i + 5] > 0).all()], dtype=np.int64)
        low, high, matched = index.search(text, at, 5)
        for i, a, b, m in zip(at.tolist(), low.tolist(), high.tolist(), matched.tolist(), strict=True):
            run = text[i + 5 - m : i + 5]
            places = {k for k in range(len(text) - m + 1) if (text[k : k + m] == run).all()}
            assert set(index.order[a:b].tolist()) == places and (m == 5 or len(places) == 1)


def test_ranks():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 50, 333)
    tree = s.WaveletTree(values, 6)
    numbers, at = rng.integers(0, 50, 400), rng.integers(0, 334, 400)
    assert tree.rank(numbers, at).tolist() == [int((values[:a] == v).sum()) for v, a in zip(numbers, at, strict=True)]

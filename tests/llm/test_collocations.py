"""Collocations against their definition, and filters that lose nothing."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from convspark.llm import collocations as c
from convspark.llm import filters

SCHEMA = "lang string, text string, phrase string"


def texts(n=60, seed=3):
    draw = random.Random(seed)
    words = "the of in a green old house tree\tWATER é x1 ,comma. stop! ?".split(" ")
    out = []
    for i in range(n):
        parts = [draw.choice(words) if draw.random() < 0.6 else "New York City  hall" for _ in range(draw.randrange(1, 60))]
        out.append((draw.choice(["en", "de", None]), draw.choice([" ", "\n", "\v", "  "]).join(parts), "x"))
    return [*out, ("en", None, "x"), ("fr", "", "x"), ("en", out[0][1], "x"), ("en", out[0][1], "x"), ("es", "word " * 3000, "x"), ("und", "New York City hall", "x")]


@pytest.mark.parametrize("head", [1 << 18, 3])
def test_brute(spark, monkeypatch, head):
    monkeypatch.setattr(c, "HEAD", head)
    monkeypatch.setattr(c, "FLUSH", 500)
    monkeypatch.setattr(c, "WORDS", 20)
    rows = texts()
    got = [tuple(r) for r in c.collocations(spark.createDataFrame(rows, SCHEMA), least=10, top=40).collect()]
    assert sorted(got) == sorted(c.brute([r[:2] for r in rows], least=10, top=40))
    assert {r[0] for r in got} == {"en", "de", "und", "es"}


def test_parts_are_ranked_as_one(spark, monkeypatch):
    monkeypatch.setattr(c, "PICK", 5)
    rows = texts(seed=5)
    got = [tuple(r) for r in c.collocations(spark.createDataFrame(rows, SCHEMA), least=5, top=7).collect()]
    assert sorted(got) == sorted(c.brute([r[:2] for r in rows], least=5, top=7))


def test_nothing_frequent(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert c.collocations(spark.createDataFrame([("en", "a b c", "")], SCHEMA)).collect() == []
    assert c.collocations(spark.createDataFrame([("en", "a. " * 200, "")], SCHEMA)).collect() == []


@pytest.mark.parametrize("words,bits", [(2, 12), (5, 12), (5, 13), (3, 25), (5, 32)])
def test_filters_are_lossless(words, bits):
    rng = np.random.default_rng(words * bits)
    packing = c.Packing(words, bits)
    codes = rng.integers(1, 1 << bits, 4000).astype(np.uint32)
    codes[1000:2000] = codes[1000]
    cells = packing.pack(codes)
    ids = np.lib.stride_tricks.sliding_window_view(codes, words).astype(np.int64)
    assert (packing.unpack(cells) == ids).all()
    assert all((a == b).all() for a, b in zip(packing.restore(packing.permute(cells)), cells, strict=True))
    whole = c.fold(packing.permute(cells))
    parts = c.merge([c.fold(packing.permute([x[k::3] for x in cells])) for k in range(3)])
    assert (whole.counts == parts.counts).all() and whole.counts.max() >= 900 and whole.counts.sum() == len(ids)
    number = (whole.cells[0] >> np.uint64(packing.width - 4)).astype(int)
    for k in range(16):
        own = c.Filter([x[number == k] for x in whole.cells], whole.counts[number == k])
        back = c.decode(c.encode(own, packing, 4), k, packing, 4)
        assert (back.counts == own.counts).all() and all((a == b).all() for a, b in zip(back.cells, own.cells, strict=True))


def test_bitmap_passes_all_members(spark):
    values = filters.mixed(np.arange(5000, dtype=np.uint64))
    found = filters.bitmap(spark.createDataFrame([(int(v),) for v in values[:1000].view(np.int64)], "hash long"), 1000)
    passed = filters.passes(found.value, values)
    assert passed[:1000].all() and passed[1000:].mean() < 0.1


def test_tasks_hold_little():
    """What a task counts and folds at once stays small, however much it reads."""
    words = [f"w{k}" for k in range(200_000)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 2000, "text": [" ".join(words[k : k + 100]) for k in range(0, 200_000, 100)]})
    found = list(c._count_words(iter([batch])))
    assert sum(b.num_rows for b in found) == 200_000 and max(b.num_rows for b in found) < 100_000
    rng = np.random.default_rng(1)
    codes = pa.RecordBatch.from_pydict({"codes": [rng.integers(1, 8000, 1 << 18).astype(np.uint16).tobytes() for _ in range(8)]})
    tracemalloc.start()
    for _ in c._filters(c.Packing(5, 13), 8, None)(iter([codes])):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6

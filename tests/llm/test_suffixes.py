import random

import numpy as np
import pytest

from convspark.llm import suffixes

DOCS = "doc_id long, text string, start int"


def test_runs_and_minimisers():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for n in (1, 5, 8, 20, 31):
        own = suffixes._runs(h, n)
        assert len(own) == 301 - n and len(set(own.tolist())) == len(own)
        assert suffixes._runs(h[40:], n)[0] == own[40]
    at = suffixes.minimisers(h)
    assert np.diff(at).max() <= suffixes.WINDOW
    for a in range(0, 250, 7):  # every passage keeps a minimiser near its start, wherever it stands
        inside = set(suffixes.minimisers(np.concatenate([h[:9], h[a : a + 50], h[:30]])) - 9) & set(at - a)
        assert any(0 <= x < suffixes.WINDOW for x in inside)


def test_against_brute(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    passages = [say(n) for n in (49, 50, 51, 80, 200)]
    docs = [(i, f"{say(rng.randrange(90))} {rng.choice(passages)}\n{say(rng.randrange(60))}") for i in range(60)]
    docs += [(100 + i, say(120)) for i in range(20)] + [(200 + i, docs[i][1]) for i in range(5)]
    docs += [(300, None), (301, ""), (302, "word " * 60000), (303, "Word\n" * 70), (304, f"{passages[3]} x {passages[3]}"), (305, passages[1].upper())]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs] + [(7, docs[7][1], 0), (None, docs[8][1], 0)], DOCS)
    got = {}
    rows = suffixes.repeated_passages(df).collect()
    for r in rows:
        assert r.n_words >= 50 and r.other_id != r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert got == suffixes.brute(docs)
    kept = {r.doc_id: r.kept for r in suffixes.without_repeats(df.filter("doc_id is not null")).collect()}
    assert kept[100] == docs[60][1] and kept[300] == "" and kept[204] == ""
    assert suffixes.repeated_passages(df.limit(0)).count() == 0


@pytest.mark.parametrize("own", [10, 15, 30])
def test_shared_right_side(spark, own):
    """Each two of 600 documents share words of their own before 45 words that all have."""
    rng = random.Random(own)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    common, docs = say(45), []
    for pair in range(300):
        both = f"{say(own)} {common}"
        docs += [(2 * pair + k, f"{say(20)} {both} {say(20)}") for k in range(2)]
    got = {}
    for r in suffixes.repeated_passages(spark.createDataFrame([(i, t, 0) for i, t in docs], DOCS)).collect():
        assert r.other_id // 2 == r.doc_id // 2
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert got == suffixes.brute(docs) and len(got) == 600


def test_frequent_heads(spark, monkeypatch):
    """Copies, shared middles and self-repeats of one head that most rows have, whatever the bounds of runs and slices."""
    rng = random.Random(5)
    say = lambda n, of=4000: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    hot, docs = say(40), []
    lefts, rights = [say(12) for _ in range(6)], [say(12) for _ in range(6)]
    for i in range(150):
        docs.append((i, f"{say(9)} {rng.choice(lefts)} {hot} {rng.choice(rights)} {say(9)}"))
    docs += [(200 + i, docs[3][1]) for i in range(60)] + [(300 + i, f"{hot} {hot} {say(3)}") for i in range(3)] + [(400, hot), (401, f"{say(9)} {hot} {say(40)}")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], DOCS)
    for run, size in ((16, 1000), (1, 7), (10**6, 20)):
        monkeypatch.setattr(suffixes, "RUN", run)
        monkeypatch.setattr(suffixes, "SLICE", size)
        got = {}
        for r in suffixes.repeated_passages(df).collect():
            got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
        assert got == suffixes.brute(docs)

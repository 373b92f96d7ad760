import random

from convspark.llm import digest

DOCS = "doc_id long, text string, fingerprint string, n long"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical():
    same = ["Straße  ﬁn", " STRASSE fin\n", "strasse\tfin"]
    assert len({digest.canonical(t) for t in same}) == 1
    assert digest.canonical("é") == digest.canonical("é") != digest.canonical("e")


def test_edits_against_brute(spark, monkeypatch):
    rng = random.Random(9)
    words = ["a", "Bb", "ñandú", "é", "ﬁ", " "]
    texts = [(i * i * 7 + rng.randrange(3), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40])))) for i in range(300)]
    texts += [(texts[7][0], texts[7][1]), (texts[8][0], "zz"), (-5, None), (-6, ""), (10**15, "x " * 80000), (10**15 - 1, "X  " * 80000)]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in texts], DOCS)
    assert rows(digest.against_edits(df)) == sorted(digest.brute(texts))
    monkeypatch.setattr(digest, "RANGE", 2)
    assert rows(digest.against_edits(df)) == sorted(digest.brute(texts))
    one = spark.createDataFrame([(1, "abc", "f", 1)], DOCS)
    assert rows(digest.against_edits(one)) == digest.brute([(1, "abc")])
    assert digest.against_edits(df.limit(0)).count() == 0
    two = spark.createDataFrame([(None, "abc", "f", 1), (4, None, "f", 1)], DOCS)
    assert sorted((r.doc_id is None, r.near_next) for r in digest.against_edits(two).collect()) == [(False, 0.0), (True, 0.0)]


def test_groups(spark):
    texts = [(1, "A  b"), (2, "a b "), (3, None), (4, " "), (5, "a c"), (6, "Ａ B"), (5, "a c")]
    df = spark.createDataFrame([(i, t, "f", 1) for i, t in texts], DOCS)
    got = sorted((r.doc_id, r.group_id) for r in digest.duplicate_groups(df).collect())
    assert set(got) == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 1)}
    assert digest.duplicate_groups(df.limit(0)).count() == 0

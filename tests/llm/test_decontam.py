import random

from convspark.llm import decontam


def edited(rng, text, n):
    for _ in range(n):
        at = rng.randrange(max(1, len(text)))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "q" + text[at:], text[:at] + "z" + text[at + 1 :]])
    return text


def test_against_brute(spark):
    rng = random.Random(1)
    words = ["the", "of", "onen", "thand", "ere", "Reti", "été"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([3, 12, 30]))) for i in range(12)] + [(50, "of it"), (51, None), (52, " "), (3, "again the of onen thand ere")]
    docs = []
    for i in range(70):
        body = say(rng.choice([0, 5, 40]))
        if i % 2:
            item = rng.choice(items)[1] or "x"
            body += "\n " + edited(rng, item, rng.choice([0, 1, 2, 5, 9])).replace(" ", "  ") + " " + say(9)
        docs.append((i, body))
    docs += [(100, None), (101, ""), (102, "word " * 600 + items[2][1] + " end"), (103, "of it"), (104, "of item"), (5, docs[5][1])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, end string")
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int")
    got = decontam.contaminated(d, b).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == decontam.brute(docs, items)
    kept = decontam.without_contaminated(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {r.doc_id for r in got}
    assert decontam.contaminated(d.limit(0), b).count() == 0 and decontam.contaminated(d, b.limit(0)).count() == 0


def test_long_text(spark):
    """A very long text is searched to its end: exactly the two items put there, far apart, are found."""
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    items = [(i, say(12)) for i in range(6)]
    text = f"{items[1][1]} {say(40000)} {edited(rng, items[4][1], 3)} {say(5)}"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.item_id, r.distance <= 3) for r in got) == [(1, True), (4, True)]


def test_blocks(spark, monkeypatch):
    d = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "epsilon zeta eta theta")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "beta gamma delta"), (2, "zeta eta theta")], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 5)
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(d, b).collect()} == {(1, 1), (2, 2)}

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def say(rng, n):
    return " ".join("".join(rng.choice(["tha", "ing", "on", "er", "of"]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_decisions_hold_for_rows(spark, tmp_path):
    """A rejected row takes no other row of its doc_id, or without one, with it."""
    rng = random.Random(2)
    item, a, b, c, d = (say(rng, 60) for _ in range(5))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    def run(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return sorted(((r.doc_id, r.text) for r in stage(spark, docs, str(tmp_path)).collect()), key=repr)

    rows = [(None, a), (None, "12 !"), (None, None), (7, b), (7, "34 !"), *[(20 + i, f"{say(rng, 20)} {i}") for i in range(9)]]
    assert run(corpus_pipeline.language_id, rows) == sorted([r for r in rows if r[1] in (a, b) or (r[0] or 0) >= 20], key=repr)
    rows = [(None, a), (None, f"x {item} y"), (7, b), (7, item)]
    assert run(corpus_pipeline.decontamination, rows) == sorted([(None, a), (7, b)], key=repr)
    rows = [(None, a), (None, b), (3, b), (7, c), (7, d), (9, d), (7, c)]
    assert run(corpus_pipeline.near_dedup, rows) == sorted([(None, a), (3, b), (7, c), (7, d)], key=repr)


def test_nothing_learned(spark, tmp_path):
    """Without a labelled document none goes for its language; with some, null languages are filled in."""
    rng = random.Random(3)
    rows = [(i, say(rng, 30), None, "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows + [(99, "12", None, "s", 2)], DOCS)
    kept = corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} == set(range(30)) and {r.lang for r in kept} == {None}
    labelled = spark.createDataFrame([(i, t, "en" if i % 2 else None, s, n) for i, t, _, s, n in rows], DOCS)
    assert {r.lang for r in corpus_pipeline.language_id(spark, labelled, str(tmp_path)).collect()} == {"en"}

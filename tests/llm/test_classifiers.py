import random
import zlib

import numpy as np

from convspark.llm import langid, quality

SYLLABLES = {"xx": ["tha", "ing", "on", "er", "the"], "yy": ["été", "que", "oi", "eau"], "zz": ["ung", "sch", "ei", "ß"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


def test_language(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, lang, rng.choice([8, 60])), lang, 1.0) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=240))]
    odd = [(900, None, "xx", 0.0), (901, "", None, 0.0), (902, "12 34 !", "yy", 0.0), (903, text(rng, "zz", 30000), None, 0.0), (3, rows[3][1], rows[3][2], 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == held(i, 4, 2) for i in by)
    unseen = [(i, lang) for i, _, lang, _ in rows if held(i, 4, 2)]
    assert np.mean([by[i].lang_pred == lang for i, lang in unseen]) > 0.97
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "zz"]
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = langid.identify(docs.withColumn("lang", docs["lang"].substr(9, 1)).filter("lang is null"))
    assert {r.lang_pred for r in nothing.collect()} <= {"und"}


def test_folded_matrix_is_the_kernel_machine():
    rng = random.Random(8)
    samples = [(text(rng, lang, 20), lang) for lang in SYLLABLES for _ in range(12)]
    sets = [langid.presence(t) for t, _ in samples]
    model = langid.fit([(own, lang) for own, (_, lang) in zip(sets, samples, strict=True)])
    query = text(rng, "yy", 25)
    own = langid.presence(query)
    k = np.array([len(np.intersect1d(own, s)) / np.sqrt(len(own) * len(s)) for s in sets])
    assert np.allclose(langid._dense([own]) @ langid._dense(sets).T, k, atol=1e-5)
    assert langid.predict(model, [query])[0] == ["yy"]
    # all 36 texts are landmarks: the plain machine solves for a coefficient of each in the Nystroem features
    gram = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(gram)
    half = vectors @ np.diag(values**-0.5) @ vectors.T
    features, target = gram @ half, np.array([[1.0 if own == lang else -1.0 for lang in model.languages] for _, own in samples])
    coefficients = np.linalg.solve(features.T @ features + langid.RIDGE * np.eye(36), features.T @ target)
    assert np.allclose(langid._dense([own]) @ model.weights, k @ half @ coefficients, atol=1e-3)


def test_bounds_of_samples(spark, monkeypatch):
    """With tiny samples the same languages and qualities come out, and the classes keep their shares."""
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 30), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    monkeypatch.setattr(langid, "SAMPLE", 60)
    monkeypatch.setattr(langid, "LEAST_SAMPLE", 20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.97
    # a third of the good texts look bad, so that shares matter
    marks = [(i, int(rng.random() < 0.9), 0) for i in range(3000)]
    texts = [(i, text(rng, "xx" if q and rng.random() < 0.67 else "yy", 20), "s") for i, q, _ in marks]
    monkeypatch.setattr(quality, "PER_CLASS", 150)
    scores = quality.score(spark.createDataFrame(texts, "doc_id long, text string, s string"), spark.createDataFrame(marks, "doc_id long, quality int, s int")).collect()
    assert abs(np.mean([r.score for r in scores]) - np.mean([q for _, q, _ in marks])) < 0.05


def test_quality(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        body = text(rng, "xx", 80)
        docs.append((i, body if good else body.upper().replace(" ", "!! "), "s"))
        labels.append((i, int(good), 0))
    docs += [(900, None, "s"), (901, "", "s"), (902, "tha " * 60000, "s"), (4, docs[4][1], "s")]
    labels += [(None, 1, 0), (5, None, 0), (4, labels[4][1], 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, quality string")
    m = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = {r.doc_id: r for r in quality.score(d, m).collect()}
    assert quality.score(d, m).count() == len(docs)
    unseen = [(i, q) for i, q, _ in labels[:400] if held(i, 3, 1)]
    assert np.mean([got[i].predicted == q for i, q in unseen]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == held(i, 3, 1) for i, r in got.items())
    assert quality.score(d.limit(0), m).count() == 0
    assert {r.score for r in quality.score(d, m.limit(0)).collect()} == {0.5}
    assert quality.score(d, m.filter("quality = 1")).filter("predicted = 0").count() == 0


def test_quality_against_brute(spark):
    """The measure, curve and scores by their definitions from the same two dictionaries; no text of a class is cut short."""
    import zstandard

    rng = random.Random(9)
    docs = [(i, text(rng, "xx" if i % 3 else "yy", 400 if i == 7 else 30)) for i in range(160)]
    labels = [(i, int(i % 3 > 0)) for i in range(160)]
    d, m = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.train(d, m)
    tools = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False) for x in (model.bad, model.good)]

    def measured(t):
        raw = t.encode()
        sizes = [sum(len(z.compress(raw[k : k + quality.BLOCK])) for k in range(0, len(raw), quality.BLOCK)) for z in tools]
        return (sizes[0] - sizes[1]) / max(1, len(raw))

    got = quality.score(d, m, modulus=1, held=1).collect()
    want = {i: 1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * measured(t)))) for i, t in docs}
    assert len(got) == 160 and all(abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in got]) > 0.95
    long = bytes(range(256)) * 400
    assert b"".join(quality.sampled(long, 1.0)) == long and 0 < len(quality.sampled(long, 0.3)) < 100


def test_language_against_brute(spark):
    """Every text's language and score by the plain kernel machine on the same sample."""
    rng = random.Random(12)
    rows = [(i, text(rng, lang, 12), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=90))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    learned = sorted(((lang, i * 0x9E3779B1 % (1 << 32), t) for i, t, lang in rows if not held(i, 4, 2)))
    sets = [langid.presence(t) for _, _, t in learned]
    names = sorted(SYLLABLES)
    kernel = lambda a, b: len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b))
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    features, target = gram @ half, np.array([[1.0 if own == lang else -1.0 for lang in names] for own, _, _ in learned])
    weight = np.array([len(learned) / (len(names) * sum(x[0] == own for x in learned)) for own, _, _ in learned])[:, None]
    machine = half @ np.linalg.solve(features.T @ (weight * features) + langid.RIDGE * np.eye(len(half)), features.T @ (weight * target))
    for i, t, _ in rows:
        own = langid.presence(t)
        outputs = np.array([kernel(own, s) for s in sets]) @ machine
        likely = np.exp(langid.SHARPNESS * (outputs - outputs.max()))
        assert got[i].lang_pred == names[outputs.argmax()] and abs(got[i].score - likely.max() / likely.sum()) < 2e-2

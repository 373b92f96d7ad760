import random

import corpus_pipeline
import numpy as np
import pytest
from convspark.llm import resemblance


def texts(rng):
    """Texts, copies with a few words changed (similarity about 0.8 to 1), templates that are half alike, odd ones."""
    say = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    out = []
    for _ in range(40):
        base = say(rng.choice([3, 8, 40, 200]))
        out.append(" ".join(base))
        for changes in (0, 1, 2, 4, 6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), min(changes, len(copy))):
                copy[at] = "ZZ"
            out.append("\n".join(copy))
    common = say(60)
    out += [" ".join(common + say(25)) for _ in range(12)]
    return [*out, None, "", " \t", "one", "ONE", "word " * 30000]


def key(k):
    return k.to_bytes(16, "big")


def gone_of(spark, rows):
    df = spark.createDataFrame([(key(k), i, t, 0) for k, i, t in rows], "key binary, doc_id long, text string, segments int")
    return {int.from_bytes(r.key, "big") for r in resemblance.repeats(df).collect()}


def test_against_brute(spark):
    rng = random.Random(9)
    rows = [(1000 + k, None if k % 17 == 0 else rng.randrange(150), t) for k, t in enumerate(texts(rng))]
    gone = gone_of(spark, [*rows, rows[3]])
    every = resemblance.brute(rows)
    # candidates are found by chance where over eleven bits differ; what goes is in a group, though its first may differ
    assert len(gone - every) <= 0.02 * len(every) and len(every - gone) <= 0.03 * len(every)
    left = [r for r in rows if r[0] not in gone]
    assert len(resemblance.brute(left)) <= 0.03 * len(every) and len(left) > 60
    assert gone_of(spark, rows[:0] or [(1, 1, "x")]) == set()


def test_recall_by_similarity(spark):
    """Of planted copies, each alike to its own original only, over nine tenths go in each band of similarity."""
    rng = random.Random(5)
    rows, bands = [], {}
    for k in range(400):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 3, 4])):
            copy[at] = f"z{rng.randrange(4000)}"
        shingles = [{tuple(x[i : i + 5]) for i in range(196)} for x in (base, copy)]
        similarity = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1])
        rows += [(2 * k, 2 * k, " ".join(base)), (2 * k + 1, 2 * k + 1, " ".join(copy))]
        if similarity >= 0.8:
            bands.setdefault(int(similarity * 20), []).append(2 * k + 1)
    gone = gone_of(spark, rows)
    assert gone <= {k for own in bands.values() for k in own}
    shares = {band / 20: len(gone & set(own)) / len(own) for band, own in bands.items() if len(own) >= 20}
    assert len(shares) >= 3 and min(shares.values()) >= 0.9, shares


@pytest.mark.parametrize("n", [20, 200])
def test_texts_of_the_same_words(spark, n):
    """Texts of the same words in another order share all entries and are not alike; the work doesn't follow their number."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(100)]
    rows = [(k, k, " ".join(rng.sample(words, 100))) for k in range(n)]
    rows += [(1000, 1000, rows[3][2] + " end"), (1001, 1001, rows[4][2])]
    sc = spark.sparkContext
    sc.setJobGroup(f"same{n}", "")
    gone = gone_of(spark, rows)
    jobs = len(sc.statusTracker().getJobIdsForGroup(f"same{n}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert gone == {1000, 1001}
    assert jobs < 260


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(resemblance, "MATES", 8)
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = [(0, 0, " ".join(base))]
    for k in range(1, 150):
        copy = list(base)
        copy[rng.randrange(150)] = f"c{k}"
        rows.append((k, k, " ".join(copy)))
    assert gone_of(spark, rows) == set(range(1, 150))


@pytest.mark.parametrize("block", [1, 256])
def test_no_link_lost_in_large_entries(spark, monkeypatch, block):
    """Alike texts of one large entry that share no least hash are linked all the same."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(120)]
    rows = []
    while len(rows) < 6:
        base = rng.sample(words, 120)
        i, j, k = sorted(rng.sample(range(121), 3))
        copy = base[:i] + base[j:k] + base[i:j] + base[k:]
        sets = [resemblance.shingles(" ".join(x).encode()) for x in (base, copy)]
        if resemblance.alike(*sets) and not any(x == y for x, y in zip(*map(resemblance.least_hashes, sets), strict=True)):
            rows += [(len(rows) + n, len(rows) + n, " ".join(x)) for n, x in enumerate((base, copy))]
    assert gone_of(spark, rows) == resemblance.brute(rows) == {1, 3, 5}


@pytest.mark.parametrize("block", [3, 256])
def test_links_beside_the_first(spark, monkeypatch, block):
    """Where all texts meet the first one only, the join by shingles finds the groups of brute force; a common frame is in no way."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    monkeypatch.setattr(resemblance, "candidates", lambda firsts: (firsts.selectExpr("0L a", "rank b").filter("b > 0"), firsts.select("rank")))
    rng = random.Random(6)
    frame = [f"w{k}" for k in range(40)]
    rows = []
    for _ in range(12):
        base = frame + [f"v{rng.randrange(9000)}" for _ in range(rng.choice([20, 60, 250]))]
        for changes in (0, 1, 2, 4, 6):
            copy = list(base)
            for at in rng.sample(range(len(base)), changes):
                copy[at] = f"z{rng.randrange(9000)}"
            rows.append((len(rows), len(rows), " ".join(copy)))
    every = resemblance.brute(rows)
    assert 10 <= len(every) <= len(rows) - 12
    assert gone_of(spark, rows) == every


@pytest.mark.parametrize("block", [3, 256])
def test_cloud_of_unlike_texts(spark, monkeypatch, block):
    """Texts of one frame that share all but a fifth of it are many, alike to few: the join itself leaves out most pairs that are not alike, and none that is."""
    monkeypatch.setattr(resemblance, "BLOCK", block)
    rng = random.Random(12)
    frame = [f"w{k}" for k in range(150)]
    rows = []
    for _ in range(70):
        copy = list(frame)
        for at in rng.sample(range(150), rng.choice([1, 3, 3, 3, 3])):
            copy[at] = f"z{rng.randrange(9000)}"
        rows.append((len(rows), " ".join(copy[: rng.choice([125, 140, 150])])))
    sets = [resemblance.shingles(t.encode()) for _, t in rows]
    every = {(a, b) for b in range(70) for a in range(b) if resemblance.alike(sets[a], sets[b])}
    texts = spark.createDataFrame(rows, "rank long, text string")
    got = {(r.a, r.b) for r in resemblance.prefix_pairs(texts, spark.createDataFrame([], "node long, root long")).collect()}
    # of the other pairs, 511 share a shingle early enough
    assert len(every) > 60 and every <= got and len(got - every) <= 60


def test_parities():
    """Two sets differ in as many shingles as in parities at least; the bits of small differences are seen."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 150, 4000):
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for extra in (0, 1, 20, 300):
            a, b = (np.unique(np.append(both, rng.integers(0, 1 << 63, extra).astype(np.uint64))) for _ in range(2))
            bits = sum(int(x).bit_count() for x in (resemblance.parities(a) ^ resemblance.parities(b)).view(np.uint64))
            apart = len(np.setxor1d(a, b))
            assert bits <= apart and (bits >= 0.75 * apart or extra > 20)
            assert len(resemblance.parities(a)) == len(resemblance.BITS)


def test_shuffles_are_dropped_while_groups_are_found(spark, monkeypatch):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name), []
    found = resemblance.candidates
    monkeypatch.setattr(resemblance, "candidates", lambda firsts: seen.append(spark.conf.get(name)) or found(firsts))
    assert gone_of(spark, [(1, 1, "a b"), (2, 2, "a b"), (3, 3, "c")]) == {2}
    assert seen == ["true"] and spark.conf.get(name) == before


def test_prefix():
    """Two sets share a shingle of their prefixes if four fifths of their union are common, whatever the order."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        both = rng.integers(0, 1 << 62, rng.integers(4, 60)).astype(np.uint64)
        sets = [np.unique(np.append(both, rng.integers(0, 1 << 62, rng.integers(0, 1 + len(both) // 8)).astype(np.uint64))) for _ in range(2)]
        common = np.unique(rng.choice(both, len(both) // 2))
        places = rng.permutation(len(common)) + 1
        if resemblance.alike(*sets):
            assert len(np.intersect1d(*[resemblance.prefix(s, common, places) for s in sets]))


def test_members(spark):
    """Two fingerprints share an entry exactly if some segment differs by at most one bit: any two at most eleven bits apart."""
    rng = random.Random(1)
    prints = []
    for k in range(60):
        base = prints[-1] if k % 3 else rng.getrandbits(192)
        for bit in rng.sample(range(192), rng.choice([0, 1, 3, 11, 16])):
            base ^= 1 << bit
        prints.append(base)
    rows = [(k, [p >> 32 * s & 0xFFFFFFFF for s in range(6)]) for k, p in enumerate(prints)]
    df = resemblance._members(spark.createDataFrame(rows, "rank long, segments array<long>"))
    got = {(r.a, r.b) for r in df.alias("x").join(df.alias("y"), "entry").selectExpr("x.rank a", "y.rank b").distinct().collect() if r.a < r.b}
    apart = lambda a, b: [(rows[a][1][s] ^ rows[b][1][s]).bit_count() for s in range(6)]
    assert got == {(a, b) for b in range(60) for a in range(b) if min(apart(a, b)) <= 1}
    assert {(a, b) for b in range(60) for a in range(b) if sum(apart(a, b)) <= 11} <= got


def test_stage_takes_one_changed_word(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(4000)}" for _ in range(200)]
        rows.append((i, " ".join(words)))
        rows.append((100 + i, " ".join([*words[:90], "other", *words[91:]])))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == list(range(20))

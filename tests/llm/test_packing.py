import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from convspark.llm import packing

DOCS = "doc_id long, text string, length int"


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\x0b\x0c\r\x1c\x85 ́'sS9é<|endoftext>ΣİIe")), max_size=40))
def test_word_ids_are_those_of_the_text(text):
    got = np.frombuffer(packing.text_ids([text.encode()], packing.default_tokenizer())[0], dtype="<u4").tolist()
    assert got == plain_ids(text)


def test_special_strings():
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "don't 'S  it'll"):
        got = np.frombuffer(packing.text_ids([text.encode()], packing.default_tokenizer())[0], dtype="<u4").tolist()
        assert got == plain_ids(text)


def test_words_as_they_come():
    words = "Über ÀÉÎ ÿß été. (mot) Ñandú! a_b x-y l'eau don'T _x_ ºª ÷× ﬁn ǅ 12ab ab12 ... !'s Straße; é\u0301 e\u0301 İ ΑΣ".split(" ")
    for text in [*words, " ".join(words)]:
        got = np.frombuffer(packing.text_ids([text.encode()], packing.default_tokenizer())[0], dtype="<u4").tolist()
        assert got == plain_ids(text), text


def test_other_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  words,\n and más"
    assert np.frombuffer(packing.text_ids([text.encode()], path)[0], dtype="<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def check(placed, capacity):
    by = defaultdict(list)
    for sequence, offset, length in placed:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=120))
def test_plan_places_every_rank_once(lengths):
    counts, capacity = Counter(lengths), 60
    runs = packing.plan(counts, capacity)
    placed = []
    for length, n in counts.items():
        own = [r for r in runs.tolist() if r[0] == length]
        for rank in range(n):
            _, first, each, sequence, offset = [r for r in own if r[1] <= rank][-1]
            placed.append((sequence + (rank - first) // each, offset + (rank - first) % each * length, length))
    used = check(placed, capacity)
    large = [x for x in lengths if 3 * x > capacity]
    assert used <= max(-(-sum(lengths) * 3 // (2 * capacity)), len(large)) + 1


def test_pack(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["alpha", "Beta9", "γάμμα", "it's"]) for _ in range(rng.choice([0, 1, 40, 900])))) for i in range(80)]
    texts += [(200, None), (201, ""), (202, "word " * 9000), (3, texts[3][1])]
    df = spark.createDataFrame([(i, t, 7) for i, t in texts], DOCS)
    rows = packing.pack(df).collect()
    want = Counter()
    for i, t in texts:
        ids = plain_ids(t or "") + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            own = ids[start : start + 4096]
            want[i, piece, start, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    n = check([(r.sequence_id, r.offset, r.length) for r in rows], 4096)
    assert n <= -(-sum(r.length for r in rows) // 4096) * 1.2 + 1
    whole = packing.packed_sequences(df).collect()
    assert len(whole) == n and sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_equal_rows_are_split(spark, monkeypatch):
    """Rows alike in everything get salts of their own, and each a place of its own."""
    monkeypatch.setattr(packing, "RANKED", 20)
    rows = [(1, "one two three", 0)] * 300 + [(2, "one two three four", 0)] * 50 + [(None, None, 0)] * 40
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, sequence_id int"), capacity=32).collect()
    assert len(got) == 390
    taken = {}
    for r in got:
        for at in range(r.offset, r.offset + r.length):
            assert taken.setdefault((r.sequence_id, at), r) is r
    assert len(taken) == sum(r.length for r in got) and max(at for _, at in taken) < 32


def test_cache_of_a_run(spark, monkeypatch):
    """The pipeline's packing keeps fewer words in a worker, takes smaller batches, and gives the same pieces; settings are put back."""
    import corpus_pipeline

    from convspark.llm.common import arrow_batches

    words = packing.Words(packing.default_tokenizer(), 40)
    texts = [" ".join(f"Word{chr(97 + (i * j) % 26)}x," for j in range(60)).encode() for i in range(30)]
    assert words.by_word
    assert [words.ids([t])[0] for t in texts] == packing.Words(packing.default_tokenizer()).ids(texts)
    assert max(map(len, (words.lately, words.before, words.stems, words.marks))) <= 60
    assert corpus_pipeline.CACHE_WORDS < packing.CACHE_WORDS
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with arrow_batches(spark, 7):
        assert spark.conf.get(name) == "7"
        small = {tuple(r) for r in packing.pieces(docs, cache_words=40).collect()}
    assert spark.conf.get(name) == before
    assert small == {tuple(r) for r in packing.pieces(docs).collect()}

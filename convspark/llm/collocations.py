"""Phrase collocations counted in counting quotient filters.

Words that MIN_COUNT occurrences of a language have get numbers; texts become rows of numbers once. A phrase's numbers are
packed side by side into one to three 64-bit cells. The first cell is permuted invertibly (mixed with the others), its
upper bits are the quotient, the rest and the other cells the remainder. A filter holds remainders in the order of their
quotients, how many each quotient has, and a counter for each: nothing of a phrase is lost, so counters are exact. Each
task folds what it has read into such filters, cut up by the quotient's upper bits; the pieces of a range are sorted, and
merge one after the other in a single pass.

Phrases are counted by length, as one can only be frequent if it is without its first and without its last word. Those
shorter frequent phrases are tested by a bitmap of bounded size, which passes all of them. A candidate's parts are
candidates or frequent words themselves, so each length takes what it needs of them over from the one before.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import cut, join_counted, only, stored, worker_cache
from convspark.llm.filters import bitmap, mixed, passes
from convspark.operators.numbering import with_sum_before

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
UNKNOWN = "und"
#: Words whose numbers are broadcast; those of all others are joined.
HEAD = 1 << 18
#: Occurrences that a task folds at a time; distinct words that it counts before it hands them on; numbers of a stored row.
#: Folding takes some ten times its cells, in each task of an executor at once.
FLUSH, WORDS, ROW = 1 << 19, 1 << 16, 1 << 17
#: Occurrences for each range of quotients, the least number of ranges, and bits of a quotient within its range.
RANGE, RANGES, SLOT_BITS = 1 << 22, 256, 8
#: Rows of a task that picks its best ones first.
PICK = 50_000
_PUNCTUATION = bytes.maketrans(b".,;:!?\n\v\f\r\t", b".......... ")
_BREAK = b"."  # no word can hold it
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)


# Words


def pieces(text: bytes) -> list[bytes]:
    """Lower-cased words with _BREAK between pieces."""
    return text.lower().translate(_PUNCTUATION).replace(b".", b" . ").split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("collocations: words")
    counts: dict[str, Counter] = defaultdict(Counter)

    def flush() -> pa.RecordBatch:
        langs = [k for k, c in counts.items() for _ in range(len(c))]
        words = [w for c in counts.values() for w in c]
        n = [v for c in counts.values() for v in c.values()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "f"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            found = counts[lang]
            found.update(pieces(text.as_py()))
            del found[_BREAK]
            if sum(map(len, counts.values())) > WORDS:
                yield flush()
    yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f of docs(lang, text)."""
    return docs.mapInArrow(_count_words, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


def _hashed_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_word_hash(k, w) for k, w in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["hash"])


def _rare_words(head, tail):
    """row, lang, word: of each text its words that have no number in head and may have one at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, langs, words = [], [], []
            for row, lang, text in zip(batch.column("row").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                known = head.value.get(lang, {})
                own = [w for w in set(pieces(text.as_py())) if w not in known and w != _BREAK]
                if own:
                    keep = passes(tail.value, np.array([_word_hash(lang, w) for w in own], dtype=np.uint64))
                    own = [w for w, k in zip(own, keep.tolist(), strict=True) if k]
                rows += [row] * len(own)
                langs += [lang] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(langs, pa.string()), pa.array(words, pa.binary())], names=["row", "lang", "word"])

    return run


def _encode(head, bits: int):
    """Numbers of words, 0 for all others and between pieces and texts, one text after the other."""
    kind = np.uint16 if bits <= 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("collocations: codes")
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()], pa.binary())], names=["codes"])

        for batch in batches:
            own = batch.column("own").to_pylist() if "own" in batch.schema.names else repeat(None)
            for lang, text, more in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), own):
                words, get = pieces(text.as_py()), head.value.get(lang, {}).get
                codes = np.zeros(len(words) + 1, dtype=kind)
                codes[:-1] = np.fromiter(map(get, words, repeat(0)), dtype=kind, count=len(words))
                if more:
                    others = {m["word"]: m["id"] for m in more}
                    codes[:-1] |= np.fromiter(map(others.get, words, repeat(0)), dtype=kind, count=len(words))
                held.append(codes)
                size += len(codes)
                if size >= ROW:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


# Filters


class Packing(NamedTuple):
    """How phrases of `words` numbers of `bits` bits lie in cells of 64 bits."""

    words: int
    bits: int

    @property
    def per_cell(self) -> int:
        return 64 // self.bits

    @property
    def cells(self) -> int:
        return -(-self.words // self.per_cell)

    @property
    def width(self) -> int:
        """Bits of the first cell that are permuted."""
        return 64 if self.cells > 1 else max(32, self.words * self.bits)

    def pack(self, codes: np.ndarray) -> list[np.ndarray]:
        """Cells of all runs of `words` numbers, whether or not a 0 is among them."""
        n = len(codes) - self.words + 1
        cells = [np.zeros(max(0, n), dtype=np.uint64) for _ in range(self.cells)]
        for k in range(self.words):
            if n > 0:
                cells[k // self.per_cell] |= codes[k : k + n].astype(np.uint64) << np.uint64(self.bits * (k % self.per_cell))
        return cells

    def unpack(self, cells: list[np.ndarray]) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        return np.stack([(cells[k // self.per_cell] >> np.uint64(self.bits * (k % self.per_cell))) & mask for k in range(self.words)], axis=1).astype(np.int64)

    def permute(self, cells: list[np.ndarray]) -> list[np.ndarray]:
        half, mask = np.uint64((self.width + 1) // 2), np.uint64((1 << self.width) - 1)
        first = (cells[0] ^ self._others(cells)) & mask
        for odd in _ODD:
            first = ((first ^ (first >> half)) * np.uint64(odd)) & mask
        return [first ^ (first >> half), *cells[1:]]

    def restore(self, cells: list[np.ndarray]) -> list[np.ndarray]:
        half, mask = np.uint64((self.width + 1) // 2), np.uint64((1 << self.width) - 1)
        first = cells[0] ^ (cells[0] >> half)
        for odd in _ODD[::-1]:
            first = (first * np.uint64(pow(odd, -1, 1 << self.width))) & mask
            first ^= first >> half
        return [(first ^ self._others(cells)) & mask, *cells[1:]]

    def _others(self, cells: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(cells[0]), dtype=np.uint64)
        for cell in cells[:0:-1]:
            out = mixed(out ^ cell)
        return out

    def hashes(self, permuted: list[np.ndarray]) -> np.ndarray:
        """For a bitmap, which takes the upper bits."""
        return permuted[0] << np.uint64(64 - self.width)


class Filter(NamedTuple):
    """Permuted cells in rising order, and a counter for each."""

    cells: list[np.ndarray]
    counts: np.ndarray


def fold(cells: list[np.ndarray], counts: np.ndarray | None = None) -> Filter:
    """Sorted, with equal phrases' counters added up. What is already sorted in parts is merged."""
    n = len(cells[0])
    if len(cells) == 1 and counts is None:
        cells = [np.sort(cells[0])]
    else:
        order = np.argsort(cells[0], kind="stable") if len(cells) == 1 else np.lexsort(cells[::-1])
        cells = [c[order] for c in cells]
    starts = np.flatnonzero(np.concatenate(([True], np.logical_or.reduce([c[1:] != c[:-1] for c in cells])))) if n else np.zeros(0, dtype=np.int64)
    totals = np.diff(np.append(starts, n)) if counts is None else np.add.reduceat(counts[order], starts) if n else counts
    return Filter([c[starts] for c in cells], totals.astype(np.int64))


def merge(filters: list[Filter]) -> Filter:
    if len(filters) == 1:
        return filters[0]
    return fold([np.concatenate(c) for c in zip(*(f.cells for f in filters), strict=True)], np.concatenate([f.counts for f in filters]))


def encode(f: Filter, packing: Packing, range_bits: int) -> bytes:
    """One range's filter: how many remainders each quotient has, the remainders, and counters of one byte or, marked by 255, eight."""
    rest = packing.width - range_bits - SLOT_BITS
    slots = np.bincount((f.cells[0] >> np.uint64(rest)).astype(np.int64) & ((1 << SLOT_BITS) - 1), minlength=1 << SLOT_BITS).astype("<u4")
    low = (f.cells[0] & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-rest // 8)]
    large = f.counts >= 255
    counters = np.where(large, 255, f.counts).astype(np.uint8)
    return b"".join([slots.tobytes(), low.tobytes(), *(c.astype("<u8").tobytes() for c in f.cells[1:]), counters.tobytes(), f.counts[large].astype("<i8").tobytes()])


def decode(data: bytes, number: int, packing: Packing, range_bits: int) -> Filter:
    rest = packing.width - range_bits - SLOT_BITS
    slots = np.frombuffer(data, dtype="<u4", count=1 << SLOT_BITS).astype(np.int64)
    n, at, wide = int(slots.sum()), 4 << SLOT_BITS, -(-rest // 8)
    low = np.zeros((n, 8), dtype=np.uint8)
    low[:, :wide] = np.frombuffer(data, dtype=np.uint8, count=n * wide, offset=at).reshape(n, wide)
    at += n * wide
    quotients = np.repeat(np.arange(1 << SLOT_BITS, dtype=np.uint64), slots) | np.uint64(number << SLOT_BITS)
    cells = [(quotients << np.uint64(rest)) | low.view("<u8").ravel()]
    for _ in range(1, packing.cells):
        cells.append(np.frombuffer(data, dtype="<u8", count=n, offset=at).astype(np.uint64))
        at += 8 * n
    counts = np.frombuffer(data, dtype=np.uint8, count=n, offset=at).astype(np.int64)
    large = counts == 255
    counts[large] = np.frombuffer(data, dtype="<i8", offset=at + n)
    return Filter(cells, counts)


def _filters(packing: Packing, range_bits: int, shorter):
    """number, filter: of each range of quotients what a task has counted. shorter: a bitmap of phrases without their last word."""
    kind = np.uint16 if packing.bits <= 16 else np.uint32
    before = Packing(packing.words - 1, packing.bits)

    def phrases(codes: np.ndarray) -> list[np.ndarray]:
        cells = packing.pack(codes)
        n = len(cells[0])
        if not n:
            return cells
        words = (codes != 0).astype(np.int8)
        keep = np.ones(n, dtype=bool)
        for k in range(packing.words):
            keep &= words[k : k + n] != 0
        if shorter is not None:
            known = passes(shorter.value, before.hashes(before.permute(before.pack(codes))))
            keep &= known[:-1] & known[1:]
        return [c[keep] for c in cells]

    def pieces_of(f: Filter) -> Iterator[pa.RecordBatch]:
        numbers = (f.cells[0] >> np.uint64(packing.width - range_bits)).astype(np.int64)
        found, starts = np.unique(numbers, return_index=True)
        ends = np.append(starts[1:], len(numbers))
        for first in range(0, len(found), 64):
            part = slice(first, first + 64)
            data = [encode(Filter([c[a:b] for c in f.cells], f.counts[a:b]), packing, range_bits) for a, b in zip(starts[part], ends[part], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found[part]), pa.array(data, pa.binary())], names=["number", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("collocations: filters")
        held: list[list[np.ndarray]] = []
        done: Filter | None = None
        size = 0
        for batch in batches:
            for data in batch.column("codes"):
                held.append(phrases(np.frombuffer(data.as_py(), dtype=kind)))
                size += len(held[-1][0])
                if size >= FLUSH:
                    f = fold(packing.permute([np.concatenate(c) for c in zip(*held, strict=True)]))
                    done, held, size = merge([done, f]) if done else f, [], 0
                    if len(done.counts) >= FLUSH:
                        yield from pieces_of(done)
                        done = None
        if size:
            f = fold(packing.permute([np.concatenate(c) for c in zip(*held, strict=True)]))
            done = merge([done, f]) if done else f
        if done:
            yield from pieces_of(done)

    return run


def _merged(packing: Packing, range_bits: int, least: int):
    """ids, a, hash of the phrases that the filters of a range have at least `least` times; rows come by range."""

    def frequent(f: Filter) -> pa.RecordBatch:
        keep = f.counts >= least
        cells = [c[keep] for c in f.cells]
        ids = packing.unpack(packing.restore(cells))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * packing.words), pa.array(ids.ravel()))
        return pa.RecordBatch.from_arrays([lists, pa.array(f.counts[keep]), pa.array(packing.hashes(cells).view(np.int64))], names=["ids", "a", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("collocations: merges")
        number, held, size = None, [], 0
        for batch in batches:
            for own, data in zip(batch.column("number").to_pylist(), batch.column("filter"), strict=True):
                if own != number and held:
                    yield frequent(merge(held))
                    held, size = [], 0
                number = own
                held.append(decode(data.as_py(), own, packing, range_bits))
                size += len(held[-1].counts)
                if size > max(FLUSH, 2 * len(held[0].counts)):
                    held = [merge(held)]
                    size = len(held[0].counts)
        if held:
            yield frequent(merge(held))

    return run


def frequent_phrases(codes: DataFrame, packing: Packing, n_words: int, least: int, shorter=None) -> DataFrame:
    """ids, a, hash: phrases that occur at least `least` times in codes. Stored."""
    range_bits = max(RANGES, n_words // RANGE).bit_length() - 1
    range_bits = min(range_bits, packing.width - SLOT_BITS - 1)
    spark = codes.sparkSession
    rows = codes.mapInArrow(_filters(packing, range_bits, shorter), "number long, filter binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << range_bits) // 8)
    ordered = rows.repartition(parts, "number").sortWithinPartitions("number")
    return stored(ordered.mapInArrow(_merged(packing, range_bits, least), "ids array<long>, a long, hash long"))


# Scores


def _joined(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows joined with side by key, where a few keys of rows may be very frequent."""
    counted = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).join(side, key))
    return join_counted(rows, counted, key, "_n")


def _scores(length: int) -> Column:
    """The lowest-scoring cut as score, k, l, r; before: counts of the first words, after: of the last ones, by number of words."""

    def at(k: int) -> Column:
        left, right = f"before[{k - 1}]", f"after[{length - k - 1}]"
        product = "1000BD * cast(a as decimal(16,0)) * cast(n as decimal(17,0))"
        score = F.expr(f"({product}) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")
        return F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r"))

    return F.array_min(F.array(*[at(k) for k in range(1, length)]))


def phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that no longer one replaces. See collocations."""
    docs = only(docs, "lang", "text").select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    counts = stored(word_counts(docs))
    langs = stored(counts.groupBy("lang").agg(F.sum("f").alias("n"), F.sum((F.col("f") >= least).cast("long")).alias("n_words")).filter("n_words > 0"))
    # numbers by falling count, so that the most frequent words are the first ones
    vocabulary = stored(with_sum_before(counts.filter(F.col("f") >= least), [F.desc("f"), F.col("lang"), F.col("word")], F.lit(1), "before").select("lang", "word", "f", (F.col("before") + 1).alias("id")))
    total = langs.agg(F.sum("n").alias("n"), F.sum("n_words").alias("words")).first()
    n_words, n_ids = total["n"] or 0, total["words"] or 0
    empty = spark.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")
    if not n_ids:
        return empty
    bits = max(12, int(n_ids).bit_length())
    head: dict[str, dict[bytes, int]] = defaultdict(dict)
    for r in vocabulary.filter(F.col("id") <= HEAD).toLocalIterator():
        head[r["lang"]][bytes(r["word"])] = r["id"]
    shared = spark.sparkContext.broadcast(dict(head))
    texts = docs
    if n_ids > HEAD:
        numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()))
        others = vocabulary.filter(F.col("id") > HEAD).select("lang", "word", "id", "f")
        tail = bitmap(others.mapInArrow(_hashed_words, "hash long"), n_ids - HEAD)
        met = stored(numbered.mapInArrow(_rare_words(shared, tail), "row long, lang string, word binary").withColumn("key", F.struct("lang", "word")))
        named = join_counted(met.select("row", "key"), others.select(F.struct("lang", "word").alias("key"), "id", "f"), "key", "f")
        own = named.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct(F.col("key.word").alias("word"), "id")).alias("own"))
        texts = numbered.join(own, F.col("row") == F.col("of"), "left").select("lang", "text", "own")
    codes = stored(texts.mapInArrow(_encode(shared, bits), "codes binary"))

    # one table for each length: ids, what the next length takes over, and the phrase itself
    words = vocabulary.select("lang", F.array("id").alias("ids"), F.col("f").alias("a"), F.col("word").cast("string").alias("phrase"))
    level = stored(join_counted(words, langs.select("lang", "n", "n_words"), "lang", "n_words").select("lang", "n", "ids", "a", "phrase", F.col("phrase").alias("last"), F.array("a").alias("before"), F.array("a").alias("after")))
    shorter, out = None, empty
    waiting: DataFrame | None = None
    for length in range(2, longest + 1):
        packing = Packing(length, bits)
        found = frequent_phrases(codes, packing, n_words, least, shorter)
        n_found = found.count()
        if n_found:
            shorter = bitmap(found.select("hash"), n_found)
            first = level.select(F.col("ids").alias("head"), "lang", "n", "before", F.col("phrase").alias("start"), F.col("a").alias("a_head"))
            rest = level.select(F.col("ids").alias("tail"), "after", "last", F.col("a").alias("a_tail"))
            rows = stored(_joined(found.select("ids", "a", F.slice("ids", 1, length - 1).alias("head")), first, "head").withColumn("tail", F.slice("ids", 2, length - 1)).drop("head"))
            rows = _joined(rows, rest, "tail")
            new = stored(rows.select(
                "lang", "n", "ids", "a", F.concat_ws(" ", "start", "last").alias("phrase"), "last", F.concat("before", F.array("a")).alias("before"), F.concat("after", F.array("a")).alias("after"),
                _scores(length).alias("cut"), F.col("a_head") <= F.col("a"), F.col("a_tail") <= F.col("a"),
            ).toDF("lang", "n", "ids", "a", "phrase", "last", "before", "after", "cut", "replaces_head", "replaces_tail"))
        if waiting is not None:
            if n_found:
                # each phrase has at most one longer one as frequent on either side
                gone = new.filter("replaces_head").select(F.slice("ids", 1, length - 1).alias("ids")).union(new.filter("replaces_tail").select(F.slice("ids", 2, length - 1).alias("ids")))
                waiting = waiting.join(gone.distinct(), "ids", "left_anti")
            out = out.union(_result(waiting))
        if not n_found:
            return out
        level = waiting = new
    return out.union(_result(waiting)) if waiting is not None else out


def _result(rows: DataFrame) -> DataFrame:
    return rows.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))


def collocations(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the top phrases by score, then count, then phrase.

    docs: lang, text. A-Z is lower-cased; pieces lie between .,;:!? and line ends, words in them between spaces and
    tabs. Candidates are phrases of 2 to `longest` words with a >= least occurrences within pieces. Of all cuts in two
    the lowest floor(1000 * a * n / (l * r)) counts, at ties the first; n: the language's words. Candidates inside a
    longer one that is as frequent are left out. A null lang is `und`, a null or empty text has no words; rows that
    repeat count each; an empty table gives no rows. Other columns of docs are not read. Computes while it is called,
    and writes to the checkpoint folder.
    """
    rows = stored(phrases(docs, least, longest))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = 1 + rows.count() // PICK
    if parts > 1:  # the best of each part first, so that no task sorts a whole language
        part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
        rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(docs: list[tuple], least: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> list[tuple]:
    """The definition over a few (lang, text) rows, for tests."""
    import re

    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, text in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                counts[UNKNOWN if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -s) for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top])]
    return out

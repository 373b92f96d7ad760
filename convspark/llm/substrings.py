"""Removal of repeated windows of words, found in FM-indexes of shards.

A window is WINDOW consecutive words. Its key is the least hash of the runs of GRAM words in it, so that equal windows have
equal keys wherever they occur. Keys that two documents have are kept in a bitmap of bounded size, and consecutive windows
that share such a key make a segment. Equal segments are folded, with the smallest doc_id that has them. A shard takes
segments by key, so that all copies of a window meet in one. Keys that over FREQUENT segments share give way: their windows
go each by its own hash, and no shard gets more than a bounded group.

A shard's segments, end to end, are a text that is indexed: its Burrows-Wheeler transform, from suffixes sorted by their
first SORTED words, in a wavelet tree over the numbers of the shard's words. Streamed windows are searched backwards, word
by word, all of a shard at a time: their matching statistics, which need to tell only whether WINDOW words match, and where.
Of the suffixes that match, the smallest doc_id counts. Documents then look up their segments' verdicts, and windows that a
smaller doc_id has are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import only, stored, utf8
from convspark.llm.filters import bitmap, mixed, passes
from convspark.llm.suffixes import _runs, _sliding

WINDOW, GRAM = 13, 5
#: Suffixes are sorted by so many words: a power of two from WINDOW on.
SORTED = 16
#: Segments that share a key before its windows go each by its own hash.
FREQUENT = 2048
#: Segments that a task folds at a time; words of a shard, which ends with a key.
FOLD, SHARD = 1 << 18, 1 << 20


# The index


class WaveletTree:
    """Ranks in a sequence of numbers under 2**levels: bits of one level after the other, zeros first below each."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.n = levels, len(values)
        self.words, self.before, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bits = (values >> level) & 1 != 0
            padded = np.zeros((self.n // 64 + 1) * 64, dtype=bool)
            padded[: self.n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.bitwise_count(words).astype(np.int32)
            self.words.append(words)
            self.before.append(np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int32))
            self.zeros.append(self.n - int(counts.sum()))
            values = np.concatenate((values[~bits], values[bits]))
        #: Where each number's run starts at the bottom.
        self.starts = self._down(np.arange(1 << levels), np.zeros(1 << levels, dtype=np.int64))

    def _down(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            bit = (numbers >> (self.levels - 1 - k)) & 1 != 0
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each number occurs before its place."""
        return self._down(numbers, at) - self.starts[numbers]


class Index:
    """FM-index of a text of numbers from 0 to n_symbols - 1 that ends with 0, for searches of up to SORTED numbers other than 0."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        ranks = text.astype(np.int64)
        size = 1
        while size < SORTED:
            follow = np.zeros_like(ranks)
            follow[:-size] = ranks[size:] + 1
            pairs = ranks * (len(text) + n_symbols + 1) + follow
            self.order = np.argsort(pairs, kind="stable")
            ordered = pairs[self.order]
            ranks = np.empty_like(ranks)
            ranks[self.order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
            size *= 2
        self.tree = WaveletTree(np.roll(text, 1)[self.order], max(1, int(n_symbols - 1).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))

    def search(self, text: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """low, high, matched: the suffixes that start with the last `matched` of the `length` numbers of text from each place.

        A search ends early where one suffix only is left, or none.
        """
        numbers = text[at + length - 1]
        low, high = self.first[numbers], self.first[numbers + 1]
        matched = np.ones(len(at), dtype=np.int64)
        going = np.flatnonzero(high - low > 1)
        for k in range(length - 2, -1, -1):
            if not len(going):
                break
            numbers = text[at[going] + k]
            low[going] = self.first[numbers] + self.tree.rank(numbers, low[going])
            high[going] = self.first[numbers] + self.tree.rank(numbers, high[going])
            matched[going] += 1
            going = going[high[going] - low[going] > 1]
        return low, high, matched


def least_owners(segments: list[list[bytes]], owners: np.ndarray) -> list[np.ndarray]:
    """For each window of each segment the least owner of a segment that has it."""
    numbers: dict[bytes, int] = {}
    lengths = np.array([len(s) for s in segments])
    text = np.zeros(int(lengths.sum()) + len(segments), dtype=np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    for start, segment in zip(starts.tolist(), segments, strict=True):
        text[start : start + len(segment)] = [numbers.setdefault(w, len(numbers) + 1) for w in segment]
    index = Index(text, len(numbers) + 1)
    windows = lengths - WINDOW + 1
    ends = np.cumsum(windows)
    of = np.repeat(np.arange(len(segments)), windows)
    at = np.arange(len(of)) - np.repeat(ends - windows, windows) + starts[of]
    low, high, matched = index.search(text, at, WINDOW)
    least = owners[of]  # a search that ended early has met its own window only
    shared = np.flatnonzero((matched == WINDOW) & (high - low > 1))
    if len(shared):
        owner = owners[np.repeat(np.arange(len(segments)), lengths + 1)][index.order]
        lows, place = np.unique(low[shared], return_inverse=True)
        highs = np.zeros(len(lows), dtype=np.int64)
        highs[place] = high[shared]
        # windows of one length have the same suffixes or none in common
        edges = np.stack([lows, np.minimum(highs, len(owner) - 1)], axis=1).ravel()
        found = np.minimum.reduceat(owner, edges)[::2]
        found = np.where(highs == len(owner), np.minimum(found, owner[-1]), found)
        least[shared] = found[place]
    return np.split(least, ends[:-1])


# Segments


def _keys(words: list[bytes]) -> np.ndarray:
    """The key of each window."""
    if len(words) < WINDOW:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return _sliding(mixed(_runs(hashes, GRAM)), WINDOW - GRAM + 1, np.minimum)


def _segment_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, low, high, n: keys of segments, folded by slices."""

    def flush(keys: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        key, own = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        starts = _segment_starts(key)
        cells = (key[starts].view(np.int64), np.minimum.reduceat(own, starts), np.maximum.reduceat(own, starts), np.diff(np.append(starts, len(key))))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["key", "low", "high", "n"])

    keys, ids, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            own = _keys(text.split())
            own = own[_segment_starts(own)]
            if len(own):
                keys.append(own)
                ids.append(np.full(len(own), doc_id, dtype=np.int64))
                size += len(own)
            if size >= FOLD:
                yield flush(keys, ids)
                keys, ids, size = [], [], 0
    if size:
        yield flush(keys, ids)


def _found(text: bytes, shared: np.ndarray, frequent: np.ndarray) -> Iterator[tuple[int, list[bytes], int]]:
    """key, words, start of the segments of a text that may be shared; a frequent key's are cut into windows."""
    words = text.split()
    keys = _keys(words)
    starts = _segment_starts(keys)
    ends = np.append(starts[1:], len(keys))
    own = keys[starts]
    keep = passes(shared, own)
    split = passes(frequent, own)
    for key, start, end, cut in zip(own[keep].view(np.int64).tolist(), starts[keep].tolist(), ends[keep].tolist(), split[keep].tolist(), strict=True):
        if cut:
            for at in range(start, end):
                window = words[at : at + WINDOW]
                yield xxhash.xxh64_intdigest(b" ".join(window)) - (1 << 63), window, at
        else:
            yield key, words[start : end + WINDOW - 1], start


def _segments(shared, frequent):
    """key, segment, owner: segments folded by task, each with its least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], int] = {}

        def flush() -> pa.RecordBatch:
            keys, segments = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(segments, pa.binary()), pa.array(held.values(), pa.int64())], names=["key", "segment", "owner"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                for key, words, _ in _found(text, shared.value, frequent.value):
                    segment = (key, b" ".join(words))
                    before = held.get(segment)
                    if before is None or doc_id < before:
                        held[segment] = doc_id
                if len(held) >= FOLD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


def _name(segment: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_intdigest(segment)
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """name, check, least: of each segment's windows the least doc_id that has them. Rows come by key."""
    held: dict[bytes, int] = {}
    size, last = 0, None

    def shard() -> pa.RecordBatch:
        found = least_owners([s.split(b" ") for s in held], np.fromiter(held.values(), dtype=np.int64, count=len(held)))
        names, checks = zip(*map(_name, held), strict=True)
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(checks, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))], names=["name", "check", "least"])

    for batch in batches:
        for key, segment, owner in zip(batch.column("key").to_pylist(), batch.column("segment").to_pylist(), batch.column("owner").to_pylist(), strict=True):
            if key != last and size >= SHARD:
                yield shard()
                held, size = {}, 0
            last = key
            if segment not in held:
                held[segment], size = owner, size + segment.count(b" ") + 1
            elif owner < held[segment]:
                held[segment] = owner
    if held:
        yield shard()


def _occurrences(shared, frequent):
    """name, check, doc_id, of, start: where each document has its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list[int], ...] = ([], [], [], [], [])
            for doc_id, of, text in zip(batch.column("doc_id").to_pylist(), batch.column("of").to_pylist(), utf8(batch.column("text")), strict=True):
                for _, words, start in _found(text, shared.value, frequent.value):
                    for column, value in zip(rows, (*_name(b" ".join(words)), doc_id, of, start), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["name", "check", "doc_id", "of", "start"])

    return run


def repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, of (a hash of the text), starts: the words that windows start at which a smaller doc_id has, too.

    docs: doc_id, text. Rows with a null doc_id are left out: they are no smaller and no larger than others.
    """
    docs = only(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    keys = docs.mapInArrow(_met, "key long, low long, high long, n long").groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    keys = stored(keys.filter("low < high").select(F.col("key").alias("hash"), "n"))
    sizes = keys.agg(F.count("*").alias("n"), F.count_if(F.col("n") > FREQUENT).alias("frequent")).first()
    shared, frequent = bitmap(keys, sizes["n"]), bitmap(keys.filter(F.col("n") > FREQUENT), sizes["frequent"])
    segments = docs.mapInArrow(_segments(shared, frequent), "key long, segment binary, owner long")
    judged = segments.repartition("key").sortWithinPartitions("key").mapInArrow(_judged, "name long, check long, least array<long>")
    # only windows that some document loses are looked up; large groups of equal segments are split by Spark as it joins
    judged = judged.select("name", F.col("check").alias("is"), "least")
    places = docs.select("doc_id", F.xxhash64("text").alias("of"), "text").mapInArrow(_occurrences(shared, frequent), "name long, check long, doc_id long, of long, start long")
    met = places.join(judged, "name").filter(F.col("check") == F.col("is"))
    own = F.filter(F.transform("least", lambda owner, k: F.when(owner < F.col("doc_id"), F.col("start") + k)), lambda at: at.isNotNull())
    return met.select("doc_id", "of", own.alias("starts")).filter(F.size("starts") > 0).groupBy("doc_id", "of").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, starts in zip(utf8(batch.column("text")), batch.column("starts"), strict=True):
            words = text.split()
            left = words
            if starts.is_valid:
                at = starts.values.to_numpy()
                covered = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(covered, at, 1)
                np.add.at(covered, at + WINDOW, -1)
                left = [w for w, c in zip(words, np.cumsum(covered).tolist(), strict=False) if not c]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.large_string())], names=["doc_id", "n_words", "n_removed", "kept"])


def without_repeated_windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: every document without the words of windows that a smaller doc_id has, too.

    docs: doc_id, text. Words lie between ASCII white space and are compared as they are; a window is WINDOW consecutive
    ones. Windows are judged on docs as given. Kept words are joined by one space. Null, empty and shorter texts lose
    nothing, nor do rows with a null doc_id, which take nothing from others either. Rows that repeat a doc_id each give a
    row and take nothing from each other. An empty table gives no rows; other columns of docs are not read. Computes
    while it is called, and writes to the checkpoint folder.
    """
    gone = repeated_windows(docs).select(F.col("doc_id").alias("id"), "of", "starts")
    rows = only(docs, "doc_id", "text")
    joined = rows.join(gone, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("of")), "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(_cut_out, "doc_id long, n_words long, n_removed long, kept string")


def kept_digest(rows: DataFrame) -> DataFrame:
    """The result of without_repeated_windows with the kept text as a SHA-256 digest."""
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(docs: list[tuple]) -> list[tuple]:
    """The definition over a few rows, for tests."""
    split = [(i, (t or "").encode().split()) for i, t in docs]
    first: dict[tuple, int] = {}
    for i, words in split:
        for k in range(len(words) - WINDOW + 1 if i is not None else 0):
            window = tuple(words[k : k + WINDOW])
            first[window] = min(first.get(window, i), i)
    out = []
    for i, words in split:
        gone: set[int] = set()
        for k in range(len(words) - WINDOW + 1 if i is not None else 0):
            if first[tuple(words[k : k + WINDOW])] < i:
                gone.update(range(k, k + WINDOW))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out

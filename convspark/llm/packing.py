"""Best-fit packing by large-item matching.

Only lengths decide a packing, and there are at most `capacity` of them. So tasks tokenise and count; the histogram of
lengths (at most `capacity` rows, whatever the corpus) is packed on the driver; the packing is a list of runs "pieces
of this length and these ranks go to these sequences at this place"; and tasks look up each piece's rank in it.

Lengths above one third of the capacity are matched greedily, the longest with the longest that still fits, at most two
to a sequence. Smaller lengths, longest first, go where they leave the smallest gap.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import cut, only, utf8, worker_cache

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker keeps twice: those met lately, and those met before. The results don't depend on it.
CACHE_WORDS = 450_000
#: Pieces that are ranked by one task.
RANKED = 50_000
# How a tokenizer is set up under which words can be encoded by themselves.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SIMPLE_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """A tokenizer and the ids of the words it has met, as little-endian unsigned 32-bit integers.

    Where the tokenizer drops white space and splits letters from other characters, words between ASCII white space
    are encoded by themselves, and of those made of Latin letters and ASCII marks the letters are one word for its
    model, in lower case. Other words, and whole texts under other tokenizers, go through all of it.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most, self.lately, self.before, self.stems, self.marks = Tokenizer.from_file(path), most, {}, {}, {}, {}
        # part by part: the whole of it as text and as a dictionary would hold the vocabulary twice more
        alike = lambda part, wanted: part is not None and json.loads(part.__getstate__()) == wanted
        self.by_word = alike(self.tokenizer.normalizer, NORMALIZER) and alike(self.tokenizer.pre_tokenizer, PRE_TOKENIZER) and not any(t.normalized for t in self.tokenizer.get_added_tokens_decoder().values())
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}

    def encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, word: str) -> bytes:
        m = SIMPLE_WORD.fullmatch(word)
        if not m:
            return self.encode(word)
        letters, mark = m[1].lower(), m[2]
        if letters not in self.stems:
            if len(self.stems) >= self.most:
                self.stems.clear()
            coded = letters if letters.isascii() else letters.translate(self.bytes_of)
            self.stems[letters] = struct.pack(f"<{len(ids := [t.id for t in self.tokenizer.model.tokenize(coded)])}I", *ids)
        if not mark:
            return self.stems[letters]
        if mark not in self.marks:
            if len(self.marks) >= self.most:
                self.marks.clear()
            self.marks[mark] = self.encode(mark)
        return self.stems[letters] + self.marks[mark]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            coded = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(c.ids, dtype="<u4").tobytes() for c in coded]
        words = [t.split() for t in texts]
        met = set().union(*words)
        new = {w for w in met if w not in self.lately}
        if len(self.lately) + len(new) > self.most:
            self.lately, self.before, new = {}, self.lately, met
        known = {w for w in new if w in self.before}
        self.lately.update(zip(known, map(self.before.__getitem__, known), strict=True))
        for word in new - known:
            self.lately[word] = self.learn(word.decode())
        find = self.lately.__getitem__
        return [b"".join(map(find, ws)) for ws in words]


def text_ids(texts: list[bytes], path: str, cache_words: int = CACHE_WORDS) -> list[bytes]:
    """Token ids of each text."""
    known = worker_cache("packing")
    if (path, cache_words) not in known:
        known.clear()
        known[path, cache_words] = Words(path, cache_words)
    return known[path, cache_words].ids(texts)


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool, cache_words: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[tuple] = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), text_ids(list(utf8(batch.column("text"))), path, cache_words), strict=True):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        rows.append((doc_id, piece, start // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names).select(names if with_ids else names[:-1])

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian unsigned 32-bit).

    Fewer cache_words take less of a worker's memory and more of its time; the rows are the same."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return only(docs, "doc_id", "text").mapInArrow(_pieces(path or default_tokenizer(), capacity, end_id, with_ids, cache_words), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Runs (length, rank, each, sequence, offset): pieces of that length from that rank on go, `each` to a sequence,
    to that sequence and the following ones, from that offset on. Sorted by length and rank."""
    left, rank, runs, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: list[int] = []
    room: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, each: int, first: int, n: int, offset: int) -> None:
        runs.append((length, rank[length], each, first, offset))
        rank[length] += n * each
        left[length] -= n * each

    def free(first: int, n: int, gap: int) -> None:
        if n and gap:
            if gap not in room:
                room[gap] = []
                bisect.insort(gaps, gap)
            room[gap].append((first, n))

    large = sorted(x for x in left if 3 * x > capacity)
    while large:
        length = large[-1]
        at = bisect.bisect_right(large, capacity - length)
        other = large[min(at, len(large)) - 1] if at else None
        if other == length:
            n = left[length] // 2
            if n:
                put(length, 2, sequences, n, 0)
                free(sequences, n, capacity - 2 * length)
            else:
                other = large[-2] if len(large) > 1 else None
        if other != length:
            n = min(left[length], left[other]) if other else left[length]
            put(length, 1, sequences, n, 0)
            if other:
                put(other, 1, sequences, n, length)
            free(sequences, n, capacity - length - (other or 0))
        sequences += n
        large = [x for x in large if left[x]]

    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, left[length])
                n = left[length] // each
                put(length, each, sequences, n, 0)
                free(sequences, n, capacity - each * length)
                sequences += n
                continue
            gap = gaps[at]
            first, n_free = room[gap].pop()
            if not room[gap]:
                del room[gap], gaps[at]
            each = min(gap // length, left[length])
            n = min(n_free, left[length] // each)
            put(length, each, first, n, capacity - gap)
            free(first, n, gap - each * length)
            free(first + n, n_free - n, gap)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        keys = (runs[:, 0] << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            _, first, each, sequence, offset = runs[np.searchsorted(keys, (length << 44) + rank, side="right") - 1].T
            arrays = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence + (rank - first) // each), pa.array(offset + (rank - first) % each * length)], names=[*names, "sequence_id", "offset"])

    return run


def assign(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. cut_pieces, checkpointed: doc_id, piece, length (1 to capacity) and any others.

    A length's pieces are ranked in salted parts, so that a length which many pieces have is not one task's work.
    """
    spark = cut_pieces.sparkSession
    n = cut_pieces.count()
    # the row's place tells rows apart that are alike in everything; cut_pieces is materialised, so that it is always the same
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(1 + n // RANKED)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("own", own).join(before, ["length", "salt"]).select(*[salted[c] for c in cut_pieces.columns], (F.col("own") + F.col("before")).alias("rank"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema)
    return ranked.mapInArrow(_place(shared), f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every document's tokens packed into sequences.

    A document is the ids of its whole text and end_id; longer ones are cut into pieces of `capacity` tokens. A null
    or empty text is end_id alone. Rows that repeat a doc_id are packed each; an empty table gives no rows. Other
    columns of docs are not read.
    """
    return assign(cut(pieces(docs, path, capacity, end_id, cache_words=cache_words)), capacity)


def packed_sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (binary): the packed sequences themselves, each of at most `capacity` tokens."""
    placed = assign(cut(pieces(docs, path, capacity, end_id, with_ids=True)), capacity)
    parts = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))

"""Line dedup with two Bloom filters.

A first pass hashes every line key and builds two Bloom filters: keys seen once, and keys seen in a second document.
Filters are made of blocks of 2**BLOCK_BITS bits, with all bits of a key in one block, and have eight bits a line,
however many lines there are. Tasks emit set bits by block; the blocks merge in a shuffle, where a bit that two tasks set
for "once" is also set for "twice", so no repeated key can be missed. Only keys that the twice filter suspects are
shuffled, as text, for exact counts and the choice of the first occurrence.

A filter of up to 2**BROADCAST_BITS bits is broadcast to test the keys. A larger one stays distributed: hashes are dealt
to the blocks, which are frequent keys' blocks by broadcast and all others in a shuffle of 16 bytes a line.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import cut, join_counted, only, utf8, worker_cache

BLOCK_BITS = 17
MIN_BITS, BROADCAST_BITS = 20, 28
FLUSH = 500_000


def line_key(line: bytes) -> bytes:
    """ASCII white space off both ends, A-Z lower-cased."""
    return line.strip().lower()


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def document_keys(text: bytes, min_chars: int) -> set[bytes]:
    return {k for k in set(map(line_key, text.split(b"\n"))) if k and _long_enough(k, min_chars)}


def bit_positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two positions a hash in a filter of 2**bits bits, both in the block that its upper bits choose; shape (n, 2)."""
    block, mask = (hashes >> np.uint64(64 - bits + BLOCK_BITS)) << np.uint64(BLOCK_BITS), np.uint64((1 << BLOCK_BITS) - 1)
    return np.stack([block | hashes & mask, block | (hashes >> np.uint64(BLOCK_BITS)) & mask], axis=1)


def _blocks(hashes: np.ndarray, bits: int) -> Iterator[dict]:
    """Bits to set, by block of the filter. A key comes once from each document, so a repeat here is a second one."""
    keys, counts = np.unique(hashes, return_counts=True)
    parts = {name: np.unique(bit_positions(h, bits)) for name, h in (("once", keys), ("twice", keys[counts > 1]))}
    lines = np.sort(hashes >> np.uint64(64 - bits + BLOCK_BITS))
    blocks = np.unique(parts["once"] >> np.uint64(BLOCK_BITS))
    for block in blocks:
        row = {"block": int(block), "lines": int(np.diff(np.searchsorted(lines, [block, block + np.uint64(1)]))[0])}
        for name, positions in parts.items():
            lo, hi = np.searchsorted(positions, [block << np.uint64(BLOCK_BITS), (block + np.uint64(1)) << np.uint64(BLOCK_BITS)])
            row[name] = (positions[lo:hi] & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32).tobytes()
        yield row


def _filter_bits(bits: int, min_chars: int):
    schema = pa.schema([("block", pa.int64()), ("lines", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])

    def flush(hashes: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(list(_blocks(np.array(hashes, dtype=np.uint64), bits)), schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lines: bits")
        hashes: list[int] = []
        for batch in batches:
            for text in utf8(batch.column("text")):
                hashes.extend(map(xxhash.xxh64_intdigest, document_keys(text, min_chars)))
                if len(hashes) >= FLUSH:
                    yield flush(hashes)
                    hashes = []
        if hashes:
            yield flush(hashes)

    return run


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, from all tasks: bounded, as the number of blocks follows the number of lines."""
    worker_cache("lines: blocks")
    block, n = None, 0
    once, twice = (np.zeros(1 << BLOCK_BITS, dtype=bool) for _ in range(2))

    def merged() -> pa.RecordBatch:
        bits = zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([bits], pa.binary())], names=["block", "n", "bits"])

    for batch in batches:
        for own, lines, first, second in zip(*(batch.column(c).to_pylist() for c in ("block", "lines", "once", "twice")), strict=True):
            if own != block:
                if block is not None:
                    yield merged()
                block, n = own, 0
                once[:] = twice[:] = False
            at = np.frombuffer(first, dtype=np.uint32)
            twice[at[once[at]]] = True
            once[at] = True
            twice[np.frombuffer(second, dtype=np.uint32)] = True
            n += lines
    if block is not None:
        yield merged()


def filter_bits(docs: DataFrame) -> int:
    """The logarithm of the filter's size: eight bits a line at least."""
    n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 1
    return max(MIN_BITS, int(n * 8 - 1).bit_length())


def twice_filter(docs: DataFrame, bits: int, min_chars: int = 1) -> DataFrame:
    """block, n (its lines), bits (compressed): the twice-seen filter over the line keys of docs.text."""
    rows = docs.select("text").mapInArrow(_filter_bits(bits, min_chars), "block long, lines long, once binary, twice binary")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(_merge_blocks, "block long, n long, bits binary")


def _unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(block), dtype=np.uint8)


def _seen(at: np.ndarray, packed: np.ndarray) -> np.ndarray:
    return np.flatnonzero(((packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1))


def _suspects(shared, bits: int, min_chars: int):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lines: suspects")
        packed = shared.value
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                own = document_keys(text, min_chars)
                ids.extend([doc_id] * len(own))
                keys.extend(own)
            if keys:
                keep = _seen(bit_positions(np.fromiter(map(xxhash.xxh64_intdigest, keys), dtype=np.uint64, count=len(keys)), bits), packed)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep], pa.int64()), pa.array([keys[i] for i in keep], pa.binary())], schema=schema)

    return run


def _dealt(bits: int, min_chars: int):
    """block, ids, hashes: of each block the documents and the hashes of their keys."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])

    def flush(ids: list[int | None], hashes: list[int]) -> pa.RecordBatch:
        values = np.array(hashes, dtype=np.uint64)
        order = np.argsort(values)
        block = (values >> np.uint64(64 - bits + BLOCK_BITS))[order].astype(np.int64)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        offsets = pa.array(np.append(starts, len(block)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(ids, pa.int64()).take(pa.array(order)), pa.array(values[order].view(np.int64)))]
        return pa.RecordBatch.from_arrays([pa.array(block[starts]), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        hashes: list[int] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
                own = document_keys(text, min_chars)
                hashes.extend(map(xxhash.xxh64_intdigest, own))
                ids.extend([doc_id] * len(own))
                if len(hashes) >= FLUSH:
                    yield flush(ids, hashes)
                    ids, hashes = [], []
        if hashes:
            yield flush(ids, hashes)

    return run


def _tested(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, hashes = (batch.column(c)[row].values for c in ("ids", "hashes"))
                at = bit_positions(hashes.to_numpy().view(np.uint64), bits) & np.uint64((1 << BLOCK_BITS) - 1)
                keep = pa.array(_seen(at, _unpacked(batch.column("bits")[row].as_py())))
                yield pa.RecordBatch.from_arrays([ids.take(keep), hashes.take(keep)], names=["doc_id", "hash"])

    return run


def _named(min_chars: int):
    """The keys of a document whose hashes are suspected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text, hashes in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("hashes").to_pylist(), strict=True):
                found = set(hashes)
                own = [k for k in document_keys(text, min_chars) if int(np.uint64(xxhash.xxh64_intdigest(k)).view(np.int64)) in found]
                ids.extend([doc_id] * len(own))
                keys.extend(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["doc_id", "key"])

    return run


def suspects(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, key: all keys that two documents have, and few others. docs: doc_id, text."""
    bits = filter_bits(docs)
    blocks = twice_filter(docs, bits, min_chars)
    if bits <= BROADCAST_BITS:
        packed = np.zeros(1 << (bits - 3), dtype=np.uint8)
        width = 1 << (BLOCK_BITS - 3)
        for row in blocks.toLocalIterator():
            packed[row["block"] * width : (row["block"] + 1) * width] = _unpacked(row["bits"])
        return docs.mapInArrow(_suspects(docs.sparkSession.sparkContext.broadcast(packed), bits, min_chars), "doc_id long, key binary")
    dealt = docs.mapInArrow(_dealt(bits, min_chars), "block long, ids array<long>, hashes array<long>")
    tested = join_counted(dealt, cut(blocks), "block", "n").mapInArrow(_tested(bits), "doc_id long, hash long")
    by_doc = tested.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("hash").alias("hashes"))
    joined = docs.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "hashes")
    return joined.mapInArrow(_named(min_chars), "doc_id long, key binary")


def repeated_keys(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, key, first_doc: for every document the keys it has that at least min_docs documents have.

    docs: doc_id long, text string. A key is in one row for each document that has it, however often.
    """
    found = cut(suspects(only(docs, "doc_id", "text"), min_chars))
    # cut, so that the join below has an exchange on either side and Spark can split a key that many documents have
    decided = cut(found.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc")).filter(F.col("n_docs") >= min_docs))
    return join_counted(found, decided, "key", "n_docs")


def _apply(keep_first: bool):
    names = ["doc_id", "n_lines", "n_dropped", "kept", "carried"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lines: texts")
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys, firsts in zip(utf8(batch.column("text")), batch.column("keys").to_pylist(), batch.column("firsts").to_pylist(), strict=True):
                lines = text.split(b"\n")
                left = lines
                if keys:
                    gone, once = set(keys), set(firsts or ()) if keep_first else set()
                    left = []
                    for line in lines:
                        key = line_key(line)
                        if key not in gone:
                            left.append(line)
                        elif key in once:
                            once.discard(key)
                            left.append(line)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.large_string()), batch.column("carried")], names=names)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept and the columns to carry: each document without the lines that at least min_docs documents have.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of under min_chars code
    points stay. keep="first" keeps one such line, the first in the document of the smallest doc_id. A null or empty
    text is one empty line, which stays; an empty table gives no rows. Rows that repeat a doc_id each give a row, and
    each counts as a document. Columns of docs that are not named are not read.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep: {keep!r}")
    hits = repeated_keys(docs, min_docs, min_chars)
    by_doc = hits.groupBy(F.col("doc_id").alias("hit_id")).agg(
        F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("doc_id").eqNullSafe(F.col("first_doc")), F.col("key"))).alias("firsts")
    )
    carried = F.struct(*[docs[c] for c in carry]) if carry else F.struct(F.lit(True).alias("_"))
    rows = docs.select(docs["doc_id"], docs["text"], carried.alias("carried"))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select("doc_id", "text", "keys", "firsts", "carried")
    out = joined.mapInArrow(_apply(keep == "first"), f"doc_id long, n_lines long, n_dropped long, kept string, carried {rows.schema['carried'].dataType.simpleString()}")
    return out.select("doc_id", "n_lines", "n_dropped", "kept", *[F.col("carried")[c].alias(c) for c in carry])


def kept_digest(deduped: DataFrame) -> DataFrame:
    """The result of dedup_lines with the kept text as a SHA-256 digest."""
    return deduped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute(docs: list[tuple], min_docs: int = 10, min_chars: int = 1) -> list[tuple]:
    """The definition over a few rows, for tests."""
    from collections import Counter

    split = [(i, (t or "").encode().split(b"\n")) for i, t in docs]
    counts = Counter(k for _, lines in split for k in {line_key(x) for x in lines})
    out = []
    for i, lines in split:
        left = [x for x in lines if not (len(line_key(x).decode()) >= max(1, min_chars) and counts[line_key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256(b"\n".join(left)).hexdigest()))
    return out

"""SimHash near-duplicates by deletion variants of fingerprint segments.

A 64-bit fingerprint is cut into two segments of 32 bits, so that of two fingerprints at most two bits apart one
segment differs by at most one bit. Each segment is indexed with each of its bits left out in turn: 64 entries, of which
two fingerprints share one exactly if a segment of theirs differs by at most one bit. Two
fingerprints that share an entry are candidates, and verified: all of their bits are compared.

An entry that more fingerprints share, as those of near copies do, is split by the other segment: its fingerprints are
indexed whole, as they are and with each one bit changed. Any two at most two bits apart share such a value (one of them,
or the one half-way) and a value has at most 65 fingerprints, so that each is linked to the smallest. So neither entries
nor pairs grow with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import cut, join_counted, only, spread, utf8
from convspark.llm.components import connected_components

SLICE = 1 << 16
#: Segment and bit left out in the upper half, the segment without that bit in the lower.
ENTRIES = (
    "transform(sequence(0L, 63L), k -> shiftleft(k, 32) | "
    "(if(k < 32, fp & 4294967295L, shiftrightunsigned(fp, 32)) & ~shiftleft(1L, cast(k % 32 as int))))"
)
#: A fingerprint with no bit and with each one bit changed.
CHANGED = "transform(sequence(0, 64), k -> if(k = 64, fp, fp ^ shiftleft(1L, k)))"


def shingle_hashes(text: bytes, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each run of `words` lower-cased words; of the whole sequence if it is shorter; none without words."""
    tokens = text.lower().split()
    if not tokens:
        return []
    clean = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(clean, seed)]
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(clean[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]


def fingerprint(hashes: list[int]) -> int:
    """The bits that over half the hashes have."""
    if not hashes:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), SLICE):
        part = values[at : at + SLICE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t, words, seed)) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return only(docs, "doc_id", "text").mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """a, b: links that connect all fingerprints of distinct(fp) which chains of at most two changed bits connect."""
    entries = spread(distinct.select("fp"), "fp").select("fp", F.explode(F.expr(ENTRIES)).alias("entry"))
    shared = cut(entries.groupBy("entry").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    two = shared.filter("n = 2").select("a", "b").filter(close)
    whole = join_counted(entries, shared.filter("n > 2").select("entry", "n"), "entry", "n").select("fp").distinct()
    values = whole.select("fp", F.explode(F.expr(CHANGED)).alias("value"))
    more = values.select(F.min("fp").over(Window.partitionBy("value")).alias("a"), F.col("fp").alias("b")).filter(F.col("a") != F.col("b")).filter(close)
    return two.union(more)


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of two or fewer bits reach.

    Texts: A-Z lower-cased, words between ASCII white space, shingles of `words` words with repeats. A shorter text is
    one shingle; a null, empty or blank one has fingerprint zero and links like any other. Rows that repeat a doc_id
    each give a row. Other columns of docs are not read; an empty table gives no rows.
    """
    own = cut(fingerprints(docs, words, seed))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(distinct))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute(docs: list[tuple], words: int = 3, seed: int = 42) -> list[tuple]:
    """The definition over a few rows, for tests: every pair is compared."""
    prints = []
    for doc_id, text in docs:
        tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        runs = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
        h = [xxhash.xxh64_intdigest(r, seed) for r in runs]
        prints.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = list(range(len(prints)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, f"{p:016x}", least[find(i)]) for i, (doc_id, p) in enumerate(prints)]

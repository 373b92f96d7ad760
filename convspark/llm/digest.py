"""Canonical exact digests.

The canonical form of a text is its compatibility composition (NFKC), case-folded, with white space folded. Its
fingerprint is the 128-bit XXH3 of that form. Texts with equal fingerprints are the same only if their canonical bytes
are: pairs are compared where both texts are at hand, groups against the bucket's first text.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import only

#: Documents of a range of doc_id, where that doesn't make more than RANGES ranges; quantiles that ranges lie between.
RANGE, RANGES, PIECES = 2_000, 1 << 17, 64


def canonical(text: str) -> bytes:
    """NFKC, case fold, NFKC again (folding can undo it), white space runs as one space, none at the ends."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms = [canonical(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(c) for c in forms]), pa.array([len(c) for c in forms], pa.int64())], names=["doc_id", "fingerprint", "n_bytes"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (32 hex digits), n_bytes (of the canonical form); null texts as empty."""
    return only(docs, "doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fingerprint string, n_bytes long")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [hashlib.blake2b(canonical(t.as_py() or "")).hexdigest() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fingerprint"), pa.array(own)], names=["doc_id", "fingerprint", "check"])


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, group_id: the smallest doc_id of the documents with the same canonical text.

    Documents are grouped by digest; only those in buckets of several go on, and there their canonical bytes are
    compared through a second, cryptographic digest of 512 bits of them, so that no group's texts meet in one task.
    Every document has a row; null and empty texts are one group.
    """
    docs = only(docs, "doc_id", "text")
    own = fingerprints(docs)
    buckets = own.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    alone = own.join(buckets.filter("n = 1"), "fingerprint").select("doc_id", "fingerprint", F.col("first_id").alias("group_id"))
    shared = own.join(buckets.filter("n > 1"), "fingerprint", "left_semi").select(F.col("doc_id").alias("id"), "fingerprint").distinct()
    checked = docs.join(shared, docs["doc_id"].eqNullSafe(shared["id"])).select("doc_id", "text", "fingerprint").mapInArrow(_compare, "doc_id long, fingerprint string, check string")
    groups = checked.groupBy("fingerprint", "check").agg(F.min("doc_id").alias("group_id"))
    return alone.union(checked.join(groups, ["fingerprint", "check"]).select("doc_id", "fingerprint", "group_id"))


def _likeness(first: tuple[bytes, str], second: tuple[bytes, str]) -> float:
    """Of two exact digests: one if they are equal and so are the bytes, else nothing."""
    return float(first[1] == second[1] and first[0] == second[0])


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, doc_id descending; in each range `guest` rows, of the next range, come last."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True)

    def compared() -> Iterator[tuple]:
        last = None
        for block, guest, doc_id, text in rows():
            text = text or ""
            form = canonical(text)
            own = (form, digest(form))
            if last is not None and last[0] == block and not last[1]:
                _, _, before, whole, mark = last
                cut = len(whole) // 3
                edited = whole[: len(whole) - cut] + text[:cut]
                form = canonical(edited)
                changed = (form, digest(form))
                yield before, len(whole), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mark[1], changed[1], _likeness(mark, changed), _likeness(mark, own)
            last = (block, guest, doc_id, text, own)

    out: list[tuple] = []
    for row in compared():
        out.append(row)
        if len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def against_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    A document's edited text has its last n_chars // 3 code points replaced by the first as many, or all, of the next
    document's, doc_id descending; after the last comes the first. Likeness is 1 for equal digests of equal canonical
    bytes, else 0. Null texts are empty. Rows that repeat a doc_id are ordered by text; a null doc_id comes last; a
    single document is its own next. Other columns of docs are not read.

    Texts are shuffled once, by ranges of doc_id; the first rows of a range are also sent to the range before it, so
    that each task has the next text of all its rows. Ranges are even in width between quantiles of doc_id. There are
    at most some RANGES of them, which bounds the table of their first rows that is broadcast.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    seen = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", [i / PIECES for i in range(1, PIECES)], 1000).alias("at")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    splits = sorted({x for x in seen["at"] or [] if low <= x < high})
    each = max(1, min(seen["n"] // RANGE, RANGES) // PIECES)
    tops = [*splits, high]
    widths = [max(1.0, (top - bottom + 1) / each) for bottom, top in zip([low, *splits], tops, strict=True)]
    piece = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in splits]) if splits else F.array().cast("array<long>"), lambda x: x < F.col("doc_id")))
    lit = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    inside = F.floor((F.get(lit(tops), F.col("piece")) - F.col("doc_id")) / F.get(lit(widths), F.col("piece")))
    block = F.coalesce((len(tops) - F.col("piece")) * F.lit(2 * RANGES) + F.least(inside, F.lit(2 * RANGES - 1)), F.lit(1 << 62)).cast("long")
    placed = docs.withColumn("piece", piece).select("doc_id", "text", block.alias("range"))
    firsts = placed.groupBy("range").agg(F.max("doc_id").alias("first_id"))
    last = F.max("range").over(Window.partitionBy())
    sent = firsts.select(F.col("range").alias("from_range"), "first_id", F.coalesce(F.lag("range").over(Window.orderBy("range")), last).alias("to_range"))
    keyed = placed.join(F.broadcast(sent), (F.col("range") == F.col("from_range")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left").select("doc_id", "text", "range", "to_range")
    homes = F.array_compact(F.array(F.struct(F.lit(False).alias("guest"), F.col("range").alias("range")), F.when(F.col("to_range").isNotNull(), F.struct(F.lit(True).alias("guest"), F.col("to_range").alias("range")))))
    rows = keyed.select(F.inline(homes), "doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), each * PIECES // 10)
    ordered = rows.repartition(parts, "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("doc_id"), "text")
    return ordered.select("range", "guest", "doc_id", "text").mapInArrow(_with_next, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def brute(docs: list[tuple]) -> list[tuple]:
    """The definition over a few rows, for tests."""
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (-r[0], r[1].encode()))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, b, c = canonical(text), canonical(edited), canonical(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(a), digest(b), float(a == b), float(a == c)))
    return out

"""Near-duplicates by SimHash and the resemblance of shingle sets.

Two texts are alike if their sets of distinct five-word shingles have a Jaccard similarity of at least 4/5. Candidates come
from deletion variants: a fingerprint of 192 bits, each the majority over a text's distinct words, is cut into six segments
of 32 bits, of which one differs by at most one bit if at most eleven bits differ. Two texts whose segment is the same, or
the same but for one bit that is left out, are members of an entry. Segments are indexed by their distinct values, so that
what many texts share is exploded once, and an entry of one value is the value itself.

Members of an entry of up to SMALL texts are all compared. In larger ones, as copies and templates make, members meet by the
least hash of their shingles under one of MINS hash functions, which two texts alike share with a probability of their
similarity, each time, and those that only have the same words don't: by each of them across all large entries, and by one
within each entry. Each is compared with the first. So the number of pairs follows the number of members.

Every pair is verified on the texts' shingles. What the first members miss is found exactly: all members of large entries are joined on the
rarest fifth of their shingles, one of which two texts alike share, in the rarest ninth of the smaller one. The join itself
drops pairs of which enough shingles are sure to differ: each text has PARITY bits, each the parity of how many of its
shingles fall to it, and two texts differ in as many shingles as in bits at least. What is left is verified.

All texts of a component but the first go. The README has the recall by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import cut, join_counted, only, shuffles_dropped, stored, utf8, worker_cache
from convspark.llm.components import connected_components
from convspark.llm.filters import mixed
from convspark.llm.simhash import shingle_hashes
from convspark.operators.numbering import with_sum_before

WORDS, SEGMENTS, MINS = 5, 6, 4
#: Members of an entry that are all compared before the join by shingles; mates of a text that one task compares with it.
SMALL, MATES = 4, 256
#: Members of a shingle's blocks, which are joined two by two. Shingles put last in the order of all: how many at most, how
#: often they occur in so many shingles of a task. Any order gives the same links; that one gives few pairs that aren't.
BLOCK = 256
COMMON, OFTEN, COUNTED = 1 << 16, 16, 1 << 19
PARITY = 512
BITS = [f"bits{k}" for k in range(PARITY // 64)]
SLICE = 1 << 14
#: Values that a task explodes into their entries.
SPREAD = 20_000
_SEEDS = [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(1, MINS + 1)]
#: A segment's value with its number above, and its 32 entries: one bit left out, numbered by segment and bit.
VALUES = "transform(segments, (v, s) -> shiftleft(cast(s as long), 32) | v)"
ENTRIES = "transform(sequence(0L, 31L), k -> shiftleft(shiftright(value, 32) * 32 + k, 32) | (value & 4294967295L & ~shiftleft(1L, cast(k as int))))"


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one, a blank one has none."""
    return np.unique(np.array(shingle_hashes(text, WORDS), dtype=np.uint64))


def segments(text: bytes) -> np.ndarray:
    """The segments of a text's fingerprint: the bits that over half of its distinct words have."""
    words = list(set(text.lower().split()))
    counts = np.zeros(32 * SEGMENTS, dtype=np.int64)
    for at in range(0, len(words), SLICE):
        part = words[at : at + SLICE]
        digests = b"".join([xxhash.xxh3_128_digest(w) + xxhash.xxh64_digest(w) for w in part])
        counts += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(words)).view(">u4").astype(np.int64)


def least_hashes(own: np.ndarray) -> list[int]:
    """The least of a set's hashes under each of MINS functions; 0 for an empty set."""
    return [int(mixed(own ^ seed).min(initial=2**64 - 1).view(np.int64)) if len(own) else 0 for seed in _SEEDS]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("resemblance")
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            digests, values, mins = [], [], []
            for text in utf8(batch.column("text")):
                own = shingles(text)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                values.append(segments(text))
                mins += least_hashes(own)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), pa.array(v)) for n, v in ((SEGMENTS, np.concatenate(values)), (MINS, mins))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(digests, pa.binary()), *lists], names=["key", "doc_id", "whole", "segments", "mins"])


def _members(firsts: DataFrame) -> DataFrame:
    """entry, rank: the texts that share an entry. Checkpointed."""
    valued = cut(firsts.select("rank", F.explode(F.expr(VALUES)).alias("value")))
    values = cut(valued.groupBy("value").agg(F.count("*").alias("n")))
    parts = max(int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + values.count() // SPREAD)
    entries = values.repartition(parts, "value").select("value", F.explode(F.expr(ENTRIES)).alias("entry"))
    # an entry leaves one bit out, so that it has two values at most
    ends = entries.groupBy("entry").agg(F.min("value").alias("low"), F.max("value").alias("high")).filter("low <> high")
    met = ends.select(F.explode(F.array("low", "high")).alias("value"), "entry")
    own = values.filter("n > 1").select("value", (F.col("value") + F.lit(SEGMENTS * 32 << 32)).alias("entry"))
    # at most one entry for each bit of a value, and its own
    side = cut(met.union(own).groupBy("value").agg(F.collect_list("entry").alias("entries")).join(values, "value"))
    return cut(join_counted(valued, side, "value", "n").select("rank", F.explode("entries").alias("entry")))


def candidates(firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs of ranks (a < b) to verify; rank: members of large entries, not all pairs of which are among them.

    firsts: rank, segments, mins of distinct texts, checkpointed.
    """
    members = _members(firsts)
    sizes = cut(members.groupBy("entry").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")))
    two = sizes.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    few = members.join(sizes.filter(f"n > 2 AND n <= {SMALL}").select("entry"), "entry").groupBy("entry").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    pairs = F.expr("flatten(transform(r, (x, i) -> transform(slice(r, i + 2, size(r)), y -> struct(x as a, y as b))))")
    many = cut(join_counted(members, sizes.filter(F.col("n") > SMALL).select("entry", "n"), "entry", "n").select("rank", "entry"))
    mins = firsts.select("rank", "mins")
    fine = many.join(mins, "rank").select("rank", F.xxhash64("entry", F.get("mins", F.pmod("entry", F.lit(MINS)).cast("int"))).alias("sub"))
    large = cut(many.select("rank").distinct())
    coarse = large.join(mins, "rank").select("rank", F.explode(F.transform("mins", lambda m, j: F.xxhash64(m, j))).alias("sub"))
    keyed = cut(fine.union(coarse).distinct())
    heads = cut(keyed.groupBy("sub").agg(F.min("rank").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    stars = join_counted(keyed, heads, "sub", "n").filter("a < rank").select("a", F.col("rank").alias("b"))
    return cut(two.union(few.select(F.inline(pairs))).union(stars).distinct()), large


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], names=["shingle", "n"])

    for batch in batches:
        for text in utf8(batch.column("text")):
            held.append(shingles(text))
            size += len(held[-1])
            if size >= COUNTED:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def prefix(own: np.ndarray, common: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in the order of all sets, one of which each set shares that is alike: common ones (sorted) come last, by place."""
    late = np.zeros(len(own), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        late = np.where(common[at] == own, places[at], 0)
    return own[np.lexsort((own, late))][: len(own) // 5 + 1]


def parities(own: np.ndarray) -> np.ndarray:
    """PARITY bits of a set as longs: whether an odd number of its shingles fall to each. Sets differ in as many shingles as in bits at least."""
    counts = np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = shared.value
        for batch in batches:
            for rank, text in zip(batch.column("rank").to_pylist(), utf8(batch.column("text")), strict=True):
                own = shingles(text)
                first = prefix(own, common, places)
                columns = [np.full(len(first), rank), first.view(np.int64), np.full(len(first), len(own)), np.arange(len(first))]
                columns += [np.full(len(first), x) for x in parities(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rank", "shingle", "size", "at", *BITS])

    return run


def prefix_pairs(texts: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b (a < b): pairs of texts with different roots, among them all that are alike. Checkpointed.

    texts: rank, text. roots: node, root; others are their own. Alike sets share a shingle of their prefixes; at the first
    one enough must be left in both, so that it is in the first ninth of the smaller set (a; early). Members of a shingle
    are dealt to blocks, so that no task meets all of them.
    """
    spark = texts.sparkSession
    often = texts.select("text").mapInArrow(_often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = often.orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    common = np.array([r["shingle"] for r in found], dtype=np.int64).view(np.uint64)
    order = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[order], len(common) - order))
    names = ["rank", "size", "at", "root", *BITS]
    rows = texts.mapInArrow(_prefixes(shared), ", ".join(f"{c} long" for c in ("rank", "shingle", "size", "at", *BITS)))
    rows = rows.join(roots, F.col("rank") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rank"))
    rows = stored(rows.select("shingle", *names))
    early = F.expr("9 * at <= size")
    held = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.count_if(early).alias("first"), F.min(F.when(early, F.col("size"))).alias("least"), F.min("root").alias("low"), F.max("root").alias("high"))
    apart = cut(held.filter("low <> high AND first > 0").select("shingle", "n", "least", *[F.floor(F.col(c) / BLOCK).alias(f"last_{c}") for c in ("n", "first")]))
    # a late one needs a set so much smaller among the early ones
    met = cut(join_counted(rows, apart, "shingle", "n").filter("4 * least <= 5 * size - 9 * at"))
    dealt = lambda last: F.pmod(F.xxhash64("rank"), F.col(last) + 1)
    every = lambda last: F.explode(F.sequence(F.lit(0).cast("long"), last))
    left = met.filter(early).select("shingle", dealt("last_first").alias("i"), every("last_n").alias("j"), *[F.col(c).alias(f"{c}_a") for c in names])
    right = met.select("shingle", every("last_first").alias("i"), dealt("last_n").alias("j"), *[F.col(c).alias(f"{c}_b") for c in names])
    smaller = "(size_a < size_b OR (size_a = size_b AND rank_a < rank_b))"
    enough = "9 * least(size_a - at_a, size_b - at_b) >= 4 * (size_a + size_b)"
    near = f"9 * ({' + '.join(f'bit_count({c}_a ^ {c}_b)' for c in BITS)}) <= size_a + size_b"
    pairs = left.join(right, ["shingle", "i", "j"]).filter(f"root_a <> root_b AND {smaller} AND {enough} AND {near}")
    return cut(pairs.select(F.least("rank_a", "rank_b").alias("a"), F.greatest("rank_a", "rank_b").alias("b")).distinct())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by a and part, the text of a first (b null)."""
    own = shingles(b"")
    for batch in batches:
        found: tuple[list[int], list[int]] = ([], [])
        for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), utf8(batch.column("text")), strict=True):
            if b is None:
                own = shingles(text)
            elif alike(own, shingles(text)):
                found[0].append(a)
                found[1].append(b)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose texts (rank, text) are alike. The text of a is sent once for each MATES of its mates. Checkpointed."""
    parts = pairs.groupBy("a").agg((1 + F.floor(F.count("*") / MATES)).alias("n"))
    first = parts.join(texts, F.col("a") == F.col("rank")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    mates = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).alias("part"), "b")
    mates = mates.join(texts, F.col("b") == F.col("rank")).select("a", "part", "b", "text")
    rows = first.union(mates).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return cut(rows.select("a", "b", "text").mapInArrow(_verify, "a long, b long"))


def repeats(docs: DataFrame) -> DataFrame:
    """key: of the documents that go, as an earlier one of their group of texts alike stays.

    docs: key binary (not null, one for each text that is to be told apart), doc_id long, text. Groups are components of
    texts alike. Order: by doc_id, those without one last, then by key. Words are between ASCII white space, A-Z
    lower-cased. Blank and null texts are alike. Rows that repeat a key are one document. Computes while it is called, and
    writes to the checkpoint folder.
    """
    with shuffles_dropped(docs.sparkSession):
        return _repeats(docs)


def _repeats(docs: DataFrame) -> DataFrame:
    docs = only(docs, "key", "doc_id", "text")
    own = stored(docs.mapInArrow(_sketches, "key binary, doc_id long, whole binary, segments array<long>, mins array<long>"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    groups = own.groupBy("whole").agg(F.min(F.struct(place.alias("place"), "segments", "mins")).alias("f"), F.count("*").alias("n")).select("whole", "f.*", "n")
    firsts = with_sum_before(groups, [F.col("place")], F.lit(1), "rank").select("rank", "whole", F.col("place.key").alias("first"), "segments", "mins", "n")
    firsts = stored(firsts)
    same = join_counted(own.select("key", "whole"), firsts.select("whole", "first", "n"), "whole", "n").filter("key <> first").select("key")
    pairs, large = candidates(firsts.select("rank", "segments", "mins"))
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rank")).union(large).distinct().join(firsts.select("rank", "first"), "rank")
    texts = stored(docs.select("key", "text").join(needed, F.col("key") == F.col("first")).select("rank", "text").dropDuplicates(["rank"]))
    roots = cut(connected_components(verified(pairs, texts)))
    if not large.isEmpty():
        missed = verified(cut(prefix_pairs(texts.join(large, "rank", "left_semi"), roots).join(pairs, ["a", "b"], "left_anti")), texts)
        if not missed.isEmpty():
            roots = connected_components(roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(missed))
    gone = roots.filter("node <> root").select(F.col("node").alias("rank"))
    return same.union(firsts.join(gone, "rank").select(F.col("first").alias("key"))).distinct()


def brute(docs: list[tuple]) -> set:
    """Keys of (key, doc_id, text) rows that go, for tests: every pair is compared."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for key, doc_id, text in sorted(docs, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        words = (text or "").translate(low).encode().split()
        sets.append((key, {tuple(words[i : i + WORDS]) for i in range(max(1, len(words) - WORDS + 1))} if words else set()))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for k, (b, t) in enumerate(sets):
        for j, (a, s) in enumerate(sets[:k]):
            if a == b or 5 * len(s & t) >= 4 * len(s | t):
                low_root, high_root = sorted((find(j), find(k)))
                root[high_root] = low_root
    return {key for k, (key, _) in enumerate(sets) if sets[find(k)][0] != key}

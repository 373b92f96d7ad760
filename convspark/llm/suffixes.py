"""Repeated passages by a sparse suffix array.

Of all suffixes (at words) of all documents those stay that start at a minimiser: a run of GRAM words whose hash is the
least of WINDOW neighbouring runs. Any passage of MIN_WORDS words has one within its first WINDOW words, and the same
one wherever the passage occurs. Suffixes that share their first HEAD words with another document's are brought
together and sorted by the words that follow; neighbours are compared, and a match is extended to the right and, from
the minimiser, to the left. It counts from MIN_WORDS words on. A suffix needs SIDE words on either side of its head,
as every window of MIN_WORDS words around the head lies within them.

Suffixes of a head that at most RUN rows have are all compared with each other. In the run of a more frequent head a
mate can be anywhere: it may share the left side while many others share the right one. There, suffixes alike on both
sides are folded first, in the tasks that make them and again in sorted order, which settles copies however many they
are. Those left are looked up by each of the windows around their head (k words before it, SIDE - k after it), so that
no shared window is lost. No step gathers a head, a copy or a window: heads are spread over tasks by what surrounds
them, windows are aggregated before they are shuffled, and frequent ones are joined by broadcast.

Words are compared by 16-bit hashes in the extension and by 64-bit ones in the first HEAD words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.llm.common import cut, join_counted, only, stored, utf8

MIN_WORDS, GRAM, HEAD, RUN = 50, 8, 20, 16
WINDOW = MIN_WORDS - HEAD + 1
#: Words kept on either side of the head: a passage's first minimiser has at most WINDOW - 1 words of it on its left.
SIDE = MIN_WORDS - HEAD
#: Documents whose suffixes a task folds at a time.
SLICE = 1000
_PRIME = 0x9E3779B97F4A7C15
#: Kinds of rows between the steps: a suffix of a head of few rows, one of a frequent head, a found passage.
FEW, MANY, FOUND = 0, 1, 2
ROW = "kind int, doc_id long, other_id long, at long, end long, head long, after binary, before binary"
_NAMES = [f.split()[0] for f in ROW.split(", ")]


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` words, by doubling."""
    part, size, out, done = hashes, 1, None, 0
    while True:
        if length & size:
            n = len(hashes) - done - size + 1
            if out is None:
                out = part[: max(0, n)]
            else:
                out = out[: max(0, n)] * np.uint64(pow(_PRIME, size, 1 << 64)) + part[done : done + max(0, n)]
            done += size
        if done == length:
            return out
        part = part[: max(0, len(part) - size)] * np.uint64(pow(_PRIME, size, 1 << 64)) + part[size:]
        size *= 2


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or largest of each `width` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Word positions of the suffixes to keep, all with HEAD words; none in texts too short for a passage."""
    if len(hashes) < MIN_WORDS:
        return np.zeros(0, dtype=np.int64)
    grams = _mixed(_runs(hashes, GRAM))
    least = _sliding(grams, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, dtype=np.uint64)
    chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), WINDOW, np.maximum) == grams)
    return chosen[chosen + HEAD <= len(hashes)]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            yield whole.slice(start, SLICE)


def _suffix_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        ids, places, heads = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_numpy(zero_copy_only=False), utf8(batch.column("text")), strict=True):
            hashes = word_hashes(text)
            at = minimisers(hashes)
            if len(at):
                ids.append(np.full(len(at), doc_id, dtype=np.int64))
                places.append(at)
                heads.append(_runs(hashes, HEAD)[at].view(np.int64))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, places, heads)], names=["doc_id", "at", "head"])


Rows = dict[str, np.ndarray]


def _take(d: Rows, which: np.ndarray) -> Rows:
    return {c: v[which] for c, v in d.items()}


def _send(d: Rows, kind: np.ndarray | int, found: bool = False) -> pa.RecordBatch:
    """Rows of suffixes, or of passages, in the form that steps exchange."""
    n = len(d["doc_id"])
    kinds = pa.array(np.broadcast_to(np.int32(kind), n))
    other = d["other_id"] if "other_id" in d else d["doc_id"]
    if found:
        none = pa.nulls(n, pa.binary())
        cells = [kinds, *[pa.array(d[c]) for c in ("doc_id", "other_id", "start", "end")], pa.nulls(n, pa.int64()), none, none]
    else:
        sides = [pa.Array.from_buffers(pa.binary(2 * SIDE), n, [None, pa.py_buffer(d[c].astype(">u2").tobytes())]).cast(pa.binary()) for c in ("after", "before")]
        cells = [kinds, pa.array(d["doc_id"]), pa.array(other), pa.array(d["at"]), pa.nulls(n, pa.int64()), pa.array(d["head"]), *sides]
    return pa.RecordBatch.from_arrays(cells, names=_NAMES)


def _received(batch: pa.RecordBatch) -> Rows:
    """Rows of suffixes from what _send made of them."""
    n = batch.num_rows
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "doc_id", "other_id", "at", "head")}
    return out | {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=">u2").reshape(n, SIDE).astype(np.uint16) for c in ("after", "before")}


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words each two rows share."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), a.shape[1], same.argmin(axis=1))


def _whole(d: Rows, other: np.ndarray) -> Rows:
    """Passages of rows whose every kept word another document has, too."""
    left, right = (d["before"] != 0).sum(axis=1), (d["after"] != 0).sum(axis=1)
    k = left + right >= SIDE
    return {"doc_id": d["doc_id"][k], "other_id": other[k], "start": (d["at"] - left)[k], "end": (d["at"] + HEAD + right)[k]}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in some column; where groups of sorted rows start."""
    n = len(columns[0])
    differs = np.ones(n, dtype=bool)
    differs[1:] = np.logical_or.reduce([(c[1:] != c[:-1]).reshape(n - 1, -1).any(axis=1) for c in columns]) if n > 1 else False
    return np.flatnonzero(differs)


def _ends(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kept suffixes: what follows the head, and what precedes it backwards, each SIDE words of 16 bits (0: none).

    Of those alike on both sides in several documents of the slice only the first and the last document's go on.
    """
    pad, steps = np.zeros(SIDE, dtype=np.uint16), np.arange(SIDE)
    for batch in _slices(batches):
        parts: list[Rows] = []
        for doc_id, text, places in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("places"), strict=True):
            hashes = word_hashes(text)
            places = np.unique(places.values.to_numpy())
            places = places[places // 2 + HEAD <= len(hashes)]
            at = places // 2
            if not len(at):
                continue
            short = np.concatenate([pad, (hashes >> np.uint64(40)) % np.uint64(65535) + np.uint64(1), pad]).astype(np.uint16)
            parts.append({
                "kind": (places % 2).astype(np.int32), "doc_id": np.full(len(at), doc_id, dtype=np.int64), "at": at,
                "head": _runs(hashes, HEAD)[at].view(np.int64), "after": short[SIDE + HEAD + at[:, None] + steps], "before": short[SIDE - 1 + at[:, None] - steps],
            })
        if not parts:
            continue
        d = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        sides = np.array([xxhash.xxh64_intdigest(a + b) for a, b in zip(map(bytes, d["after"]), map(bytes, d["before"]), strict=True)], dtype=np.uint64)
        order = np.lexsort((d["doc_id"], sides, d["head"]))
        d, sides = _take(d, order), sides[order]
        starts = _starts(d["head"], sides)
        ends = _ends(starts, len(sides))
        size = ends - starts
        low, high = np.repeat(d["doc_id"][starts], size), np.repeat(d["doc_id"][ends - 1], size)
        copies = low != high
        if copies.any():
            yield _send(_whole(_take(d, copies), np.where(d["doc_id"] == low, high, low)[copies]), FOUND, found=True)
        on = ~copies
        on[starts], on[ends - 1] = True, True
        yield _send(_take(d, on), d["kind"][on])


def _compared(d: Rows) -> Rows:
    """Passages of rows sorted by head, each compared with all others of its head."""
    n = len(d["at"])
    lefts, rights, other = np.full(n, -1), np.full(n, -1), np.zeros(n, dtype=np.int64)
    starts = _starts(d["head"])
    for off in range(1, int((_ends(starts, n) - starts).max(initial=0))):
        near = np.flatnonzero((d["head"][:-off] == d["head"][off:]) & (d["doc_id"][:-off] != d["doc_id"][off:]))
        left, right = _shared(d["before"][near], d["before"][near + off]), _shared(d["after"][near], d["after"][near + off])
        k = left + right >= SIDE
        left, right, near = left[k], right[k], near[k]
        for own, mate in ((near, near + off), (near + off, near)):
            other[own] = np.where(lefts[own] < 0, d["doc_id"][mate], np.minimum(other[own], d["doc_id"][mate]))
            lefts[own], rights[own] = np.maximum(lefts[own], left), np.maximum(rights[own], right)
    k = lefts >= 0
    return {"doc_id": d["doc_id"][k], "other_id": other[k], "start": (d["at"] - lefts)[k], "end": (d["at"] + HEAD + rights)[k]}


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by head, what follows, what precedes and doc_id. Passages, and the rows that are to be looked up.

    Those are the suffixes of frequent heads: one of each group alike in several documents, with the smallest and the
    largest of these as doc_id and other_id, and all whose group lies in one document.
    """
    held: Rows = {}

    def groups(d: Rows) -> np.ndarray:
        many = (d["kind"] == MANY)[:, None]
        return _starts(d["head"], np.where(many, d["after"], 0), np.where(many, d["before"], 0))

    def settled(d: Rows, last: bool) -> Iterator[pa.RecordBatch]:
        few = d["kind"] == FEW
        yield _send(_compared(_take(d, few)), FOUND, found=True)
        d = _take(d, ~few)
        n = len(d["at"])
        starts = groups(d) if n else np.zeros(0, dtype=np.int64)
        ends = _ends(starts, n) if n else starts
        size = ends - starts
        low, high = np.repeat(d["doc_id"][starts], size), np.repeat(d["doc_id"][ends - 1], size)
        copies = low != high
        yield _send(_whole(_take(d, copies), np.where(d["doc_id"] == low, high, low)[copies]), FOUND, found=True)
        on = ~copies
        on[starts] = True
        if last:
            yield _send(_take(d | {"other_id": high}, on), MANY)

    for batch in batches:
        passed = batch.filter(pa.array(batch.column("kind").to_numpy() == FOUND))
        if passed.num_rows:
            yield passed
        batch = batch.filter(pa.array(batch.column("kind").to_numpy() != FOUND))
        if not batch.num_rows:
            continue
        new = _received(batch)
        d = {c: np.concatenate([held[c], new[c]]) for c in new} if held else new
        first = int(groups(d)[-1])
        yield from settled(_take(d, np.arange(first)), True)
        held = {c: v[first:] for c, v in d.items()}  # its group may go on
        if held["kind"][0] == MANY and held["doc_id"][0] != held["doc_id"][-1]:
            yield from settled(held, False)
            held = _take(held, np.array([0, len(held["at"]) - 1]))
    if held:
        yield from settled(held, True)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, low, high, at, start: the windows of MIN_WORDS words around the heads of suffixes."""
    prime = np.uint64(_PRIME)
    for batch in _slices(batches):
        d = _received(batch)

        def sums(words: np.ndarray) -> np.ndarray:
            """Hashes of the first 0 to SIDE words; 0: there are not as many."""
            out = np.ones((len(words), SIDE + 1), dtype=np.uint64)
            for k in range(SIDE):
                out[:, k + 1] = np.where((words[:, k] != 0) & (out[:, k] != 0), _mixed(out[:, k] * prime + words[:, k].astype(np.uint64)) | np.uint64(1), 0)
            return out

        left, right = sums(d["before"]), sums(d["after"])[:, ::-1]
        keys = _mixed((left * prime + right) * prime + d["head"].view(np.uint64)[:, None]) + np.arange(SIDE + 1, dtype=np.uint64) * prime
        row, k = np.nonzero((left != 0) & (right != 0))
        cells = (_mixed(keys[row, k]).view(np.int64), d["doc_id"][row], d["other_id"][row], d["at"][row], d["at"][row] - k)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in cells], names=["key", "low", "high", "at", "start"])


def _looked_up(rows: DataFrame) -> DataFrame:
    """Passages of the suffixes of frequent heads, from the windows that two documents have."""
    windows = rows.mapInArrow(_windows, "key long, low long, high long, at long, start long")
    shared = windows.groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("n")).filter("least <> most")
    hits = join_counted(windows.filter("low = high"), cut(shared), "key", "n")
    # all windows of a suffix hold its head, so that they are one passage
    return hits.groupBy(F.col("low").alias("doc_id"), "at").agg(
        F.min(F.when(F.col("least") == F.col("low"), F.col("most")).otherwise(F.col("least"))).alias("other_id"), F.min("start").alias("start"), (F.max("start") + MIN_WORDS).alias("end")
    ).drop("at")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, other_id: the passages of at least MIN_WORDS words that another document has too.

    docs: doc_id long, text. Words: between ASCII white space, A-Z lower-cased; start_word counts from 0. Passages that
    overlap in a document are one row, other_id a document that has one of them: the smallest one met, or if that is
    the document itself, another. A document that repeats itself is not reported for that. Null, empty and shorter
    texts have none; rows with a null doc_id are left out; rows that repeat a doc_id are one document. Other columns of
    docs are not read.
    """
    docs = only(docs, "doc_id", "text").filter("doc_id is not null")
    heads = stored(docs.mapInArrow(_suffix_heads, "doc_id long, at long, head long"))
    met = heads.groupBy("head").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low <> high")
    kinds = cut(met.select("head", "n", F.when(F.col("n") > RUN, MANY).otherwise(FEW).alias("kind")))
    places = join_counted(heads, kinds, "head", "n").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.col("at") * 2 + F.col("kind")).alias("places"))
    kept = docs.join(places, F.col("doc_id") == F.col("id")).select("doc_id", "text", "places")
    rows = kept.mapInArrow(_suffixes, ROW)
    spread = F.when(F.col("kind") == MANY, F.xxhash64("after", "before")).when(F.col("kind") == FOUND, F.col("doc_id"))
    ordered = rows.repartition("head", spread).sortWithinPartitions("head", "after", "before", "doc_id")
    compared = stored(ordered.mapInArrow(_neighbours, ROW))
    found = compared.filter(F.col("kind") == FOUND).select("doc_id", "other_id", F.col("at").alias("start"), "end")
    found = found.union(_looked_up(compared.filter(F.col("kind") == MANY)).select("doc_id", "other_id", "start", "end"))
    by_doc = Window.partitionBy("doc_id").orderBy("start", F.desc("end"))
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end"), F.min("other_id").alias("other_id"))
    return spans.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "other_id")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
            if not spans:
                kept.append(text.decode())
                continue
            words = text.split()
            gone = np.zeros(len(words), dtype=bool)
            for span in spans:
                gone[span["start_word"] : span["start_word"] + span["n_words"]] = True
            kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.large_string())], names=["doc_id", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept: texts without their repeated passages, but for those whose other document comes later."""
    gone = repeated_passages(docs).filter("other_id < doc_id").groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    return only(docs, "doc_id", "text").join(gone, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "spans").mapInArrow(_cut_out, "doc_id long, kept string")


def brute(docs: list[tuple]) -> dict[int, set[int]]:
    """By doc_id the word positions that lie in a passage another document has, for tests."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: (t or "").translate(low).encode().split() for i, t in docs}
    owners: dict[tuple, set[int]] = {}
    for i, ws in words.items():
        for k in range(len(ws) - MIN_WORDS + 1):
            owners.setdefault(tuple(ws[k : k + MIN_WORDS]), set()).add(i)
    out: dict[int, set[int]] = {}
    for i, ws in words.items():
        for k in range(len(ws) - MIN_WORDS + 1):
            if len(owners[tuple(ws[k : k + MIN_WORDS])]) > 1:
                out.setdefault(i, set()).update(range(k, k + MIN_WORDS))
    return out

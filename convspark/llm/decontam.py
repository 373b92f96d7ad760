"""Benchmark decontamination by pigeonhole edit matching.

A test item of m code points allows m // PER_ERROR errors. Cut into one piece more than that, at least one piece of any
match is intact. An Aho-Corasick automaton finds exact pieces in whole documents; the stretch around each hit, unless it
lacks too many of the item's short runs to match, is verified with Myers' bit-parallel edit distance. Test items are
read in blocks of bounded size, each broadcast once; documents are read once, and each batch of them meets all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import only, worker_cache

PER_ERROR = 10
#: An error changes at most GRAM of an item's runs of GRAM code points, so a stretch that lacks more is no match.
GRAM = 5
#: Code points of test items in one block, which bounds what is broadcast.
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    """Lower case, white space folded to single spaces."""
    return " ".join((text or "").lower().split())


def split_item(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of even length with their places."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a stretch of text, and where the first such ends."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        down = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        drop = plus & across
        if up & high:
            score += 1
        elif drop & high:
            score -= 1
            if score < best:
                best, end = score, at
        up, drop = up << 1, drop << 1
        plus = (drop | ~(down | up)) & full
        minus = up & down & full
    return best, end


def grams(text: str) -> list[str]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


def lacks(parts: list[str], stretch: str, most: int) -> bool:
    """Whether more than `most` of the parts are missing."""
    missing = 0
    for part in parts:
        if part not in stretch:
            missing += 1
            if missing > most:
                return True
    return False


def _automaton(items: list[tuple[int, str]]) -> tuple:
    """The automaton of all pieces; for each item its text, errors and masks."""
    import ahocorasick

    pieces: dict[str, list[tuple[int, int]]] = {}
    table = []
    for k, (item_id, text) in enumerate(items):
        errors = len(text) // PER_ERROR
        apart = [text[i : i + GRAM] for i in range(0, len(text) - GRAM + 1, GRAM)]
        table.append((item_id, text, errors, bit_masks(text), grams(text), apart))
        for at, piece in split_item(text, errors):
            pieces.setdefault(piece, []).append((k, at))
    automaton = ahocorasick.Automaton()
    for piece, places in pieces.items():
        automaton.add_word(piece, (len(piece), places))
    automaton.make_automaton()
    return automaton, table


def find_items(text: str, automaton, table: list[tuple]) -> list[tuple[int, int, int]]:
    """(item_id, distance, end) of the items that normalised text holds within their errors."""
    begins: dict[int, set[int]] = {}
    for last, (length, places) in automaton.iter(text):
        for k, at in places:
            begins.setdefault(k, set()).add(last + 1 - length - at)
    found = []
    for k, starts in begins.items():
        item_id, item, errors, masks, runs, apart = table[k]
        whole = text.find(item)
        if errors == 0:
            while whole >= 0 and not (text[whole - 1 : whole] in ("", " ") and text[whole + len(item) : whole + len(item) + 1] in ("", " ")):
                whole = text.find(item, whole + 1)
        if whole >= 0:
            found.append((item_id, 0, whole + len(item)))
            continue
        if not errors:
            continue
        best, end = errors + 1, 0
        windows: list[list[int]] = []
        for start in sorted(starts):
            a, b = max(0, start - errors), min(len(text), start + len(item) + errors)
            if windows and a <= windows[-1][1]:
                windows[-1][1] = max(b, windows[-1][1])
            else:
                windows.append([a, b])
        for a, b in windows:
            stretch = text[a:b]
            # an error changes one of the runs that lie apart, and GRAM of all
            if lacks(apart, stretch, errors) or lacks(runs, stretch, GRAM * errors):
                continue
            distance, until = myers(masks, len(item), stretch)
            if distance < best:
                best, end = distance, a + until
        if best <= errors:
            found.append((item_id, best, end))
    return found


def _searched(shared: list, texts: list[str | None]) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """Place of a text and (item_id, distance, end) of what it holds, one block of items after the other."""
    clean = [normal(t) for t in texts]
    for block in shared:
        key, held = id(block.value), worker_cache("decontam")
        if key not in held:  # one at a time
            held.clear()
            held[key] = (*_automaton(block.value), block.value)
        automaton, table, _ = held[key]
        for k, text in enumerate(clean):
            for hit in find_items(text, automaton, table):
                yield k, hit


def _search(shared: list):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[k], *hit) for k, hit in _searched(shared, batch.column("text").to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return run


def _holds(shared: list) -> Callable[..., Column]:
    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        held = np.zeros(len(texts), dtype=bool)
        for k, _ in _searched(shared, texts.to_pylist()):
            held[k] = True
        return pa.array(held)

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in items.toLocalIterator():
        text = normal(row["text"])
        if text:
            block.append((row["item_id"], text))
            size += len(text)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, end for each document and test item that the document holds.

    docs: doc_id long, text; items: item_id long, text. Both are lower-cased with white space folded. A document holds
    an item if some stretch of it is at most m // PER_ERROR edits (code points) away, m being the item's length; end is
    where the first best stretch ends in the normalised document. Items of under PER_ERROR code points must occur as
    they are, between spaces. Null and empty texts and items hold and match nothing; rows that repeat an id each count.
    """
    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(_search(_shared(items)), "doc_id long, item_id long, distance long, end long")


def _shared(items: DataFrame) -> list:
    """Broadcasts of the items in blocks of BLOCK_CHARS code points; all documents are read once, for all of them."""
    return [items.sparkSession.sparkContext.broadcast(block) for block in _blocks(only(items, "item_id", "text"))]


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that hold a test item, by their ids: rows that repeat a doc_id go together, as do those
    without one. Null and empty texts hold nothing; without items all rows stay; an empty table gives no rows."""
    hits = contaminated(docs, items).select(F.col("doc_id").alias("hit_id")).distinct()
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["hit_id"]), "left_anti")


def rows_without_items(docs: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """The named columns of docs, text among them, of the rows whose text holds no test item. Decided row by row, whatever
    their ids: texts go to Python, and only the decision comes back. Null and empty texts hold nothing; without items all
    rows stay; an empty table gives no rows."""
    return only(docs, *columns).withColumn("_held", _holds(_shared(items))("text")).filter("NOT _held").drop("_held")


def brute(docs: list[tuple], items: list[tuple]) -> set[tuple]:
    """(doc_id, item_id, distance) by the whole table of edit distances, for tests."""
    out = set()
    for doc_id, raw in docs:
        text = normal(raw)
        for item_id, raw_item in items:
            item = normal(raw_item)
            if not item or not text:
                continue
            errors = len(item) // PER_ERROR
            if not errors:
                if f" {item} " in f" {text} ":
                    out.add((doc_id, item_id, 0))
                continue
            row = list(range(len(item) + 1))
            best = row[-1]
            for c in text:
                new = [0]
                for i, p in enumerate(item, 1):
                    new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
                row = new
                best = min(best, row[-1])
            if best <= errors:
                out.add((doc_id, item_id, best))
    return out

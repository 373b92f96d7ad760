"""Quality by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is compressed with either, in blocks
of BLOCK bytes so that the dictionary and not the text's own past decides; the difference of the two sizes over the
text's length is the measure, which a logistic curve, fitted on labelled texts that the dictionaries have not seen,
turns into a probability. The labelled texts are a sample of bounded size; each counts for as many as it stands for, so
that the classes keep their shares. Tasks cut and measure them: the driver gets blocks and measures, no whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import crc_mod, only, utf8
from convspark.llm.langid import sample_by_class

#: Labelled texts of either class that are fitted on, half of them for the dictionaries; every text is scored whole.
PER_CLASS = 2000
BLOCK, DICTIONARY, LEVEL = 512, 1 << 16, 3
#: Blocks that a dictionary is trained on: about so many at most, of all of its texts' blocks by a hash, wherever they lie.
BLOCKS = 40_000


class Model(NamedTuple):
    bad: bytes
    good: bytes
    curve: tuple[float, float]  # of 1 and the measure


def blocks(text: bytes) -> list[bytes]:
    return [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]


def sampled(text: bytes, share: float) -> list[bytes]:
    """A text's blocks, each kept with the probability share, by its place and content."""
    own = blocks(text)
    return own if share >= 1 else [b for k, b in enumerate(own) if xxhash.xxh64_intdigest(b, k) < share * 2**64]


def _dictionary(parts: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to choose from: they are the dictionary
        return b"".join(parts)[:DICTIONARY]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)


def measure(text: bytes, bad, good) -> float:
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in blocks(text)) / max(1, len(text))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 1e-4])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge @ w)
    return w


def _cut(shares: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sampled(t, shares[q]) for t, q in zip(utf8(batch.column("text")), batch.column("quality").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(parts, pa.list_(pa.binary()))], names=["doc_id", "quality", "parts"])

    return run


def _measured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = [compressor(d) for d in shared.value]
        for batch in batches:
            found = [measure(t, *tools) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(found, pa.float64())], names=["doc_id", "quality", "measure"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labels: doc_id, quality (0 or 1), the rows with null left out.

    A row of labels counts once for each quality of its doc_id. With one class only, or none, every score is that
    class's smoothed share.
    """
    rows = only(labels, "doc_id", "quality").filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    seen = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2:
        return Model(b"", b"", (float(np.log((seen.get(1, 0) + 1) / (seen.get(0, 0) + 1))), 0.0))
    chosen = sample_by_class(rows, "quality", PER_CLASS, 2 * PER_CLASS).distinct()
    texts = docs.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").dropDuplicates(["doc_id", "text", "quality"])
    first = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0
    place = lambda r: (r["doc_id"] * 0x9E3779B1 % (1 << 32), r["quality"], r[2])
    size = F.sum(F.ceil(F.octet_length("text") / BLOCK))
    shares = {r["quality"]: BLOCKS / max(1, r["n"]) for r in texts.filter(first).groupBy("quality").agg(size.alias("n")).collect()}
    parts = sorted(texts.filter(first).mapInArrow(_cut(shares), "doc_id long, quality int, parts array<binary>").collect(), key=place)
    bad, good = (_dictionary([bytes(b) for r in parts if r["quality"] == q for b in r["parts"]]) for q in (0, 1))
    shared = docs.sparkSession.sparkContext.broadcast((bad, good))
    found = sorted(texts.filter(~first).mapInArrow(_measured(shared), "doc_id long, quality int, measure double").collect(), key=place)
    y = np.array([r["quality"] for r in found], dtype=float)
    if not 0 < y.sum() < len(y):
        return Model(bad, good, (float(np.log((seen[1] + 1) / (seen[0] + 1))), 0.0))
    weight = np.where(y == 1, seen[1] / y.sum(), seen[0] / (len(y) - y.sum())) * len(y) / sum(seen.values())
    x = np.array([(1.0, r["measure"]) for r in found])
    return Model(bad, good, tuple(map(float, _curve(x, y, weight))))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        tools = compressor(model.bad), compressor(model.good)
        for batch in batches:
            x = np.array([measure(t, *tools) for t in utf8(batch.column("text"))])
            score = 1 / (1 + np.exp(-np.clip(model.curve[0] + model.curve[1] * x, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted for every document.

    docs: doc_id long, text; labels: doc_id, quality. Learned from labels whose crc32(doc_id) mod `modulus` is not
    `held`; held_out says that it is. Null and empty texts score what the curve gives for no difference. Without labels
    of both classes every score is the share seen. Rows that repeat a doc_id each give a row; other columns are not read.
    """
    docs = only(docs, "doc_id", "text")
    model = train(docs, labels.filter(crc_mod("doc_id", modulus) != held))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    marked = docs.withColumn("held_out", crc_mod("doc_id", modulus) == held)
    return marked.mapInArrow(_score(shared), "doc_id long, held_out boolean, score double, predicted int")

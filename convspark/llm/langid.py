"""Language identification by a string kernel.

A text is the set of its hashed runs of 1 to GRAMS code points (blended-spectrum presence); the kernel of two texts is
the number of runs they share over the root of the product of their numbers. Landmarks from a bounded sample of labelled
texts give the Nystroem features K(x, landmarks) K(landmarks, landmarks)^-1/2, on which one-versus-rest kernel ridge
regression is fitted on the driver. Since the kernel is linear in the presence vector, landmarks and coefficients fold
into one matrix, and a batch of texts is scored by one product of its sparse presence matrix with that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.llm.common import crc_mod, only, worker_cache

GRAMS = 4
#: Hash buckets for each length of run.
BUCKETS = 1 << 14
#: Bounds of what is fitted on: labelled texts in all, and for each language; landmarks in all. Every language has
#: LEAST_SAMPLE texts, if there are as many, and LEAST_LANDMARKS, whatever their sum. Fitting only; texts are scored whole.
SAMPLE, PER_LANGUAGE, LANDMARKS = 3000, 300, 256
LEAST_SAMPLE, LEAST_LANDMARKS = 40, 4
RIDGE, SHARPNESS = 1e-2, 6.0
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # (GRAMS * BUCKETS, languages)


def presence(text: str) -> np.ndarray:
    """Sorted buckets of the runs that a text has."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), dtype="<u4")
    found, code = [], np.zeros(len(points), dtype=np.uint32)
    for n in range(min(GRAMS, len(points))):
        code = code[: len(points) - n] * np.uint32(0x9E3779B1) + points[n:]
        mixed = code ^ (code >> np.uint32(15))
        mixed = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
        has = np.zeros(BUCKETS, dtype=bool)
        has[mixed] = True
        found.append(np.flatnonzero(has) + n * BUCKETS)
    return np.concatenate(found)


def _dense(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of presence, each over the root of its number of runs."""
    out = np.zeros((len(sets), GRAMS * BUCKETS), dtype=np.float32)
    for row, own in zip(out, sets, strict=True):
        row[own] = 1 / np.sqrt(len(own))
    return out


def fit(samples: list[tuple[np.ndarray, str]]) -> Model:
    """From (presence, language) rows."""
    languages = sorted({lang for _, lang in samples})
    if not languages:
        return Model([], np.zeros((GRAMS * BUCKETS, 0), dtype=np.float32))
    sets = [own for own, _ in samples]
    each = max(LEAST_LANDMARKS, LANDMARKS // len(languages))
    chosen = [k for lang in languages for k in [k for k, (_, own) in enumerate(samples) if own == lang][:each]]
    landmarks = _dense([sets[k] for k in chosen])
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(np.float64))
    keep = values > 1e-6
    half = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    kernel = np.concatenate([_dense(sets[k : k + 64]) @ landmarks.T for k in range(0, len(sets), 64)])
    features = kernel.astype(np.float64) @ half
    target = np.array([[1.0 if own == lang else -1.0 for lang in languages] for _, own in samples])
    counts = (target > 0).sum(axis=0)
    weight = np.array([len(samples) / (len(languages) * counts[languages.index(own)]) for _, own in samples])[:, None]
    gram = features.T @ (weight * features) + RIDGE * len(samples) / len(chosen) * np.eye(features.shape[1])
    alpha = half @ np.linalg.solve(gram, features.T @ (weight * target))
    return Model(languages, (landmarks.T @ alpha.astype(np.float32)).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; UNKNOWN and 0 for null and for texts without a letter."""
    rows = [k for k, t in enumerate(texts) if t and model.languages and _LETTER.search(t)]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if rows:
        sets = [presence(texts[k]) for k in rows]
        sizes = np.array([len(s) for s in sets])
        sums = np.add.reduceat(model.weights[np.concatenate(sets)], np.cumsum(sizes) - sizes, axis=0)
        outputs = (sums / np.sqrt(sizes)[:, None]).astype(np.float64)
        likely = np.exp(SHARPNESS * (outputs - outputs.max(axis=1, keepdims=True)))
        likely /= likely.sum(axis=1, keepdims=True)
        for k, best, p in zip(rows, outputs.argmax(axis=1), likely.max(axis=1), strict=True):
            langs[k], scores[k] = model.languages[best], float(p)
    return langs, scores


def sample_by_class(rows: DataFrame, label: str, per_class: int, total: int, least: int = 1, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About per_class rows of each class, at most about `total` or `least` a class, chosen by the hash of `by`."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n")).collect()
    each = max(least, min(per_class, total // max(1, len(counts))))
    share = {r[label]: min(1.0, each / r["n"]) for r in counts}
    if not share:
        return rows.limit(0)
    limits = F.create_map(*[F.lit(x) for pair in ((k, int(v * (1 << 30))) for k, v in share.items()) for x in pair])
    return rows.filter(F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(1 << 30)) < F.coalesce(limits[F.col(label)], F.lit(-1)))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("langid")
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            bits = np.zeros(GRAMS * BUCKETS, dtype=bool)
            if _LETTER.search(text):
                bits[presence(text)] = True
            rows.append(np.packbits(bits).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "runs"])


def train(docs: DataFrame, where: Column) -> Model:
    """Fit on a bounded sample of the documents `where` holds whose text and lang are not null.

    Rows alike in doc_id, text and lang are one. Of a text the driver gets GRAMS * BUCKETS bits, however long it is.
    """
    rows = docs.filter(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sample = sample_by_class(rows, "lang", PER_LANGUAGE, SAMPLE, LEAST_SAMPLE, ("doc_id", "text"))
    found = sample.dropDuplicates().mapInArrow(_bitmaps, "doc_id long, lang string, runs binary").collect()
    found.sort(key=lambda r: (r["lang"], r["doc_id"] * 0x9E3779B1 % (1 << 32), r["runs"]))
    sets = [(np.flatnonzero(np.unpackbits(np.frombuffer(r["runs"], dtype=np.uint8))), r["lang"]) for r in found]
    return fit([(own, lang) for own, lang in sets if len(own)])


def _predictor(shared) -> Callable[..., Column]:
    """The prediction as a column of the text: only that goes to Python and only the prediction comes back."""

    @F.arrow_udf("lang_pred string, score double, has_letter boolean")
    def run(texts: pa.Array) -> pa.Array:
        worker_cache("langid")
        values, langs, scores = texts.to_pylist(), [], []
        for at in range(0, len(values), 128):
            found = predict(shared.value, values[at : at + 128])
            langs.extend(found[0])
            scores.extend(found[1])
        letters = [bool(t and _LETTER.search(t)) for t in values]
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.bool_())], names=["lang_pred", "score", "has_letter"])

    return run


def identify(docs: DataFrame, modulus: int = 4, held: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, has_letter and the columns to carry, for every document, from its whole text alone.

    docs: doc_id long, text, lang. Learned from documents whose crc32(doc_id) mod `modulus` is not `held`. held_out
    says that it is. A null text or one without a letter is `und` with score 0, as is every text if nothing could be
    learned; has_letter tells the two apart. Rows that repeat a doc_id each give a row. Columns of docs that are not
    named are not read.
    """
    learned = only(docs, "doc_id", "text", "lang")
    held_out = crc_mod("doc_id", modulus) == held
    model = train(learned.withColumn("held_out", held_out), ~F.col("held_out"))
    run = _predictor(docs.sparkSession.sparkContext.broadcast(model))
    rows = only(docs, *dict.fromkeys(("doc_id", "text", *carry))).withColumn("held_out", held_out).withColumn("_pred", run("text"))
    return rows.select("doc_id", "held_out", "_pred.lang_pred", "_pred.score", "_pred.has_letter", *carry)

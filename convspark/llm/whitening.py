"""Whitening of embeddings by distributed block matrices.

Vectors are rounded to whole numbers and repeated ones folded. Each task lays its distinct vectors out in blocks of rows;
with the exact sums these are centred and become a BlockMatrix. The transpose times the matrix is the scatter, of which
each task adds up the products of GROUP blocks. Its eigenvectors are found on the driver, as it has a row and a column
for each dimension only, and a second product with the whitening matrix projects all rows.

For that one, blocks are laid out as a square and multiplied by the whitening matrix on a diagonal: Spark deals the
result of a product to a grid, so that a single column of blocks would meet in the square root of the tasks. Sums and
deviations are exact; only the two products and the eigenvectors are computed in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from convspark.llm.common import cut, join_counted, only, stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Numbers of a block, and blocks whose products a task adds up.
BLOCK, GROUP = 1 << 19, 8
#: Entries times SCALE beyond this are held there, so that sums stay within 64 bits.
LARGEST = 1 << 40
#: A component has variance if its eigenvalue is over this share of the largest.
LEAST = 1e-12
_INDICES = StructType([StructField("_1", LongType()), StructField("_2", LongType())])
_BLOCK = StructType([StructField("blockIndices", _INDICES), StructField("subMatrix", MatrixUDT())])
_ARROW_INDICES = pa.struct([("_1", pa.int64()), ("_2", pa.int64())])
_ARROW_MATRIX = pa.struct([
    ("type", pa.int8()), ("numRows", pa.int32()), ("numCols", pa.int32()), ("colPtrs", pa.list_(pa.int32())),
    ("rowIndices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64())), ("isTransposed", pa.bool_()),
])


def rounded(embeddings: DataFrame) -> DataFrame:
    """vec_id, x (array<long>) of the rows whose vector has no null or non-finite entry and the most frequent length."""
    rows = only(embeddings, "vec_id", "embedding").filter("embedding is not null and size(embedding) > 0")
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    held = lambda c: F.least(F.lit(float(LARGEST)), F.greatest(F.lit(-float(LARGEST)), c.cast("double") * SCALE))
    return rows.filter(~bad).select("vec_id", F.transform("embedding", lambda c: F.floor(held(c)) + F.lit(SHIFT).cast("long")).alias("x"))


def _numbered(size: int):
    """Blocks of distinct vectors: part and place number them, x and times are the rows one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal place
            x, times = rows.column("x").combine_chunks(), rows.column("times").combine_chunks()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (x.flatten(), times)]
            place += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([place - 1], pa.int64()), *lists], names=["part", "place", "x", "times"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, size))
                held, n = rows.slice(size).to_batches(), n - size
        if n:
            yield block(pa.Table.from_batches(held))

    return run


def blocks_of(rows: DataFrame, dims: int) -> DataFrame:
    """block, x, times: the distinct vectors of rows(x), up to BLOCK numbers in a block, blocks numbered from 0. Stored."""
    distinct = rows.groupBy("x").agg(F.count("*").alias("times"))
    made = stored(distinct.mapInArrow(_numbered(max(1, BLOCK // dims)), "part long, place long, x array<long>, times array<long>"))
    # one row for each task, whose blocks' numbers start where those of the tasks before it end
    counts = sorted((r["part"], r["n"]) for r in made.groupBy("part").agg(F.count("*").alias("n")).toLocalIterator())
    starts = np.cumsum([0, *(n for _, n in counts)]).tolist()
    held = made.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "part long, start long")
    return made.join(F.broadcast(held), "part").select((F.col("start") + F.col("place")).alias("block"), "x", "times")


def _centred(n: int, sums: np.ndarray, side: int | None):
    """Blocks as matrices; side: of the square they are laid out in, None for one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, x in zip(batch.column("block").to_pylist(), batch.column("x"), strict=True):
                rows = x.values.to_numpy().reshape(-1, len(sums))
                values = (rows - sums // n) - sums % n / n
                at = {"_1": number // side, "_2": number % side} if side else {"_1": number, "_2": 0}
                yield _matrix(at, values)

    return run


def _matrix(at: dict, values: np.ndarray) -> pa.RecordBatch:
    one = lambda v, kind: pa.array([v], kind)
    cells = [one(1, pa.int8()), one(values.shape[0], pa.int32()), one(values.shape[1], pa.int32()), one(None, pa.list_(pa.int32())), one(None, pa.list_(pa.int32()))]
    cells.append(pa.ListArray.from_arrays(pa.array([0, values.size], pa.int32()), pa.array(np.ascontiguousarray(values).ravel())))
    matrix = pa.StructArray.from_arrays([*cells, one(True, pa.bool_())], fields=list(_ARROW_MATRIX))
    return pa.RecordBatch.from_arrays([pa.array([at], _ARROW_INDICES), matrix], names=["blockIndices", "subMatrix"])


def _block_matrix(blocks: DataFrame, rows: int, columns: int, shape: tuple[int, int]) -> BlockMatrix:
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, rows, columns, *shape), rows, columns)


def _product(a: BlockMatrix, b: BlockMatrix, parts: int = 1) -> BlockMatrix:
    """a times b, where the inner dimension's blocks are dealt to `parts` groups whose products are added up."""
    java = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(java, a.rowsPerBlock, b.colsPerBlock)


def scatter(tall: BlockMatrix, n_blocks: int) -> np.ndarray:
    """The transpose of a column of blocks times itself."""
    return _product(tall.transpose(), tall, -(-n_blocks // GROUP)).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; each one's entry of largest size is positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    return values, vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)


def _unpacked(side: int | None, columns: int):
    """block, rows (their values one after the other) of a block matrix's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, matrices = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                place, m = at[k].as_py(), matrices[k]
                values = np.asarray(m["values"].values, dtype=np.float64)
                rows = values.reshape(-1, columns) if m["isTransposed"].as_py() else values.reshape(columns, -1).T
                flat = pa.array(np.ascontiguousarray(rows).ravel())
                yield pa.RecordBatch.from_arrays([pa.array([place["_1"] * (side or 1) + place["_2"]], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["block", "rows"])

    return run


def _tall_again(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                yield _matrix({"_1": number, "_2": 0}, rows.values.to_numpy().reshape(-1, columns))

    return run


def _deviation(n: int, sums: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Sum of (n * x - S)**2 of each row; null where 64 bits don't hold it."""
    far = int(np.abs(rows - sums // n).max(initial=0) + 1) * n
    if far * far * rows.shape[1] < 1 << 63:
        return pa.array(((n * (rows - sums // n) - sums % n) ** 2).sum(axis=1))
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in rows.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def _rows(n: int, sums: np.ndarray, columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, times, rows in zip(batch.column("x"), batch.column("times"), batch.column("rows"), strict=True):
                count = len(times.values)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * width), v.values) for v, width in ((x, len(sums)), (rows, columns))]
                far = _deviation(n, sums, x.values.to_numpy().reshape(count, -1))
                yield pa.RecordBatch.from_arrays([lists[0], times.values, far, lists[1]], names=["x", "times", "deviation", "whitened"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    embeddings: vec_id, embedding (array of numbers). Rows go whose vector is null or empty, holds null or non-finite
    entries or has another length than most others (the longest of equally frequent ones). An entry c becomes
    floor(64 * c) + 1000000, at most LARGEST in size before the shift. Means and covariance are those of the n distinct
    vectors, divisor n. Components are numbered from 1 by falling eigenvalue, at most one for each dimension; their
    largest entry is positive. whitened is null for components without variance, which identity_error passes over, and
    so are explained and identity_error where no component has any. deviation is null where a long doesn't hold it. Null
    and repeated vec_ids each give rows. An empty table, or one without vectors, gives no rows. Other columns are not
    read. Computes while it is called, and writes to the checkpoint folder.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = embeddings.sparkSession
    rows = rounded(embeddings)
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], schema)
    dims = length["d"]
    rows = rows.filter(F.size("x") == dims)
    blocks = stored(blocks_of(rows, dims))
    size = blocks.agg(F.count("*").alias("blocks"), F.sum(F.size("times")).alias("n")).first()
    n, n_blocks = size["n"], size["blocks"]
    found = blocks.select(F.posexplode("x").alias("p", "v")).groupBy((F.col("p") % dims).alias("p")).agg(F.sum("v").alias("s")).collect()
    sums = np.zeros(dims, dtype=np.int64)
    for r in found:
        sums[r["p"]] = r["s"]
    per_block, side = max(1, BLOCK // dims), isqrt(n_blocks - 1) + 1
    tall = _block_matrix(blocks.mapInArrow(_centred(n, sums, None), _BLOCK), per_block, dims, (n_blocks * per_block, dims))
    covariance = scatter(tall, n_blocks) / n
    values, vectors = principal(covariance, components)
    there = values > LEAST * max(values[0], 0)
    kept = int(there.sum())
    trace = float(np.trace(covariance))
    error = None
    projected = blocks.select("block", F.array_repeat(F.lit(0.0), 0).alias("rows")).limit(0)
    if kept:
        matrix = vectors[:, :kept] / np.sqrt(values[:kept])
        diagonal = [((j, j), Matrices.dense(dims, kept, matrix.ravel(order="F").tolist())) for j in range(side)]
        square = _block_matrix(blocks.mapInArrow(_centred(n, sums, side), _BLOCK), per_block, dims, (side * per_block, side * dims))
        weights = BlockMatrix(spark.sparkContext.parallelize(diagonal, 1), dims, kept, side * dims, side * kept)
        product = callMLlibFunc("getMatrixBlocks", _product(square, weights)._java_matrix_wrapper._java_model)
        projected = stored(product.mapInArrow(_unpacked(side, kept), "block long, rows array<double>"))
        again = _block_matrix(projected.mapInArrow(_tall_again(kept), _BLOCK), per_block, kept, (n_blocks * per_block, kept))
        error = float(np.abs(scatter(again, n_blocks) / n - np.eye(kept)).max())
    side_rows = blocks.join(projected, "block", "left").withColumn("rows", F.coalesce("rows", F.array().cast("array<double>")))
    fit = cut(side_rows.mapInArrow(_rows(n, sums, kept), "x array<long>, times long, deviation long, whitened array<double>"))
    joined = join_counted(rows, fit, "x", "times").select("vec_id", "deviation", "whitened")
    explained = F.array(*[F.lit(float(max(v, 0.0)) / trace if trace > 0 else None).cast("double") for v in values])
    each = joined.select("vec_id", "deviation", "whitened", F.posexplode(explained).alias("at", "explained"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.get("whitened", F.col("at")).alias("whitened"), "explained", F.lit(error).cast("double").alias("identity_error"),
    )


def brute(rows: list[tuple], components: int = COMPONENTS) -> list[tuple]:
    """The definition over a few rows of one length, for tests: (vec_id, component, n, deviation, whitened, explained)."""
    kept = [(i, [int(np.floor(64 * float(c))) + SHIFT for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = []
    for i, x in kept:
        far = n * np.array(x, dtype=object) - sums
        scores = (far / n).astype(float) @ vectors[:, order] / np.sqrt(values[order])
        out += [(i, k + 1, n, int((far**2).sum()), float(scores[k]), float(values[order[k]] / values.sum())) for k in range(len(order))]
    return out

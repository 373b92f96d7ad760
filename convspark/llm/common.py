"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.sources.checkpoints import cut, shared_folder


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, as tasks import it: they need no copy of their own."""
    sc, package = spark.sparkContext, Path(__file__).resolve().parent.parent
    if sc.applicationId in _SHIPPED or not package.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


def trim() -> None:
    """Give back the memory that this process has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries keep freed memory until told
    if trim is not None:
        trim(0)


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in a Python worker from task to task. Workers outlive their stage: all that other operators
    keep in this one is dropped first, so that one stage's vocabulary is not held through the next ones."""
    if owner not in _CACHES:
        for held in _CACHES.values():
            held.clear()
        _CACHES.clear()
        trim()
    return _CACHES.setdefault(owner, {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is computed inside sends at most so many rows to a Python worker at once; the session's setting, if lower, stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with _setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is computed inside drops its shuffle files as soon as it has ended, not when the driver happens to collect garbage.

    For steps that checkpoint or write each result; what is computed twice from one DataFrame would be shuffled again.
    """
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key that more than one in HOT of the rows have is joined by broadcast. There are fewer than HOT such keys.
HOT = 500


def join_counted(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """rows inner joined with side, which holds each key once and as n how many rows have it (or more).

    Frequent keys are joined where their rows lie, by a broadcast of at most HOT rows; the rest is shuffled. So no task
    gets a frequent key. rows and side are read more than once and should be cut.
    """
    total = side.agg(F.sum(n)).first()[0] or 0
    frequent = F.col(n) * HOT > total
    hot, rare = side.filter(frequent).drop(n), side.filter(~frequent).drop(n)
    held = F.broadcast(hot)
    return rows.join(held, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rare, key))


#: Rows of a partition that spread makes.
SPREAD = 2_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows in partitions of about SPREAD by a key without frequent values, before each becomes many.

    What was aggregated is small, and Spark would leave it in a few partitions.
    """
    rows = cut(rows)
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // SPREAD), key)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """Just the named columns, whatever else (or however named) docs carries. Every operator starts here."""
    ship(docs.sparkSession)
    return docs.select(*[docs[c] for c in columns])


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The values of a string column as bytes, null as empty; one value at a time in Python."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""

"""Upkeep of datasets: exports, upserts, incremental runs, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.functions.keys import argmax
from convspark.sources.checkpoints import cut


def export_training_text(labels: DataFrame, utterances: DataFrame, key: str) -> DataFrame:
    """Label, sentence of the utterances that have a label."""
    return labels.join(utterances.select(key, "sentence"), key).select("label", "sentence")


def export_media_manifest(split: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Key, path, missing: the media file of each utterance of a split; a missing one is marked."""
    return split.join(media.select(key, "path"), key, "left").select(key, "path", F.col("path").isNull().alias("missing"))


def upsert_by_key(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new, and those of target whose key new lacks."""
    return target.join(new, list(key), "left_anti").unionByName(new)


def upsert_partitions(spark: SparkSession, path: str, new: DataFrame, key: Sequence[str], by: Sequence[str]) -> None:
    """upsert_by_key into the Parquet dataset at path, partitioned by the columns `by`, which the key decides.

    Only partitions that have a row of new are read and written anew; files of all others stay as they are, so the cost
    follows what changes. A dataset that isn't there yet is made. Rows without a partition are Parquet's null partition.
    """
    new = cut(new)
    try:
        target = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return new.write.partitionBy(*by).parquet(path)
    target = target.select(*[F.col(c).cast(new.schema[c].dataType) for c in new.columns])
    touched = new.select(*by).distinct()
    same = [target[c].eqNullSafe(touched[c]) for c in by]
    rows = cut(upsert_by_key(target.join(touched, same, "left_semi"), new, key))  # written before its source is replaced
    rows.repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def only_missing(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """S12"""
    return todo.join(done.select(key), key, "left_anti")


def reconcile_manifest(utterances: DataFrame, files: DataFrame, order: str = "pos") -> DataFrame:
    """Dialogs, where first seen, and whether a file is there."""
    first = utterances.groupBy("dialog_id").agg(F.min(order).alias("first_seen"))
    return first.join(files.select("dialog_id").distinct().withColumn("_there", F.lit(True)), "dialog_id", "left").select("dialog_id", "first_seen", F.coalesce("_there", F.lit(False)).alias("present"))


def combine_datasets(a: DataFrame, b: DataFrame, target: str) -> DataFrame:
    """Rows of both, with class ids; a target that is one-hot becomes its index first."""
    ids = lambda df: df.withColumn(target, argmax(F.col(target)) if dict(df.dtypes)[target].startswith("array") else F.col(target).cast("long"))
    return ids(a).unionByName(ids(b))


def image_manifest(lines: DataFrame, classes: DataFrame, line: str = "line", limit: int | None = None) -> DataFrame:
    """Path, class_id, label of `class/file` lines; limit keeps the first by path."""
    rows = lines.select(F.col(line).alias("path"), F.split_part(F.col(line), F.lit("/"), F.lit(1)).alias("class_id"))
    rows = rows.join(classes.select("class_id", "label"), "class_id").select("path", "class_id", "label")
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def clip_segments(selection: DataFrame, files: DataFrame, precedence: Sequence[str] = ("mp4", "rmvb", "mkv")) -> DataFrame:
    """Start, duration and source file of each clip; of a movie's files the ending latest in precedence; none: null.

    selection: movie (a number), idx, start_s, end_s; files: path such as movie03.mkv.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in precedence]), F.regexp_extract("path", r"\.(\w+)$", 1))
    best = files.withColumn("stem", F.regexp_extract("path", r"^(.*)\.\w+$", 1)).groupBy("stem").agg(F.max_by("path", rank).alias("source"))
    rows = selection.withColumn("stem", F.format_string("movie%02d", F.col("movie").cast("int")))
    return rows.join(best, "stem", "left").select("movie", "idx", "start_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "source")

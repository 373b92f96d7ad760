"""Files in and out: delimited tables, JSON, lines, features, subtitles, logs. Paths are anything Spark can open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from convspark.functions.keys import srt_to_tc


def read_meta_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";", skip_rows: int = 1) -> DataFrame:
    """Delimited rows under an explicit schema; skip_rows 1 skips each file's header, 0 none."""
    return spark.read.schema(schema).option("sep", sep).option("header", skip_rows > 0).option("escape", '"').csv(path)


def write_meta_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """S2"""
    df.write.mode("overwrite").option("sep", sep).option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None, lines: bool = False) -> DataFrame:
    """S3: documents that may span lines, one list or document a file; with lines, as Spark writes them, one a line."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """S3"""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines without white space at their ends, and their file."""
    return spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"), F.col("_metadata.file_path").alias("path"))


def write_features(features: DataFrame, path: str, by: str = "movie") -> None:
    """Parquet, a folder for each movie. Rows of a movie meet in files whose number follows its size."""
    features.hint("rebalance", F.col(by)).write.mode("overwrite").partitionBy(by).parquet(path)


def read_features(spark: SparkSession, path: str, key: str, order: str) -> DataFrame:
    """Of rows with the same key the last one."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r"))
    return last.select(key, "r.*")


def repartition_by_group(rows: DataFrame, path: str, by: str = "movie") -> None:
    """Rows in the order of splits are shuffled and written by movie."""
    write_features(rows, path, by)


def parse_cues(files: DataFrame, text: str = "text", dialog: str = "dialog_id") -> DataFrame:
    """Cues of subtitle files, each whole in one row: blocks of index, start --> end, text and an empty line.

    dialog_id, utt_id, idx, start_tc, end_tc, text; blocks without an index are skipped.
    """
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    blocks = files.select(dialog, F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(lines) - 1) / 4).cast("int"), F.lit(0))), lambda k: F.slice(lines, k * 4 + 1, F.lit(4)))).alias("block", "b"))
    start, end = (F.regexp_extract(F.get("b", F.lit(1)), r"^\s*(\S+)\s*-->\s*(\S+)", k) for k in (1, 2))
    index = F.trim(F.get("b", F.lit(0)))
    rows = blocks.filter(index != "").select(dialog, index.cast("int").alias("idx"), srt_to_tc(start, True).alias("start_tc"), srt_to_tc(end, False).alias("end_tc"), F.trim(F.get("b", F.lit(2))).alias("text"))
    return rows.withColumn("utt_id", F.concat_ws("_", dialog, "idx"))


def write_subtitles(files: DataFrame, path: str, text: str = "text", dialog: str = "dialog_id") -> None:
    """Whole subtitle files as rows of Parquet: how many files are written and listed follows their size, not their number."""
    files.select(F.col(dialog).alias("dialog_id"), F.col(text).alias("text")).write.mode("overwrite").parquet(path)


def parse_subtitles(spark: SparkSession, path: str, dialog: Column | None = None, bundled: bool = False) -> DataFrame:
    """Cues of the files at path; a file's dialog is its name without the ending, unless told otherwise. With bundled,
    of those that write_subtitles put there."""
    if bundled:
        return parse_cues(spark.read.schema("dialog_id string, text string").parquet(path))
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1) if dialog is None else dialog
    return parse_cues(files.select(name.alias("dialog_id"), F.col("value").alias("text")))


def annotation_template(cues: DataFrame) -> DataFrame:
    """Cues with empty columns for the annotators, dialogs in numeric order."""
    empty = {c: F.lit(None).cast("string") for c in ("speaker", "labels", "note", "feedback")}
    number = F.regexp_extract("dialog_id", r"(\d+)$", 1).cast("int")
    return cues.withColumns(empty).orderBy(F.regexp_replace("dialog_id", r"\d+$", ""), number, "idx")


_RESULT = r"(Val|Tst) .*(?:WF1-result| F1-result) WA: ([0-9.]+) UAR: ([0-9.]+) F1: ([0-9.]+) WF1: ([0-9.]+)"


def parse_logs(lines: DataFrame, line: str = "line", path: str = "path") -> DataFrame:
    """Path, part, wa, uar, f1, wf1 of the result lines of logs."""
    field = lambda k: F.regexp_extract(line, _RESULT, k)
    return lines.filter(field(1) != "").select(path, field(1).alias("part"), *[field(k).try_cast("double").alias(n) for k, n in enumerate(("wa", "uar", "f1", "wf1"), 2)])


def parse_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Result lines of the log files at path that have exactly two."""
    rows = parse_logs(read_lines(spark, path))
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("path"))).filter("_n = 2").drop("_n")

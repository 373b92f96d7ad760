"""From raw documents to packed training sequences: stages that each apply one operator to what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.llm import decontam, langid, lines, packing, resemblance
from convspark.llm.common import arrow_batches, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Words that a worker keeps while packing: fewer than by default, as the JVM has grown to its limit in the stages before.
CACHE_WORDS = 60_000
#: Rows sent to a Python worker at once: its batch, and the JVM's buffers for it, are held by each task at the same time.
BATCH_ROWS = 1_000


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key: 128 bits of doc_id and text. Rows that repeat or lack a doc_id are told apart by their texts."""
    named = F.concat_ws(" ", F.coalesce(docs["doc_id"].cast("string"), F.lit("-")), F.when(docs["text"].isNull(), "-").otherwise("+"), docs["text"])
    return docs.select(*[docs[c] for c in COLUMNS], F.unhex(F.md5(named.cast("binary"))).alias("row_key"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have no language go: those with a null or empty text, or one without a letter. All others stay.

    Of those that stay, a null lang becomes the predicted one (and stays null if nothing could be learned). Decided row
    by row: null or repeated doc_ids and repeated rows change nothing. An empty table gives no rows.
    """
    found = langid.identify(docs, carry=("text", "lang", "source", "n_chars")).filter("has_letter")
    lang = F.coalesce("lang", F.nullif("lang_pred", F.lit(langid.UNKNOWN)))
    return found.withColumn("lang", lang).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents have go from all; n_chars follows. All documents stay, emptied ones with an empty text.

    A null text becomes an empty one. Each row counts as a document, whatever its doc_id; an empty table gives no rows.
    """
    kept = lines.dedup_lines(docs, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike the first one stays: their sets of five-word shingles are at least 0.8 alike.

    Candidates come from SimHash segment variants, each verified on the texts; see the operator. Order: by doc_id,
    those without one last, then by a hash of doc_id and text. Of rows alike in doc_id and text one stays. Null and
    blank texts are alike, so one of them stays. Texts that share a doc_id are told apart. No rows: none.
    """
    keyed = _keyed(docs)
    gone = resemblance.repeats(keyed.withColumnRenamed("row_key", "key")).withColumnRenamed("key", "gone_key")
    left = keyed.join(gone, keyed["row_key"] == gone["gone_key"], "left_anti")
    return left.dropDuplicates(["row_key"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with one edit for each ten code points at most, go.

    Decided row by row on texts: null and repeated doc_ids change nothing. Null and empty texts hold nothing. Without test
    items, and from an empty table, nothing goes.
    """
    return decontam.rows_without_items(docs, table(spark, sf_dir, "benchmark"), *COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets: the operator's rows, not the columns of documents.

    Null and empty texts are an end alone; rows that repeat a doc_id are packed each; an empty table gives no rows.
    """
    return packing.pack(docs, cache_words=CACHE_WORDS)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents that the stages keep."""
    docs = table(spark, sf_dir, "documents")
    with arrow_batches(spark, BATCH_ROWS):
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the kernel machine, SimHash nor the tokenizer: run() is tested against a brute-force version.
ORACLE_SQL = None

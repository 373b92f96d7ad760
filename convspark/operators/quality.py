"""Checks that return the rows which break a rule; none is a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark.functions.vocab import LABELS, SPEAKERS
from convspark.operators.annotation import dialog_turn_counts
from convspark.operators.numbering import with_neighbours


def check_speaker_domain(utts: DataFrame, speakers: Sequence[str] = SPEAKERS) -> DataFrame:
    """Q1; a null speaker is none of them."""
    return utts.filter(~F.coalesce(F.col("speaker").isin(*speakers), F.lit(False))).select("utt_id", "speaker")


def check_first_speaker(utts: DataFrame, speaker: str = "A") -> DataFrame:
    """Q2"""
    return utts.groupBy("dialog_id").agg(F.min_by("speaker", "pos").alias("first_speaker")).filter(F.col("first_speaker") != speaker)


def check_unique_utts(utts: DataFrame, key: Column) -> DataFrame:
    """Q3: dialog_id, key, times of keys that a dialog has more than once."""
    return utts.groupBy("dialog_id", key.alias("key")).agg(F.count("*").alias("times")).filter("times > 1")


def check_annotators_aligned(sheet: DataFrame) -> DataFrame:
    """Q4: dialogs whose number of utterances or turns differs between annotators, or that some annotator lacks."""
    counts = dialog_turn_counts_each(sheet)
    kinds = counts.groupBy("dialog_id").agg(F.count("*").alias("n_annotators"), F.countDistinct("n_utts").alias("utt_counts"), F.countDistinct("n_turns").alias("turn_counts"))
    every = sheet.agg(F.countDistinct("annotator").alias("every"))
    return kinds.join(F.broadcast(every), (F.col("n_annotators") < F.col("every")) | (F.col("utt_counts") > 1) | (F.col("turn_counts") > 1)).drop("every")


def dialog_turn_counts_each(sheet: DataFrame) -> DataFrame:
    keyed = sheet.withColumnRenamed("dialog_id", "dialog").withColumn("dialog_id", F.concat_ws("|", "annotator", "dialog"))
    return dialog_turn_counts(keyed, ["annotator", "dialog"]).withColumnRenamed("dialog", "dialog_id").drop("n_dialogs")


def check_first_label_present(sheet: DataFrame, cell: str = "cell") -> DataFrame:
    """Q5"""
    first = sheet.groupBy("annotator", "dialog_id").agg(F.min_by(F.struct(F.col(cell).alias("cell")), "pos").alias("first"))
    return first.filter("first.cell IS NULL").select("annotator", "dialog_id")


def check_label_vocab(sheet: DataFrame, vocabulary: Sequence[str] = LABELS) -> DataFrame:
    """Q6: label and times of labels that the vocabulary lacks."""
    return sheet.select(F.explode("labels").alias("label")).filter(~F.coalesce(F.col("label").isin(*vocabulary), F.lit(False))).groupBy("label").agg(F.count("*").alias("times"))


def check_two_speakers(utts: DataFrame) -> DataFrame:
    """Q7"""
    return utts.groupBy("dialog_id").agg(F.countDistinct("speaker").alias("n_speakers")).filter("n_speakers <> 2")


def check_row_conservation(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Q8: keys that one side has and the other lacks."""
    lost = before.join(after, key, "left_anti").select(key, F.lit("lost").alias("what"))
    return lost.union(after.join(before, key, "left_anti").select(key, F.lit("added")))


def check_timecode_format(utts: DataFrame, tc: str) -> DataFrame:
    """Q9: time codes without four fields."""
    return utts.filter(F.col(tc).isNull() | (F.size(F.split(tc, ":")) != 4)).select("utt_id", tc)


def check_contiguous_dialogs(utts: DataFrame, by: str, order: str) -> DataFrame:
    """Q10: dialogs that start more than once in the file order of a movie. Writes its keys once, in ranges of that order."""
    rows = with_neighbours(utts.select(by, order, "dialog_id").filter("dialog_id IS NOT NULL"), by, [order], ["dialog_id"])
    starts = rows.filter(~F.col("before.dialog_id").eqNullSafe(F.col("dialog_id")))
    return starts.groupBy("dialog_id").agg(F.count("*").alias("starts")).filter("starts > 1")

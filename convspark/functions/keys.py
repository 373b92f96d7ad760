"""Keys, labels, names and time codes as Column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions.vocab import LABELS, MODEL_IDS
from convspark.operators.numbering import with_sum_before


def lookup(c: Column, table: Mapping) -> Column:
    """The value of c in a small literal table; null if it has none."""
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[c]


def part(c: Column, delimiter: str, n: int) -> Column:
    return F.split_part(c, F.lit(delimiter), F.lit(n))


def dialog_id(utt_id: Column) -> Column:
    """K1: the first two parts of movie_dialog_utt."""
    return F.substring_index(utt_id, "_", 2)


def utt_key(speaker: Column, utt_id: Column) -> Column:
    """K2: speaker_utt."""
    return F.concat_ws("_", speaker, utt_id)


def movie_of(key: Column) -> Column:
    """K2: the movie in an utterance key."""
    return part(key, "_", 2)


def parse_face_name(name: Column) -> dict[str, Column]:
    """K3: spk_movie_dialog_utt_frame_face as columns."""
    fields = {f: part(name, "_", k) for k, f in enumerate(("speaker", "movie", "dialog", "utt", "frame", "face"), 1)}
    return fields | {f: fields[f].cast("int") for f in ("frame", "face")}


def drop_blank_rows(df: DataFrame, key: str) -> DataFrame:
    """K4: rows without a key go."""
    return df.filter(F.col(key).isNotNull())


def until_first_blank(df: DataFrame, key: str, by: Sequence[str], order: str) -> DataFrame:
    """K4: rows of each group before its first row without a key."""
    seen = F.sum(F.when(F.col(key).isNull(), 1).otherwise(0)).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("_blank", seen).filter("_blank = 0").drop("_blank")


def clean_text(c: Column) -> Column:
    """K5: ASCII marks become full-width ones, a space a comma."""
    return F.translate(c, ",.?!() ", "，。？！（），")


def norm_speaker(c: Column) -> Column:
    """K6: no spaces."""
    return F.replace(c, F.lit(" "), F.lit(""))


def parse_labels(cell: Column, spellings: Mapping[str, str] | None = None) -> Column:
    """K7: the labels of a comma list, known misspellings corrected; null cell: null."""
    labels = F.split(F.replace(cell, F.lit(" "), F.lit("")), ",")
    return F.transform(labels, lambda x: F.coalesce(lookup(x, spellings), x)) if spellings else labels


def unknown_labels(labels: Column, vocabulary: Sequence[str] = LABELS) -> Column:
    """K7: the labels that the vocabulary lacks."""
    return F.filter(labels, lambda x: ~x.isin(*vocabulary))


def label_to_id(c: Column, vocabulary: Mapping[str, int] = MODEL_IDS) -> Column:
    """K8: null for labels without an id."""
    return lookup(c, vocabulary)


def labels_to_ids(labels: Column, vocabulary: Mapping[str, int] = MODEL_IDS) -> Column:
    return F.transform(labels, lambda x: lookup(x, vocabulary))


def remap_vocabulary(code: Column, names: Mapping, order: Sequence[str]) -> Column:
    """K9: code, its name in one vocabulary, that name's index in another."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), lookup(code, names)), F.lit(0).cast("long")) - 1


def build_label_vocab(df: DataFrame, label: str) -> DataFrame:
    """Label, id from 0 in alphabetical order. The window runs over distinct labels only."""
    return df.select(label).filter(F.col(label).isNotNull()).distinct().select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("long").alias("id"))


def dense_ids_by_flag(df: DataFrame, key: str, flag: str, order: str) -> DataFrame:
    """Key, flag, id: from 0 for flag 1 in file order, then on for flag 0."""
    return with_sum_before(df, [F.desc(flag), F.asc(order)], F.lit(1), "id").select(key, flag, "id")


def seeded(seed: int, *columns: str) -> Column:
    """A hash of the columns' texts that other engines have, too: its order is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def encode_speaker(c: Column, scheme: Sequence[str] = ("A", "B")) -> Column:
    """The speaker's index in a scheme such as A, B or M, F."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in scheme]), c), F.lit(0).cast("long")) - 1


def onehot(index: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == index, 1).otherwise(0))


def norm_demographics(c: Column, spellings: Mapping[str, str]) -> Column:
    """Known spellings corrected."""
    return F.coalesce(lookup(F.trim(c), spellings), F.trim(c))


def count_stars(c: Column) -> Column:
    """K14"""
    return (F.length(c) - F.length(F.replace(c, F.lit("★"), F.lit("")))).cast("long")


def alias_list(actor: Column, aliases: Column) -> Column:
    """Actor and other names, split on the last of space, ； and ， that occurs, cut at a bracket."""
    cell = F.coalesce(aliases, F.lit(""))
    parts = F.when(cell.contains("，"), F.split(cell, "，")).when(cell.contains("；"), F.split(cell, "；")).otherwise(F.split(cell, " "))
    names = F.transform(parts, lambda x: F.regexp_replace(x, r"[(（].*$", ""))
    return F.concat(F.array(actor), F.filter(names, lambda x: x != ""))


def mask_names(text: Column, names: Column, token: str = "[NAME]") -> Column:
    """Each name of the list, in order, becomes the token."""
    return F.aggregate(names, text, lambda acc, name: F.replace(acc, name, F.lit(token)))


def argmax(arr: Column) -> Column:
    """Index from 0 of the first largest value."""
    return F.array_position(arr, F.array_max(arr)) - 1


def softmax(arr: Column) -> Column:
    """K17"""
    top = F.array_max(arr)
    raised = F.transform(arr, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, y: a + y))


def _clock(tc: Column) -> tuple[Column, Column, Column]:
    """Minutes, seconds and the last field of hh:mm:ss:ff; no time code here counts the hour."""
    return tuple(part(tc, ":", k).cast("long") for k in (2, 3, 4))


def tc_seconds(tc: Column) -> Column:
    """25 frames a second."""
    m, s, f = _clock(tc)
    return m * 60 + s + f / 25


def tc_seconds_cut(tc: Column) -> Column:
    """The end of the frame."""
    m, s, f = _clock(tc)
    return m * 60 + s + (f + 1) * 0.04


def tc_seconds_centi(tc: Column) -> Column:
    """The last field in hundredths."""
    m, s, f = _clock(tc)
    return m * 60 + s + f * 0.01


def tc_frame(tc: Column) -> Column:
    """T4"""
    m, s, f = _clock(tc)
    return m * 1500 + s * 25 + f


def srt_to_tc(c: Column, is_start: bool) -> Column:
    """T5: hh:mm:ss,mmm to hh:mm:ss:ff, frames of 40 ms rounded down at a start and up at an end (up to 25)."""
    ms = part(c, ",", 2).cast("int") / 40
    frame = (F.floor(ms) if is_start else F.ceil(ms)).cast("string")
    return F.concat(part(c, ",", 1), F.lit(":"), F.lpad(frame, 2, "0"))


def format_duration(seconds: Column) -> Column:
    """0:m:ss.ss"""
    minutes = F.floor(seconds / 60)
    return F.format_string("0:%d:%05.2f", minutes, seconds - minutes * 60)


def sample_range(start: Column, end: Column, rate: int, pad: float = 0.05) -> tuple[Column, Column]:
    """Sample numbers of a slice; both ends move by +pad seconds."""
    return ((start + pad) * rate).cast("long"), ((end + pad) * rate).cast("long")

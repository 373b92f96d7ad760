"""Feature tables: statistics, joins, packing and batching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions import vectors as V
from convspark.functions.keys import seeded
from convspark.operators.numbering import with_sum_before


def column_stats(vectors: DataFrame, v: str, by: Sequence[str] = ()) -> DataFrame:
    """dim, mean, std (population) of each entry over all rows; partial sums bound the shuffle to dims x tasks."""
    return vectors.select(*by, F.posexplode(v).alias("dim", "x")).groupBy(*by, "dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def fit_standardizer(train: DataFrame, ft: str, order: str, every_nth: int = 4) -> DataFrame:
    """V7: one row mean, std (arrays) over one in every_nth steps; a deviation of 0 becomes 1.

    The steps are places j (n - 1) div (k - 1), j from 0, k = n div every_nth, of the n steps of all training matrices
    joined end to end in the order of `order`.
    """
    sized = with_sum_before(train.select(order, ft).withColumn("_k", F.size(ft)), [F.asc(order)], F.col("_k"), "_before")
    n = sized.agg(F.sum("_k")).first()[0] or 0
    k = max(1, n // every_nth)
    at = (F.col("_before") + F.col("step")).cast("long")
    j = F.expr(f"((_before + step) * {k - 1} + {max(n - 2, 0)}) div {max(n - 1, 1)}")
    rows = sized.select("_before", F.posexplode(ft).alias("step", "row"))
    steps = rows.filter(F.expr(f"{k} > 1") & (F.floor(j * F.lit(n - 1) / F.lit(max(k - 1, 1))) == at) | (F.lit(k) == 1) & (at == 0))
    stats = column_stats(steps.select(V.doubles(F.col("row")).alias("row")), "row")
    std = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    rows = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", std.alias("std")))).alias("s"))  # one entry a dimension
    return rows.select(F.col("s.mean").alias("mean"), F.col("s.std").alias("std"))


def apply_standardizer(df: DataFrame, model: DataFrame, ft: str) -> DataFrame:
    """V8: each step of a matrix less the mean, over the deviation; the model is one row."""
    joined = df.crossJoin(F.broadcast(model))
    return joined.withColumn(ft, F.transform(ft, lambda row: V.standardize(row, F.col("mean"), F.col("std")))).drop("mean", "std")


def corpus_mean_std(records: DataFrame, v: str, key: Column, every: int = 2) -> DataFrame:
    """Mean and population deviation of all values of every nth record, by its key."""
    return records.filter(key % every == 0).select(F.explode(V.doubles(F.col(v))).alias("x")).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def mean_of_means(records: DataFrame, v: str, by: Sequence[str] = ()) -> DataFrame:
    """V12"""
    own = V.doubles(F.col(v))
    return records.groupBy(*by).agg(F.avg(V.total(own) / F.size(own)).alias("mean"))


def join_split_features(split: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Features of the split's utterances; check_row_conservation tells what is missing."""
    return split.join(features, key)


def repair_keys(features: DataFrame, fixes: DataFrame, key: str) -> DataFrame:
    """Rows under a wrong key are copied to the right one; fixes: wrong, right (a few rows)."""
    copies = features.join(fixes, features[key] == fixes["wrong"]).withColumn(key, F.col("right")).select(*features.columns)
    return features.union(copies)


def pack_dialogs(utts: DataFrame, features: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """dialog_id, turns: one row a dialog, its utterances in order with key, speaker and fields."""
    rows = utts.join(features, key, "left")
    return rows.groupBy("dialog_id").agg(F.array_sort(F.collect_list(F.struct("pos", key, "speaker", *fields))).alias("turns"))


#: Tokens of an utterance that a batch keeps.
MAX_TOKENS = 300


def batch_and_pad(
    packs: DataFrame, turns: str, order: str, batch_size: int, pad: Column, drop_last: bool = False, tokens: str | None = None, max_tokens: int = MAX_TOKENS, filler: Column | None = None
) -> DataFrame:
    """Batch, longest, mask and padded (whether a turn is padding), and each dialog padded with `pad` to the longest
    of its batch; batches are consecutive dialogs, and drop_last leaves a short last one out.

    With tokens, a field of the turns that is an array, each is cut at max_tokens and filled up with `filler` to the
    batch's longest one, which is width; that of pad, too. Dialogs are numbered over (order, lengths) alone; their
    content is joined back, so the running number, added up by ranges, sees ids only.
    """
    if tokens is not None:
        kept = lambda t: F.slice(t[tokens], 1, F.least(F.size(t[tokens]), F.lit(max_tokens)))
        packs = packs.withColumn(turns, F.transform(turns, lambda t: t.withField(tokens, kept(t))))
    wide = F.array_max(F.transform(turns, lambda t: F.size(t[tokens]))) if tokens is not None else F.lit(0)
    numbers = with_sum_before(packs.select(order, F.size(turns).alias("_n"), wide.alias("_w")), [F.asc(order)], F.lit(1), "_at").withColumn("batch", F.floor(F.col("_at") / batch_size)).drop("_at")
    w = Window.partitionBy("batch")
    numbers = numbers.withColumns({"longest": F.max("_n").over(w), "width": F.max("_w").over(w), "_k": F.count("*").over(w)}).drop("_w")
    if drop_last:
        numbers = numbers.filter(F.col("_k") == batch_size)
    rows = packs.join(numbers, order)
    padded = F.concat(F.col(turns), F.array_repeat(pad, F.col("longest") - F.col("_n")))
    if tokens is not None:
        padded = F.transform(padded, lambda t: t.withField(tokens, F.concat(t[tokens], F.array_repeat(filler, F.col("width") - F.size(t[tokens])))))
    mask = F.concat(F.array_repeat(F.lit(1), F.col("_n")), F.array_repeat(F.lit(0), F.col("longest") - F.col("_n")))
    out = rows.withColumns({turns: padded, "mask": mask, "padded": F.transform(mask, lambda m: m == 0)}).drop("_n", "_k")
    return out if tokens is not None else out.drop("width")


def chunk_rows(df: DataFrame, by: Sequence[str], order: str, n: int) -> DataFrame:
    """Chunks of n rows of each group in order, the last one maybe shorter: by, chunk, rows."""
    chunk = F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / n)
    return df.withColumn("chunk", chunk).groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct(order))).alias("rows"))


def drop_missing_keys(dialogs: DataFrame, sentences: DataFrame, key: str) -> DataFrame:
    """V21"""
    return dialogs.join(sentences.select(key), key, "left_semi")


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with place, from 0, in the order of a seeded hash; numbered by ranges. Sort by place to read them so."""
    return with_sum_before(df, [seeded(seed, key), F.col(key)], F.lit(1), "place")

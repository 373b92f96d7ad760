"""Splits by group, and their balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions.keys import seeded
from convspark.operators.corpus import share_of_total, subset_profile


def _sets(rank: Column, sizes: dict[str, int]) -> Column:
    out, upto = F, 0
    for name, n in sizes.items():
        upto += n
        out = out.when(rank <= upto, name)
    return out


def group_split(groups: DataFrame, sizes: dict[str, int], seed: int = 0, key: str = "movie") -> DataFrame:
    """Key, set_name: groups dealt to sets of fixed sizes in the order of a seeded hash."""
    rank = F.row_number().over(Window.orderBy(seeded(seed, key), key))
    return groups.select(key).distinct().select(key, rank.alias("_r")).select(key, _sets(F.col("_r"), sizes).alias("set_name")).filter("set_name IS NOT NULL")


def split_balance(profile: DataFrame, movie_set: DataFrame) -> DataFrame:
    """For each set its share of every count, label and transition."""
    total = profile.groupBy("what", "key").agg(F.sum("n").alias("n"))
    return share_of_total(subset_profile(profile, movie_set, ["set_name"]), total, ["set_name"])


def search_split(profile: DataFrame, sizes: dict[str, int], n_seeds: int) -> DataFrame:
    """C17: seed and deviation of the seeded split whose sets' shares of labels are nearest to their shares of groups."""
    seeds = profile.sparkSession.range(n_seeds).withColumnRenamed("id", "seed")
    dealt = profile.select("movie").distinct().crossJoin(F.broadcast(seeds))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.md5(F.concat_ws(":", F.col("seed").cast("string"), "movie")), "movie"))
    dealt = dealt.select("seed", "movie", rank.alias("_r")).select("seed", "movie", _sets(F.col("_r"), sizes).alias("set_name")).filter("set_name IS NOT NULL")
    labels = profile.filter("what = 'label'")
    total = labels.groupBy("key").agg(F.sum("n").alias("all_n"))
    shares = labels.join(dealt, "movie").groupBy("seed", "set_name", "key").agg(F.sum("n").alias("n")).join(total, "key")
    aim = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, n / sum(sizes.values()))])[F.col("set_name")]
    off = shares.groupBy("seed").agg(F.round(F.sum(F.abs(F.col("n") / F.col("all_n") - aim)), 6).alias("deviation"))
    return off.agg(F.min_by("seed", F.struct("deviation", "seed")).alias("seed"), F.min("deviation").alias("deviation"))


def apply_group_split(df: DataFrame, sets: DataFrame, key: str = "movie") -> DataFrame:
    """Rows take the set of their group; Spark broadcasts the list of groups while it is small."""
    return df.join(sets.select(key, "set_name"), key)


def fixed_range_split(df: DataFrame, key: Column, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """set_name by the range that key lies in, ends included."""
    out = F
    for name, (low, high) in ranges.items():
        out = out.when(key.between(low, high), name)
    return df.withColumn("set_name", out)


def tail_validation_split(dialogs: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The last n training dialogs become validation. They are found by a top-n, not by a global window."""
    last = dialogs.filter("set_name = 'train'").orderBy(F.desc(order)).limit(n).select(order, F.lit("val").alias("_set"))
    return dialogs.join(F.broadcast(last), order, "left").withColumn("set_name", F.coalesce("_set", "set_name")).drop("_set")


def kfold_tables(features: DataFrame, folds: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """The features under each fold's membership; folds: fold, key, set_name."""
    return folds.join(features.select(key, *keep), key).select("fold", "set_name", key, *keep)

"""Joins whose frequent keys stay where their rows lie."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

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

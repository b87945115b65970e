"""Fusion of ranked lists, and search over all signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF = 60
SIGNALS = ("lexical", "vector", "graph")


def oversample(limit: int) -> int:
    """How many rows each signal contributes before fusion."""
    return min(4 * limit, 200)


def fuse(lists: dict[str, DataFrame], limit: int, key: str = "id") -> DataFrame:
    """(key, score, lexical, vector, graph): reciprocal-rank fusion of bounded lists (key, score), with the rank in each.

    Each list is at most 200 rows, so the windows rank in one task by design. A list that is not given has null ranks.
    """
    unknown = set(lists) - set(SIGNALS)
    if unknown or not lists:
        raise ValueError(f"signals must be some of {SIGNALS}")
    order = Window.orderBy(F.desc("score"), key)
    ranked = reduce(DataFrame.unionByName, [df.select(key, F.row_number().over(order).alias("_r"), F.lit(s).alias("_s")) for s, df in lists.items()])
    ranks = [F.max(F.when(F.col("_s") == s, F.col("_r"))).alias(s) for s in SIGNALS]
    return ranked.groupBy(key).agg(F.sum(F.lit(1.0) / (RRF + F.col("_r"))).alias("score"), *ranks).orderBy(F.desc("score"), key).limit(limit)

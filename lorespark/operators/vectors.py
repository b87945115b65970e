"""Exact vector search for a single query, and pooling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.vectors import dot, norm, quantised, restored, unit


def quantise(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector array<tinyint>)"""
    measured = vectors.select(key, F.col(vector).alias("_v"), norm(F.col(vector)).alias("_n"))
    return measured.select(key, quantised(unit(F.col("_v"), F.col("_n"))).alias("vector"))


def vector_search(vectors: DataFrame, key: str, vector: str, query: list[float], limit: int) -> DataFrame:
    """(key, score): the nearest of the stored int8 vectors by dot product, equal ones by key; a scan and a top-k, no shuffle of vectors."""
    length = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / length) for x in query])
    measured = vectors.select(key, F.col(vector).alias("_v"), norm(F.col(vector)).alias("_n"))
    stored = restored(quantised(unit(F.col("_v"), F.col("_n"))))
    return measured.select(key, F.round(dot(stored, q), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)


def mean_pool(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): the average of a group's vectors, place by place, combined before the shuffle."""
    return (
        vectors.select(group, F.posexplode(vector).alias("at", "x"))
        .groupBy(group, "at")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(group)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))
    )

"""Lexical retrieval: term statistics, BM25 and a trigram fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import trigrams, words
from lorespark.sources.shared import one_row, spread

K1, B = 1.2, 0.75
TRIGRAM_WEIGHT = 0.01


def term_frequencies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)"""
    return docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """(term, df): the texts that hold each term. Terms are made distinct before they are exchanged."""
    return docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _of_query(spark, query: str, expression) -> list[str]:
    return one_row(spark).select(expression(F.lit(query))).first()[0]


def bm25(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score) of the texts with any term of the query; a term that the query repeats counts as often.

    Nothing is shuffled: a first pass gathers one row (texts, average length, texts of each term), a second one scores
    every text by that row.
    Null and empty texts count with length 0 in the average, as documents without terms.
    """
    spark = docs.sparkSession
    terms = _of_query(spark, query, words)
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*map(F.lit, distinct))
    # functions over small arrays keep the compiled code small; the array of one makes its element be computed once
    counted = F.transform(
        F.array(words(F.coalesce(F.col(text), F.lit("")))),
        lambda ws: F.struct(F.size(ws).alias("len"), F.transform(wanted, lambda t: F.size(F.filter(ws, lambda w: w == t))).alias("tf")),
    )[0]
    held = docs.select(key, counted.alias("_c"))
    stats = held.agg(F.count(F.lit(1)).alias("_n"), F.avg("_c.len").alias("_avg"), F.array(*[F.count_if(F.col("_c.tf")[i] > 0) for i in range(len(distinct))]).alias("_df"))
    repeats = F.array(*[F.lit(float(terms.count(t))) for t in distinct])
    idf = F.transform("_df", lambda df: F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5)))
    stats = stats.select("_avg", F.zip_with(repeats, idf, lambda q, i: q * i * (K1 + 1)).alias("_w"))
    part = lambda tf, w: w * tf / (tf + K1 * (1 - B + B * F.col("_c.len") / F.col("_avg")))
    score = F.aggregate(F.zip_with("_c.tf", "_w", part), F.lit(0.0), lambda a, x: a + x)
    # one row is broadcast; sums of doubles depend on their order, so equal texts get equal scores by rounding
    return held.where(F.exists("_c.tf", lambda n: n > 0)).crossJoin(F.broadcast(stats)).select(key, F.round(score, 9).alias("score"))


def trigram_scores(docs: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, score): the share of the query's trigrams that a text has, weighted lightly. No shuffle.

    A trigram is three signs of a word, so wherever it stands in a text it stands within a word: a plain search finds it.
    """
    grams = _of_query(docs.sparkSession, query, trigrams)
    if not grams:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    wanted = F.array(*map(F.lit, grams))
    hits = F.transform(F.array(F.lower(F.col(text))), lambda low: F.size(F.filter(wanted, lambda g: F.call_function("instr", low, g) > 0)))[0]
    return docs.where(F.col(text).isNotNull()).select(key, (F.lit(TRIGRAM_WEIGHT) * hits / len(grams)).alias("score")).where("score > 0")


def lexical_search(docs: DataFrame, key: str, text: str, query: str, limit: int) -> DataFrame:
    """(key, score): BM25 plus trigram score, the best first, equal ones by key."""
    docs = spread(docs.select(key, text))
    both = bm25(docs, key, text, query).unionByName(trigram_scores(docs, key, text, query))
    # a key that repeats as a row counts with its sum, as its postings would
    return both.groupBy(key).agg(F.round(F.sum("score"), 9).alias("score")).orderBy(F.desc("score"), key).limit(limit)

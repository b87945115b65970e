"""Source items: validation, redaction, de-duplication, retention and summaries.

``items``: source_id, kind, host, fetched_at, run_hash, external_id, title, text, url, occurred_at, metadata.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.canonical import canonical_map
from lorespark.functions.ids import content_hash
from lorespark.functions.text import redacted, redacted_map, sensitive

# Kinds and hosts of sources, and the bounds of an item in bytes.
KINDS = ("git-repo", "gmail", "hackernews", "notion", "slack", "web-search", "x")
HOSTS = ("claude", "codex", "cli")
TEXT_BYTES, VALUE_BYTES, RUN_ITEMS = 131_072, 4_096, 500
KEPT_RUNS = 20


def violations(items: DataFrame) -> DataFrame:
    """(rule, key): what is wrong with each item, by rule; a sound table has no row. The key is run and external id."""
    key = F.concat_ws("/", "run_hash", "external_id")
    long_value = F.exists(F.map_values("metadata"), lambda v: F.octet_length(v) > VALUE_BYTES)
    rules: dict[str, Column] = {
        "kind unknown": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "host unknown": ~F.coalesce(F.col("host").isin(*HOSTS), F.lit(False)),
        "external id empty": F.coalesce(F.col("external_id"), F.lit("")) == "",
        "text missing": F.col("text").isNull(),
        "text too long": F.octet_length("text") > TEXT_BYTES,
        "title empty": F.col("title") == "",
        "fetched before it occurred": F.col("occurred_at") > F.col("fetched_at"),
        "metadata value too long": F.coalesce(long_value, F.lit(False)),
    }
    each = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    own = items.select(F.explode(each).alias("rule"), key.alias("key")).distinct()
    many = items.select("run_hash", "external_id").distinct().groupBy("run_hash").count().where(F.col("count") > RUN_ITEMS).select(F.lit("too many items in a run").alias("rule"), F.col("run_hash").alias("key"))
    mixed = items.groupBy("source_id").agg(F.count_distinct("kind").alias("n")).where("n > 1").select(F.lit("source of several kinds").alias("rule"), F.col("source_id").alias("key"))
    return reduce(DataFrame.unionByName, [own, many, mixed])


def redact_items(items: DataFrame) -> DataFrame:
    """Secrets hidden in every text field and in metadata."""
    return items.withColumns({"title": redacted(F.col("title")), "text": redacted(F.col("text")), "url": redacted(F.col("url")), "metadata": redacted_map(F.col("metadata"))})


def item_hash() -> Column:
    """Identity of an item's content: all that is stored of it but when it was fetched."""
    return content_hash(*[F.col(c) for c in ("title", "text", "url", "occurred_at")], canonical_map(F.col("metadata")))


def novel_items(items: DataFrame) -> DataFrame:
    """Items whose content is new to their source: of equal (source, external id, content) the earliest run's, each once.

    One shuffle by the item's identity; a window over it would sort what a minimum finds while combining.
    """
    rest = [c for c in items.columns if c not in ("source_id", "external_id")]
    first = F.min(F.struct(F.col("fetched_at").alias("_t"), F.col("run_hash").alias("_r"), F.col("item_id").alias("_i"))).alias("_m")
    hashed = items.withColumn("content", item_hash())
    best = hashed.groupBy("source_id", "external_id", "content").agg(first)
    return hashed.dropDuplicates(["item_id"]).join(best.select(F.col("_m._i").alias("item_id")), "item_id", "left_semi").select("source_id", "external_id", *rest, "content")


def unknown_items(items: DataFrame, stored: DataFrame) -> DataFrame:
    """Items that are not among the stored ones, by source, external id and content."""
    seen = stored.select("source_id", "external_id", item_hash().alias("content")).distinct()
    return items.withColumn("content", item_hash()).join(seen, ["source_id", "external_id", "content"], "left_anti")


def runs(items: DataFrame) -> DataFrame:
    """(source_id, run_hash, fetched_at, items)"""
    return items.groupBy("source_id", "run_hash").agg(F.max("fetched_at").alias("fetched_at"), F.count_distinct("item_id").alias("items"))


def retained_runs(items: DataFrame, keep: int = KEPT_RUNS) -> DataFrame:
    """The newest runs of each source, by time, then hash, both descending; ranked after items are counted into runs."""
    w = Window.partitionBy("source_id").orderBy(F.desc("fetched_at"), F.desc("run_hash"))
    return runs(items).withColumn("place", F.row_number().over(w)).where(F.col("place") <= keep)


def source_summary(items: DataFrame) -> DataFrame:
    """(source_id, runs, items, fetched_at, run_hash): how much each source holds, and its latest run."""
    latest = F.max(F.struct("fetched_at", "run_hash")).alias("m")
    return runs(items).groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("items").alias("items"), latest).select("source_id", "runs", "items", "m.fetched_at", "m.run_hash")


def leaks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key) of stored texts that still hold a secret."""
    return rows.where(sensitive(F.col(text))).select(key)

"""Integrity of chunks, vectors, manifests and snapshots; a check's result is the rows that fail it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.ids import chunk_id
from lorespark.operators.order import running
from lorespark.operators.snapshots import digest, relative_path

PLANES = ("code", "concept", "wiki")


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """(rule, id) of references that break the model."""
    bad_hex = lambda c: ~F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    tests = {
        "id is no digest": bad_hex("id"),
        "hash is no digest": bad_hex("content_hash"),
        "plane unknown": ~F.coalesce(F.col("plane").isin(*PLANES), F.lit(False)),
        "line below 1": F.col("start_line") < 1,
        "lines backward": F.col("end_line") < F.col("start_line"),
        "id wrong": F.col("id") != chunk_id(F.col("plane"), F.col("path"), F.col("start_line"), F.col("end_line"), F.col("content_hash")),
    }
    return chunks.select(F.explode(F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t in tests.items()]))).alias("rule"), "id").distinct()


def stale_chunks(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, reason): references to pages (path, lines) that are not there or are shorter."""
    own = chunks.select("id", "path", "end_line").distinct().join(lines, "path", "left")
    reason = F.when(F.col("lines").isNull(), "no page").when(F.col("end_line") > F.col("lines"), "past the end")
    return own.select("id", reason.alias("reason")).where("reason is not null")


def vector_states(vectors: DataFrame, manifest: DataFrame) -> DataFrame:
    """(model_id, model_revision, state, n): sound, missing, empty, zero and wrongly long vectors, repeated rows once."""
    own = vectors.select("chunk_id", "model_id", "model_revision", "vector").distinct().join(manifest.select("model_id", "model_revision", "dims").distinct(), ["model_id", "model_revision"], "left")
    state = (
        F.when(F.col("vector").isNull(), "missing").when(F.size("vector") == 0, "empty").when(F.col("dims").isNull(), "unknown model").when(F.size("vector") != F.col("dims"), "wrong length")
        .when(~F.exists("vector", lambda x: x != 0), "zero").otherwise("sound")
    )
    return own.groupBy("model_id", "model_revision", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def manifest_counts(shards: DataFrame, manifests: DataFrame) -> DataFrame:
    """(store_id, generation, file_count, found): manifests whose count is not that of their snapshot's paths."""
    found = shards.select("store_id", "generation", relative_path(F.col("path")).alias("path")).distinct().groupBy("store_id", "generation").agg(F.count(F.lit(1)).alias("found"))
    n = F.coalesce("found", F.lit(0))
    return manifests.select("store_id", "generation", "file_count").distinct().join(found, ["store_id", "generation"], "left").where(n != F.col("file_count")).select("store_id", "generation", "file_count", n.alias("found"))


def latest_generations(manifests: DataFrame) -> DataFrame:
    """(store_id, generation, generated_at, late): each store's newest generation, and whether an older one came after it."""
    latest = manifests.groupBy("store_id").agg(F.max(F.struct("generated_at", "generation", "delivered_at")).alias("m"), F.max("delivered_at").alias("d"))
    return latest.select("store_id", "m.generation", "m.generated_at", (F.col("d") > F.col("m.delivered_at")).alias("late"))


def reuse(shards: DataFrame, places: DataFrame) -> DataFrame:
    """(store_id, ord, reused, scanned): files of each generation that the one before holds unchanged, and all others."""
    rows = shards.select("store_id", "generation", relative_path(F.col("path")).alias("path"), digest(F.col("content_hash")).alias("digest")).join(places, ["store_id", "generation"]).select("store_id", "path", "ord", "digest").repartition("store_id", "path").groupBy("store_id", "path", "ord").agg(F.min("digest").alias("digest"))
    w = Window.partitionBy("store_id", "path").orderBy("ord")
    same = (F.lag("ord").over(w) == F.col("ord") - 1) & (F.lag("digest").over(w) == F.col("digest"))
    return rows.withColumn("_same", F.coalesce(same, F.lit(False))).groupBy("store_id", "ord").agg(F.count_if("_same").alias("reused"), F.count_if(~F.col("_same")).alias("scanned"))


def changed_rows(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): symmetric difference of two tables by key and value."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_ha")).distinct(), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_hb")).distinct()
    change = F.when(F.col("_ha").isNull(), "added").when(F.col("_hb").isNull(), "removed").otherwise("changed")
    return a.join(b, key, "full_outer").where(F.col("_ha").isNull() | F.col("_hb").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).select(key, change.alias("change"))


def within_bytes(rows: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """(key, bytes, total): rows in the order of keys as long as their bytes together stay within the limit, rows without bytes among them."""
    sized = rows.select(key, F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))
    return running(sized, [F.col(key)], F.col("bytes"), "total").where(F.col("total") <= limit)

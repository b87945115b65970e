"""What changed between consecutive full snapshots of a table.

Gaps and islands: the rows of a key, ordered by snapshot, fall into islands of
consecutive snapshots with one row hash. An island is a validity interval. Its
start is an ``added`` event, or a ``changed`` one if the island before it ends
in the snapshot just before; an end that no other island follows at once is a
``removed`` event in the next snapshot.

Shuffles: the rows once by (chain, snapshot) to learn the snapshot's place in
its chain (a broadcast join where Spark finds the manifests small), then once
by (chain, key); the deduplication, the islands and the events all reuse that
second partitioning. No group larger than the rows of one key in one chain is
ever sorted together, so neither a large chain nor a large workspace is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_path(path: Column) -> Column:
    """The path without leading ``./``."""
    return F.regexp_replace(path, r"^(\./+)+", "")


def digest(value: Column) -> Column:
    """A digest independent of notation, as bytes: upper case and a ``sha256:`` label don't matter. Null stays null."""
    plain = F.regexp_replace(F.lower(F.trim(value)), "^sha-?256[:=-]", "")
    return F.when(plain.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"\x01"), F.unhex(plain))).when(plain.isNotNull(), F.concat(F.lit(b"\x00"), F.encode(plain, "UTF-8")))


def chain(manifests: DataFrame) -> DataFrame:
    """(store_id, generation, ord, last): each generation's place in its store, from 1, and the store's last place.

    Order is by ``generated_at``, then by ``generation`` where times are equal; repeated rows count once.
    Generations without a store, a name or a time have no place and are left out.
    """
    one = manifests.where("store_id is not null and generation is not null and generated_at is not null").groupBy("store_id", "generation").agg(F.min("generated_at").alias("generated_at"))
    w = Window.partitionBy("store_id")
    return one.select("store_id", "generation", F.row_number().over(w.orderBy("generated_at", "generation")).alias("ord"), F.count(F.lit(1)).over(w).cast("int").alias("last"))


def validity_intervals(shards: DataFrame, places: DataFrame) -> DataFrame:
    """(store_id, path, digest, first, until, last): maximal runs of snapshots in which a path keeps its digest.

    Rows of a snapshot that name a path more than once count once; if their digests differ the smallest one
    counts, a missing one only if there is no other. Rows without a path or of an unknown generation are left out.
    """
    rows = (
        shards.where(F.col("path").isNotNull())
        .select("store_id", "generation", relative_path(F.col("path")).alias("path"), digest(F.col("content_hash")).alias("digest"))
        .join(places, ["store_id", "generation"])
        .select("store_id", "path", "ord", "last", "digest")
        .repartition("store_id", "path")
        .groupBy("store_id", "path", "ord")
        .agg(F.min("digest").alias("digest"), F.min("last").alias("last"))
    )
    w = Window.partitionBy("store_id", "path").orderBy("ord")
    starts = F.when((F.lag("ord").over(w) == F.col("ord") - 1) & F.lag("digest").over(w).eqNullSafe(F.col("digest")), 0).otherwise(1)
    return (
        rows.withColumn("_starts", starts)
        .withColumn("_island", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("store_id", "path", "_island")
        .agg(F.min("digest").alias("digest"), F.min("ord").alias("first"), F.max("ord").alias("until"), F.min("last").alias("last"))
        .drop("_island")
    )


def interval_events(intervals: DataFrame) -> DataFrame:
    """(store_id, ord, path, change) from the starts, ends and adjacencies of intervals."""
    w = Window.partitionBy("store_id", "path").orderBy("first")
    near = intervals.withColumn("_before", F.lag("until").over(w)).withColumn("_after", F.lead("first").over(w))
    begun = F.when(F.col("first") > 1, F.struct(F.col("first").alias("ord"), F.when(F.col("_before") == F.col("first") - 1, "changed").otherwise("added").alias("change")))
    goes = (F.col("until") < F.col("last")) & (F.col("_after").isNull() | (F.col("_after") > F.col("until") + 1))
    ended = F.when(goes, F.struct((F.col("until") + 1).alias("ord"), F.lit("removed").alias("change")))
    return near.select("store_id", "path", F.explode(F.array_compact(F.array(begun, ended))).alias("e")).select("store_id", "e.ord", "path", "e.change")


def snapshot_changes(shards: DataFrame, manifests: DataFrame) -> DataFrame:
    """(store_id, generation, path, change): the differences between each generation of a store and the one before.

    A store's first generation yields nothing. A generation whose manifest is there but that has no rows is an
    empty snapshot: everything before it is removed. Empty tables give no rows; further columns don't matter.
    """
    places = chain(manifests)
    events = interval_events(validity_intervals(shards, places))
    return events.join(places.select("store_id", "ord", "generation"), ["store_id", "ord"]).select("store_id", "generation", "path", "change")

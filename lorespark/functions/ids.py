"""Content-addressed identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(*parts: Column) -> Column:
    """SHA-256, in hex, of the parts joined by NUL. A missing part counts as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def node_id(kind: Column, path: Column, name: Column, symbol_kind: Column | None = None, scope: Column | None = None, line: Column | None = None) -> Column:
    """Identity of a graph node; the scope and the line tell equally named symbols of a file apart."""
    none = F.lit(None).cast("string")
    symbol_kind, scope, line = (none if x is None else x for x in (symbol_kind, scope, line))
    place = F.when(scope.isNull(), F.coalesce(line.cast("string"), F.lit(""))).otherwise(F.concat_ws("\x00", scope, F.coalesce(line.cast("string"), F.lit(""))))
    return content_hash(F.lit("node"), kind, path, name, symbol_kind, place)


def edge_id(kind: Column, source: Column, target: Column, confidence: Column) -> Column:
    return content_hash(F.lit("edge"), kind, source, target, confidence)


def chunk_id(plane: Column, path: Column, start_line: Column, end_line: Column, digest: Column) -> Column:
    return content_hash(F.lit("chunk"), plane, path, start_line, end_line, digest)


def bucket(digest: Column) -> Column:
    """One of 16 buckets: the first hex digit."""
    return F.substring(digest, 1, 1)


def fingerprint(rows, *parts: str, by: str):
    """SHA-256 over all rows: of each row the parts, each followed by NUL, under the hash of ``by``.

    Hashes are combined by the first six digits of the key's hash, these by the first three, and those into one, so
    no task holds more than some thousands of digests and any partitioning gives the same.
    """
    key, row = F.col(by).cast("string"), content_hash(*[F.col(p) for p in parts])
    combined = lambda item: F.sha2(F.array_join(F.sort_array(F.collect_list(item)), "\n"), 256).alias("_d")
    out = rows.select(F.substring(F.sha2(key, 256), 1, 6).alias("_range"), F.concat_ws("\x00", key, row).alias("_h")).groupBy("_range").agg(combined(F.col("_h")))
    out = out.groupBy(F.substring("_range", 1, 3).alias("_wide")).agg(combined(F.concat("_range", "_d")))
    return out.agg(combined(F.concat("_wide", "_d"))).withColumnRenamed("_d", "fingerprint")

"""Change evidence from Git's machine-readable output, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_blobs(output: str) -> dict[str, str]:
    """path -> blob of ``ls-files -s -z``; entries of a merge conflict have no single blob and are left out."""
    blobs: dict[str, str] = {}
    for entry in output.split("\0"):
        if m := re.fullmatch(r"\d{6} ([0-9a-f]{40,64}) 0\t(.+)", entry, re.S):
            blobs[m.group(2)] = m.group(1)
    return blobs


def porcelain_paths(output: str) -> list[str]:
    """Paths of ``status --porcelain -z``; of renames and copies both."""
    entries, paths, at = output.split("\0"), [], 0
    while at < len(entries):
        entry, at = entries[at], at + 1
        if len(entry) < 4:
            continue
        paths.append(entry[3:])
        if entry[0] in "RC" or entry[1] in "RC":
            paths.append(entries[at])
            at += 1
    return sorted(set(paths))


def changed(spark: SparkSession, committed: list[str], working: list[str]) -> DataFrame:
    """(path, evidence): distinct paths of a diff and of the working tree; working-tree wins."""
    rows = [(p, "committed") for p in committed] + [(p, "working-tree") for p in working]
    return spark.createDataFrame(rows, "path string, evidence string").groupBy("path").agg(F.max("evidence").alias("evidence"))


def source_ids(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """files (path, content) with their source: the index's blob (path, blob), or a hash of the content. Binary files, which hold NUL, are left out."""
    text = files.where(~F.coalesce(F.col("content").contains("\x00"), F.lit(False)))
    hashed = F.concat(F.lit("worktree:"), F.sha2("content", 256))
    return text.join(blobs, "path", "left").withColumn("source_id", F.coalesce(F.concat(F.lit("git:"), F.col("blob")), hashed)).drop("blob")


def skipped_files(spark: SparkSession, root: str, most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """(path, code) of the files that ``read_repository`` leaves out although no rule excludes them: too large, or binary."""
    from lorespark.functions.text import excluded

    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root) + "/", "")
    large = raw.where(F.col("length") > most_bytes).select(path.alias("path"), F.lit("FILE_TOO_LARGE").alias("code"))
    binary = raw.where((F.col("length") <= most_bytes) & F.contains("content", F.lit(b"\x00"))).select(path.alias("path"), F.lit("BINARY_FILE").alias("code"))
    return large.unionAll(binary).where(~excluded(F.col("path")))


def read_repository(spark: SparkSession, root: str, most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """(path, content, size, content_hash) of a directory's text files, excluded ones and larger ones left out by the scan's own metadata."""
    from lorespark.functions.text import excluded

    root = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most_bytes)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = raw.select(F.regexp_replace(path, "^" + re.escape(root) + "/", "").alias("path"), "content", F.col("length").alias("size")).where(~excluded(F.col("path")))
    return rows.where(~F.contains("content", F.lit(b"\x00"))).select("path", F.decode("content", "UTF-8").alias("content"), "size", F.sha2("content", 256).alias("content_hash"))

"""Generations of a graph in a directory: written once, published by a pointer, the one before kept for recovery."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.ids import fingerprint
from lorespark.sources.shared import kept

TABLES = ("nodes", "edges")


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Written beside, then renamed over in one step: a reader sees the old file or the new one."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at, beside = hadoop.Path(path), hadoop.Path(f"{path}.new")
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(beside, True)
    stream.write(bytearray(content))
    stream.close()
    options = spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(beside.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, at, options)


class GenerationStore:
    """``root`` is a path of any Hadoop file system; all writing of files goes through it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _pointer(self, name: str) -> str | None:
        if not self._exists(name):
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}").collect()))["generation"]

    def _point(self, name: str, generation: str) -> None:
        """Written beside, then renamed over: a reader sees the old pointer or the new one."""
        replace_file(self.spark, f"{self.root}/{name}", json.dumps({"generation": generation}).encode())

    def write(self, nodes: DataFrame, edges: DataFrame) -> str:
        """The generation's name, a hash of its content; an equal graph is not written again."""
        marks = [fingerprint(df, *df.columns, by="id").first()[0] for df in (nodes, edges)]
        generation = "g-" + self.spark.sql("select sha2(:m, 256)", args={"m": "\n".join(marks)}).first()[0]
        if not self._exists(f"{generation}/_DONE"):
            for name, df in zip(TABLES, (nodes, edges)):
                df.write.mode("overwrite").parquet(f"{self.root}/{generation}/{name}")
            self._fs.create(self._path(f"{self.root}/{generation}/_DONE"), True).close()
        current = self._pointer("current")
        if current != generation:
            if current:
                self._point("previous", current)
            self._point("current", generation)
        self.collect_garbage()
        return generation

    def read(self) -> tuple[DataFrame, DataFrame, str, bool]:
        """Nodes, edges, generation, and whether the previous one had to stand in for a damaged current one."""
        for name in ("current", "previous"):
            generation = self._pointer(name)
            if generation and self._exists(f"{generation}/_DONE"):
                return (*[self.spark.read.parquet(f"{self.root}/{generation}/{t}") for t in TABLES], generation, name == "previous")
        raise FileNotFoundError("no readable generation")

    def collect_garbage(self) -> None:
        """Only the current and the previous generation stay."""
        keep = {self._pointer("current"), self._pointer("previous")}
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            if name.startswith("g-") and name not in keep:
                self._fs.delete(status.getPath(), True)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str, digest: str, bucket: str) -> tuple[int, int]:
    """Rows put over stored ones of the same key; (written, reused). Only the buckets that change are rewritten.

    Rows with a known key and digest are left alone.
    """
    rows = kept(rows)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        n = rows.count()
        rows.write.partitionBy(bucket).parquet(path)
        return n, 0
    old = spark.read.parquet(path).withColumn(bucket, F.col(bucket).cast(rows.schema[bucket].dataType))
    fresh = kept(rows.join(old.select(key, digest), [key, digest], "left_anti"))
    written = fresh.count()
    if written:
        touched = fresh.select(bucket).distinct()
        stay = old.join(touched, bucket, "left_semi").join(fresh.select(key), key, "left_anti")
        merged = kept(stay.select(*rows.columns).unionByName(fresh))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(path)
    return written, rows.count() - written

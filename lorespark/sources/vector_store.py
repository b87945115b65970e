"""Stored int8 vectors by model and revision, with a manifest that says which are there."""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.vectors import dot, norm, quantised, unit
from lorespark.sources.shared import file_system, read_file
from lorespark.sources.store import upsert


class VectorStore:
    """``root`` holds one folder for each model and revision, in buckets by a hash of the chunk's id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = file_system(spark, self.root)[0]

    def _folder(self, model: str, revision: str) -> str:
        return f"{self.root}/" + "--".join(re.sub(r"[^\w.-]", lambda m: f"%{ord(m.group()):x}", x) for x in (model, revision))

    def _set(self, model: str, revision: str, entry: dict) -> None:
        folder = f"{self._folder(model, revision)}/manifest"
        name = f"{folder}/{len(self._entries(folder)):08}.json"
        beside = file_system(self.spark, f"{folder}/.{uuid.uuid4().hex}")[1]
        stream = self.fs.create(beside, True)
        stream.write(bytearray(json.dumps(entry | {"model_id": model, "model_revision": revision}).encode()))
        stream.close()
        if self.fs.exists(file_system(self.spark, name)[1]) or not self.fs.rename(beside, file_system(self.spark, name)[1]):
            raise RuntimeError("another writer was first; write again")

    def _entries(self, folder: str) -> list[str]:
        at = file_system(self.spark, folder)[1]
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at) if s.getPath().getName().endswith(".json")) if self.fs.exists(at) else []

    def manifest(self, model: str, revision: str) -> dict | None:
        """The newest entry of a model, or None."""
        folder = f"{self._folder(model, revision)}/manifest"
        names = self._entries(folder)
        return json.loads(read_file(self.spark, f"{folder}/{names[-1]}")) if names else None

    def mark_unavailable(self, model: str, revision: str, reason: str) -> None:
        """Search by this model is off from now on; its vectors stay."""
        self._set(model, revision, (self.manifest(model, revision) or {"dims": None, "dtype": "int8"}) | {"embeddings_available": False, "unavailable_reason": reason})

    def upsert(self, model: str, revision: str, rows: DataFrame, dims: int) -> tuple[int, int]:
        """Takes over rows (chunk_id, digest, vector of floats); (written, reused). Rows with a known id and digest are left alone.

        Vectors are made unit length and quantised; missing and wrongly long ones are left out. A change of ``dims`` is refused.
        """
        m = self.manifest(model, revision)
        if m and m["dims"] not in (None, dims):
            raise ValueError(f"{model} {revision} has vectors of {m['dims']} dims")
        sound = rows.where((F.size("vector") == dims) & F.col("chunk_id").isNotNull()).select("chunk_id", "digest", F.col("vector").alias("_v"), norm(F.col("vector")).alias("_n"))
        own = sound.select("chunk_id", "digest", quantised(unit(F.col("_v"), F.col("_n"))).alias("vector"), F.pmod(F.xxhash64("chunk_id"), F.lit(16)).cast("int").alias("bucket")).dropDuplicates(["chunk_id"])
        done = upsert(self.spark, f"{self._folder(model, revision)}/vectors", own, "chunk_id", "digest", "bucket")
        if not m or not m["embeddings_available"] or m["dims"] is None:
            self._set(model, revision, {"dims": dims, "dtype": "int8", "embeddings_available": True, "unavailable_reason": None})
        return done

    def unknown(self, model: str, revision: str, chunks: DataFrame) -> DataFrame:
        """Of chunks (chunk_id, digest, ...) those that have no vector of their digest yet: what an embedder has to see."""
        if not self.manifest(model, revision):
            return chunks
        return chunks.join(self._rows(model, revision).select("chunk_id", "digest"), ["chunk_id", "digest"], "left_anti")

    def embed(self, model: str, revision: str, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dims: int) -> tuple[int, int]:
        """Runs an embedder, in Arrow batches on the workers, over the chunks (chunk_id, digest, text) it has not seen, and stores its vectors."""

        def run(frames):
            for f in frames:
                yield f[["chunk_id", "digest"]].assign(vector=[list(map(float, v)) for v in embed(f["text"].tolist())] if len(f) else [])

        vectors = self.unknown(model, revision, chunks.where("text is not null")).select("chunk_id", "digest", "text").mapInPandas(run, "chunk_id string, digest string, vector array<double>")
        return self.upsert(model, revision, vectors, dims)

    def _rows(self, model: str, revision: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder(model, revision)}/vectors")

    def read(self, model: str, revision: str) -> DataFrame:
        """(chunk_id, digest, vector) of a model; a model that is unknown or marked unavailable is an error."""
        m = self.manifest(model, revision)
        if not m or not m["embeddings_available"]:
            raise LookupError(f"{model} {revision}: " + (m["unavailable_reason"] if m else "no vectors"))
        return self._rows(model, revision).select("chunk_id", "digest", "vector")

    def search(self, model: str, revision: str, query: list[float], limit: int) -> DataFrame:
        """(chunk_id, score): the nearest stored vectors by dot product, equal ones by id; a scan of int8 and a top-k."""
        return scored(self.read(model, revision), "chunk_id", query).orderBy(F.desc("score"), "chunk_id").limit(limit)


def scored(vectors: DataFrame, key: str, query: list[float]) -> DataFrame:
    """(key, score): the dot product of each stored int8 vector with the query's unit vector. Of another length than the query's: left out."""
    length = math.sqrt(sum(x * x for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / length / 127) for x in query])
    return vectors.where(F.size("vector") == len(query)).select(key, F.round(dot(F.col("vector"), q), 9).alias("score"))

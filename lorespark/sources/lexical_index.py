"""A stored index of texts: postings by term, updated by segments, searched by its terms alone.

Each update writes one segment with the postings of the texts that changed, and
the (id, segment) pairs that these replace; nothing that is stored is rewritten.
A manifest names the segments and holds the number of texts and of their words,
so a search reads only the postings of its own terms and trigrams: buckets are
pruned, terms pushed into the scan. ``compact`` writes all that is alive into one
segment.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.text import trigrams, words
from lorespark.operators.lexical import B, K1, TRIGRAM_WEIGHT, _of_query
from lorespark.sources.shared import file_system, kept, looked_up, read_file, release, spread, write_by

#: Words up to which a segment is small.
SMALL = 200_000
PARTS = {"documents": "id string, digest string, len int", "dead": "id string, segment string", "postings": "term string, id string, tf int, len int", "grams": "gram string, term string"}


class LexicalIndex:
    """``root`` is a path of any Hadoop file system. Ids are strings; a repeated id counts once, the greatest text of it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = file_system(spark, self.root)[0]

    # The manifest

    def _manifests(self) -> list[str]:
        at = file_system(self.spark, f"{self.root}/manifests")[1]
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at) if not s.getPath().getName().startswith(("_", "."))) if self.fs.exists(at) else []

    def manifest(self) -> dict:
        """The newest complete one. A manifest is a new file each time, so readers see the old or the new state."""
        for name in reversed(self._manifests()):
            return json.loads(read_file(self.spark, f"{self.root}/manifests/{name}"))
        return {"segments": [], "texts": 0, "words": 0, "version": 0}

    def _publish(self, segments: list[str], texts: int, n_words: int, version: int) -> None:
        name = f"{self.root}/manifests/{version:08}.json"
        beside = file_system(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")[1]
        stream = self.fs.create(beside, True)
        stream.write(bytearray(json.dumps({"segments": segments, "texts": texts, "words": n_words, "version": version}).encode()))
        stream.close()
        at = file_system(self.spark, name)[1]
        if self.fs.exists(at) or not self.fs.rename(beside, at):
            raise RuntimeError("another writer was first; update again")

    def _read(self, part: str, segments: list[str]) -> DataFrame:
        columns = [c.split()[0] for c in PARTS[part].split(", ")]
        out = None
        for s in segments:
            df = self.spark.read.schema(PARTS[part] + ("" if part in ("documents", "dead") else ", bucket int")).parquet(f"{self.root}/{s}/{part}")
            df = df.select(*columns, *(["bucket"] if "bucket" in df.columns else []), F.lit(s).alias("own"))
            out = df if out is None else out.unionAll(df)
        if out is None:
            out = self.spark.createDataFrame([], PARTS[part] + (", bucket int" if part in ("postings", "grams") else "") + ", own string")
        return out

    def _alive(self, df: DataFrame, manifest: dict) -> DataFrame:
        """Rows (id, own) that no later segment replaced."""
        if len(manifest["segments"]) < 2:
            return df
        dead = self._read("dead", manifest["segments"][1:]).select("id", F.col("segment").alias("own"))
        return df.join(dead, ["id", "own"], "left_anti")

    def documents(self) -> DataFrame:
        """(id, digest, len, own)"""
        m = self.manifest()
        return self._alive(self._read("documents", m["segments"]), m)

    # Writing

    def update(self, texts: DataFrame, whole: bool = False) -> tuple[int, int]:
        """Takes over texts (id, text); (texts written, texts dropped). Only those whose digest is new are indexed.

        With ``whole`` the texts are all there are: ids that are missing are dropped. Null and empty texts are texts without words.
        """
        m = self.manifest()
        rows = texts.where("id is not null").groupBy(F.col("id").cast("string").alias("id")).agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
        rows = rows.withColumn("digest", F.sha2("text", 256))
        old = self.documents()
        if not m["segments"]:
            return self._write(m, rows, old.select("id", "own", "len").where("false"))
        fresh = kept(rows.join(old.select("id", "digest"), ["id", "digest"], "left_anti"))
        replaced = old.join(fresh.select("id"), "id", "left_semi").select("id", "own", "len")
        gone = old.join(rows.select("id"), "id", "left_anti").select("id", "own", "len") if whole else replaced.where("false")
        return self._write(m, fresh, kept(replaced.unionAll(gone)), gone)

    def remove(self, ids: DataFrame) -> int:
        """Drops texts by id; the number that was there."""
        m = self.manifest()
        gone = kept(self.documents().join(ids.select(F.col("id").cast("string")).distinct(), "id", "left_semi").select("id", "own", "len"))
        none = self.spark.createDataFrame([], "id string, text string, digest string")
        return self._write(m, none, gone, gone)[1]

    def _write(self, m: dict, fresh: DataFrame, dead: DataFrame, gone: DataFrame | None = None) -> tuple[int, int]:
        segment = f"segment-{m['version'] + 1:08}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{segment}"
        counted = spread(fresh).select("id", "digest", words(F.col("text")).alias("w")).select("id", "digest", F.size("w").alias("len"), "w")
        counted.select("id", "digest", "len").write.parquet(f"{path}/documents")
        release(self.spark)  # the texts are shuffled again for the postings
        plus = self._read("documents", [segment]).agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
        small = plus[1] < SMALL
        own = counted.select("id", "len", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.any_value("len").alias("len"))
        write_by(own, f"{path}/postings", "term", small=small)
        release(self.spark)
        terms = self.spark.read.schema("term string").parquet(f"{path}/postings").select("term").distinct()
        write_by(terms.select(F.explode(trigrams(F.col("term"))).alias("gram"), "term"), f"{path}/grams", "gram", small=small)
        dead.select("id", F.col("own").alias("segment")).write.parquet(f"{path}/dead")
        minus = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first() if m["segments"] else (0, 0)
        dropped = gone.count() if gone is not None else 0
        if plus[0] or minus[0] or not m["segments"]:
            self._publish([*m["segments"], segment], m["texts"] + plus[0] - minus[0], m["words"] + plus[1] - minus[1], m["version"] + 1)
        else:
            self.fs.delete(file_system(self.spark, path)[1], True)
        return plus[0], dropped

    def compact(self) -> None:
        """All that is alive into one segment; older segments are removed once the new manifest is out."""
        m = self.manifest()
        if len(m["segments"]) < 2:
            return
        segment = f"segment-{m['version'] + 1:08}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{segment}"
        self.documents().select("id", "digest", "len").write.parquet(f"{path}/documents")
        write_by(self._alive(self._read("postings", m["segments"]), m).select("term", "id", "tf", "len"), f"{path}/postings", "term")
        terms = self.spark.read.schema("term string").parquet(f"{path}/postings").select("term").distinct()
        write_by(terms.select(F.explode(trigrams(F.col("term"))).alias("gram"), "term"), f"{path}/grams", "gram")
        self.spark.createDataFrame([], PARTS["dead"]).write.parquet(f"{path}/dead")
        self._publish([segment], m["texts"], m["words"], m["version"] + 1)
        for s in m["segments"]:
            self.fs.delete(file_system(self.spark, f"{self.root}/{s}")[1], True)

    # Searching

    def postings(self, terms: list[str]) -> DataFrame:
        """(term, id, tf, len) of some terms."""
        m = self.manifest()
        return self._alive(looked_up(self._read("postings", m["segments"]), "term", terms), m).drop("own")

    def bm25(self, query: str) -> DataFrame:
        """(id, score): as ``operators.lexical.bm25``, from the postings of the query's terms."""
        m, terms = self.manifest(), _of_query(self.spark, query, words)
        repeats = {t: float(terms.count(t)) for t in terms}
        if not repeats or not m["texts"]:
            return self.spark.createDataFrame([], "id string, score double")
        hits = self.postings(list(repeats))
        df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each term of the query
        q = F.create_map(*[F.lit(x) for pair in repeats.items() for x in pair])[F.col("term")]
        idf = F.log(1 + (F.lit(m["texts"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        average = max(m["words"] / m["texts"], 1e-12)
        part = q * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / average))
        return hits.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))

    def trigram_scores(self, query: str) -> DataFrame:
        """(id, score): as ``operators.lexical.trigram_scores``, from the terms that hold the query's trigrams."""
        m, grams = self.manifest(), _of_query(self.spark, query, trigrams)
        if not grams or not m["segments"]:
            return self.spark.createDataFrame([], "id string, score double")
        held = looked_up(self._read("grams", m["segments"]), "gram", grams).select("gram", "term").distinct()
        by_term = held.groupBy("term").agg(F.collect_list("gram").alias("grams"))  # at most the query's trigrams each
        hits = self._alive(self._read("postings", m["segments"]).select("term", "id", "own").join(by_term, "term"), m)
        found = hits.select("id", F.explode("grams").alias("gram")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))
        return found.select("id", (F.lit(TRIGRAM_WEIGHT) * F.col("n") / len(grams)).alias("score"))

    def scores(self, query: str) -> DataFrame:
        """(id, score): BM25 plus trigram score of every text that has either."""
        return self.bm25(query).unionByName(self.trigram_scores(query)).groupBy("id").agg(F.round(F.sum("score"), 9).alias("score"))

    def search(self, query: str, limit: int) -> DataFrame:
        """(id, score): the best first, equal ones by id."""
        return self.scores(query).orderBy(F.desc("score"), "id").limit(limit)

"""Pages as Markdown files below one folder: read, written, indexed page by page, and sealed by a hash of all of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.ids import chunk_id, fingerprint
from lorespark.functions.text import is_relative
from lorespark.operators.pages import chunk_pages, lines_of
from lorespark.sources.lexical_index import LexicalIndex
from lorespark.sources.shared import file_system, kept, one_row, read_file
from lorespark.sources.store import replace_file, upsert


def page_chunks(pages: DataFrame) -> DataFrame:
    """(id, page, start_line, end_line, digest, text) of pages (page, content): the chunks that are indexed, with their lines."""
    cut = chunk_pages(pages, "page", "content").join(pages.where("content is not null").select("page", lines_of(F.col("content")).alias("_l")), "page")
    text = F.array_join(F.slice("_l", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    own = cut.select("page", "start_line", "end_line", text.alias("text")).withColumn("digest", F.sha2("text", 256))
    return own.select(chunk_id(F.lit("wiki"), F.col("page"), F.col("start_line"), F.col("end_line"), F.col("digest")).alias("id"), "page", "start_line", "end_line", "digest", "text")


class Wiki:
    """``root``/pages holds the files, ``root``/index the postings, ``root``/chunks which chunks each page has, ``root``/state.json the last sealed run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.index = LexicalIndex(spark, f"{self.root}/index")

    def _file(self, page: str) -> str:
        """The file of a page; only relative Markdown paths within the folder are pages."""
        inside = one_row(self.spark).select(is_relative(F.lit(page))).first()[0]
        if not inside or not page.endswith(".md"):
            raise ValueError(f"no page: {page}")
        return f"{self.root}/pages/{page}"

    def pages(self) -> DataFrame:
        """(page, content)"""
        fs, at = file_system(self.spark, f"{self.root}/pages")
        if not fs.exists(at):
            return self.spark.createDataFrame([], "page string, content string")
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(f"{self.root}/pages")
        own = raw.select(F.element_at(F.split("path", "/pages/", 2), 2).alias("page"), F.decode("content", "UTF-8").alias("content"))
        # a scan passes over files without bytes, so their names come from the listing
        empty, files = [], fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            if f.getLen() == 0 and f.getPath().getName().endswith(".md"):
                empty.append((f.getPath().toString().split("/pages/", 1)[1], ""))
        return own.unionAll(self.spark.createDataFrame(empty, "page string, content string")) if empty else own

    def read(self, page: str) -> str:
        fs, at = file_system(self.spark, self._file(page))
        if not fs.exists(at):
            raise FileNotFoundError(page)
        row = self.spark.read.format("binaryFile").load(self._file(page)).select(F.decode("content", "UTF-8")).first()
        return row[0] if row else ""

    def write(self, page: str, content: str) -> tuple[int, int]:
        """Replaces a page's file in one step and indexes the chunks that are new; (chunks written, chunks dropped)."""
        replace_file(self.spark, self._file(page), content.encode())
        return self.reindex(self.spark.createDataFrame([(page, content)], "page string, content string"))

    def reindex(self, pages: DataFrame) -> tuple[int, int]:
        """Brings the index up to some pages (page, content) as they are now; (chunks written, chunks dropped). Other pages are not read."""
        now = kept(page_chunks(pages).withColumn("bucket", F.pmod(F.xxhash64("page"), F.lit(16)).cast("int")))
        path = f"{self.root}/chunks"
        fs, at = file_system(self.spark, path)
        dropped = 0
        if fs.exists(at):
            named = pages.select("page", F.pmod(F.xxhash64("page"), F.lit(16)).cast("int").alias("bucket")).distinct()
            stored = self.spark.read.schema("page string, ids array<string>, digest string, bucket int").parquet(path)
            old = stored.join(named, ["page", "bucket"], "left_semi").select(F.explode("ids").alias("id"))
            dropped = self.index.remove(kept(old.join(now.select("id"), "id", "left_anti")))
        written, _ = self.index.update(now.select("id", "text"))
        of_page = pages.select("page").distinct().join(now.groupBy("page").agg(F.array_sort(F.collect_list("id")).alias("ids")), "page", "left")
        rows = of_page.select("page", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")).withColumn("digest", F.sha2(F.array_join("ids", ","), 256)).withColumn("bucket", F.pmod(F.xxhash64("page"), F.lit(16)).cast("int"))
        upsert(self.spark, path, rows, "page", "digest", "bucket")
        return written, dropped

    def state(self) -> dict | None:
        fs, at = file_system(self.spark, f"{self.root}/state.json")
        return json.loads(read_file(self.spark, f"{self.root}/state.json")) if fs.exists(at) else None

    def finalise(self, run: str, completed_at: str, summary: str = "") -> bool:
        """Seals a run with the hash of all pages; nothing is written, and the answer is no, if that hash is the last run's."""
        mark = fingerprint(self.pages(), "page", "content", by="page").first()[0]
        last = self.state()
        if last and last["content_hash"] == mark:
            return False
        replace_file(self.spark, f"{self.root}/state.json", json.dumps({"content_hash": mark, "run": run, "completed_at": completed_at, "summary": summary}).encode())
        return True

    def purge(self, *scopes: str) -> None:
        """Removes what a scope names: pages, index or state."""
        folders = {"pages": ["pages"], "index": ["index", "chunks"], "state": ["state.json"]}
        for scope in scopes:
            for name in folders[scope]:
                fs, at = file_system(self.spark, f"{self.root}/{name}")
                fs.delete(at, True)

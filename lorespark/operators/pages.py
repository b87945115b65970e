"""Pages: lines, blocks, chunks, links and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions.text import estimated_tokens, markdown_links

LEAST, MOST = 200, 400


def lines_of(content: Column) -> Column:
    """Lines of a text; one line end at its very end is none."""
    return F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n", -1)


def line_counts(pages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, lines)"""
    return pages.where(F.col(content).isNotNull()).select(key, F.size(lines_of(F.col(content))).alias("lines"))


def blocks(pages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, start_line, end_line, tokens, text): runs of lines between blank lines; a heading begins a block of its own.

    Folded within each page's array of lines, so pages are never exploded into lines and nothing is shuffled.
    """
    numbered = F.transform(lines_of(F.col(content)), lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    blank = lambda s: F.trim(F.regexp_replace(s, r"\s", "")) == ""
    empty = F.array().cast("array<struct<start_line:int,end_line:int,text:string>>")

    def add(acc: Column, x: Column) -> Column:
        fresh = F.struct(x["line"].alias("start_line"), x["line"].alias("end_line"), x["text"].alias("text"))
        last = F.element_at(acc["blocks"], -1)
        longer = F.struct(last["start_line"].alias("start_line"), x["line"].alias("end_line"), F.concat_ws("\n", last["text"], x["text"]).alias("text"))
        grown = F.when(acc["open"] & ~x["text"].rlike(r"^#{1,6}\s+\S"), F.concat(F.slice(acc["blocks"], F.lit(1), F.size(acc["blocks"]) - 1), F.array(longer))).otherwise(F.concat(acc["blocks"], F.array(fresh)))
        return F.struct(F.when(blank(x["text"]), acc["blocks"]).otherwise(grown).alias("blocks"), (~blank(x["text"])).alias("open"))

    folded = F.aggregate(numbered, F.struct(empty.alias("blocks"), F.lit(False).alias("open")), add)["blocks"]
    return pages.where(F.col(content).isNotNull()).select(key, F.explode(folded).alias("b")).select(key, "b.start_line", "b.end_line", estimated_tokens(F.col("b.text")).alias("tokens"), F.col("b.text").alias("text"))


def chunk_pages(pages: DataFrame, key: str, content: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """(key, start_line, end_line, tokens): blocks packed into chunks.

    A chunk is closed when it has ``least`` tokens and the next block would take it beyond ``most``; it then reaches to the
    line before that block. It is closed at its own end when it has ``most``; the last one reaches to the page's last line.
    Blocks are gathered by page: their number is bounded by a page's length.
    """
    last_line = pages.where(F.col(content).isNotNull()).select(key, F.size(F.split(content, r"\r?\n", -1)).alias("_n"))
    gathered = blocks(pages, key, content).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_line", "end_line", "tokens"))).alias("bs"))
    empty = F.array().cast("array<struct<start_line:int,end_line:int,tokens:int>>")

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        closes = (F.size(acc) == 0) | (last["tokens"] >= most) | ((last["tokens"] >= least) & (last["tokens"] + x["tokens"] > most))
        merged = F.struct(last["start_line"].alias("start_line"), x["end_line"].alias("end_line"), (last["tokens"] + x["tokens"]).alias("tokens"))
        return F.when(closes, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(merged)))

    packed = gathered.select(key, F.aggregate("bs", empty, add).alias("cs")).join(last_line, key)
    each = packed.select(key, "_n", F.posexplode("cs").alias("i", "c"), "cs")
    after = F.try_element_at("cs", (F.col("i") + 2).cast("int"))["start_line"]
    end = F.when(F.col("c.tokens") >= most, F.col("c.end_line")).otherwise(F.coalesce(after - 1, F.col("_n")))
    return each.select(key, "c.start_line", end.alias("end_line"), "c.tokens")


def links(pages: DataFrame, key: str, content: str) -> DataFrame:
    """(key, target): distinct local Markdown targets, without fragment; targets with a scheme are left out."""
    bare = F.regexp_replace(F.col("target"), "#.*$", "")
    found = pages.where(F.col(content).isNotNull()).select(key, F.explode(markdown_links(F.col(content))).alias("target"))
    return found.where(~F.col("target").rlike("^[A-Za-z][A-Za-z0-9+.-]*:")).select(key, bare.alias("target")).where("target like '%.md'").distinct()


def broken_links(pages: DataFrame, key: str, content: str) -> DataFrame:
    """Local links to no page; those that climb out with ``../`` are broken too."""
    own = links(pages, key, content)
    folder = F.regexp_extract(key, r"^(.*/)?[^/]*$", 1)
    resolved = own.withColumn("_at", F.regexp_replace(F.concat(folder, F.regexp_replace("target", r"^(\./)+", "")), "^/+", ""))
    known = pages.select(F.col(key).alias("_at")).distinct()
    return resolved.join(known, "_at", "left_anti").select(key, "target")


def page_violations(nodes: DataFrame, edges: DataFrame, kind: str = "mentions") -> DataFrame:
    """(rule, key): pages without an edge of evidence."""
    pages = nodes.where("kind = 'page'").select("id")
    cited = edges.where(F.col("kind") == kind).select(F.col("from_id").alias("id")).distinct()
    return pages.join(cited, "id", "left_anti").select(F.lit("page without edge").alias("rule"), F.col("id").alias("key"))


def symbol_chunks(nodes: DataFrame) -> DataFrame:
    """(id, text): one chunk of metadata a symbol, without its source: its qualified name, kind, path and line where known."""
    have = lambda c: F.col(c) if c in nodes.columns else F.lit(None)
    scope = F.coalesce(F.concat(F.nullif(have("scope").cast("string"), F.lit("")), F.lit(".")), F.lit(""))
    label = F.coalesce(F.concat(F.lit(" ("), have("symbol_kind").cast("string"), F.lit(")")), F.lit(""))
    line = have("start_line").cast("string")
    lines = F.coalesce(F.concat(F.lit(":"), line, F.lit("-"), F.coalesce(have("end_line").cast("string"), line)), F.lit(""))
    return nodes.where("kind = 'symbol'").select("id", F.concat("kind", F.lit(" "), scope, "name", label, F.lit(" — "), "path", lines).alias("text"))

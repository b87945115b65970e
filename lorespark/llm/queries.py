"""The queries of this package over the test tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import bpe, leakage, neighbours, pii, reading, splitting, syntax
from lorespark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Problem 5


_CHUNK_TEXT = r"""
  pages as (select page as path, string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n') as lines
            from (select distinct page, content from wiki_pages where content is not null)),
  refs as (select distinct id, path, start_line, end_line from chunk_refs),
  chunks as (select id, array_to_string(lines[start_line:least(end_line, len(lines))], chr(10)) as text from refs join pages using (path))
"""


@query(f"with {_CHUNK_TEXT} select distinct id from chunks where length(text) > 2000")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf, "chunk_refs"), table(spark, sf, "wiki_pages")).where("piece = 1").select("id").distinct()


@query()
def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_chunks(table(spark, sf, "chunk_refs"), table(spark, sf, "wiki_pages"))


# Problem 6


@query()
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf, "documents"))


# Problem 7


@query(r"""
with i as (select item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') as w from (select distinct item_id, item_text from eval_items where item_text is not null)),
  d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from (select distinct doc_id, text from documents where text is not null)),
  wi as (select distinct item_id, array_to_string(w[k:k+12], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 11)) as k from i)),
  wd as (select distinct doc_id, array_to_string(w[k:k+12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as k from d))
select distinct doc_id, item_id from wd join wi using (g)
""")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@query()
def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


# Problem 8


@query()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


@query()
def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_profile(table(spark, sf, "documents"), table(spark, sf, "reading_labels")).withColumns({c: F.round(c, 6) for c in ("bits", "share_1", "share_2", "share_3", "share_4")})


# Problem 2


@query()
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf, "vector_store"), table(spark, sf, "vector_manifest"))


# Problem 3


@query()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.syntax_diagnostics(table(spark, sf, "graph_files")).select("workspace_id", "path").distinct()


@query()
def p3_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.syntax_diagnostics(table(spark, sf, "graph_files"))


@query()
def p3_rates(spark: SparkSession, sf: str) -> DataFrame:
    return syntax.syntax_rates(table(spark, sf, "graph_files"))


# Problem 1


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("row_id"), "text")
    return a.unionAll(table(spark, sf, "source_items").select(F.lit("source_items").alias("tbl"), F.col("item_id").alias("row_id"), "text"))


@query()
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_mentions(_texts(spark, sf)).select("tbl", "row_id", "pii_type", "start_pos")


@query()
def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    texts = _texts(spark, sf)
    return pii.redact(texts, pii.find_mentions(texts))

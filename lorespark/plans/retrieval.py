"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.ids import fingerprint
from lorespark.operators import lexical, retrieval, vectors
from lorespark.plans.registry import query
from lorespark.sources.tables import table

QUERY = "stale lexical index rebuild of the search page"
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_DOCS = f"docs as (select doc_id, {_WORDS.format('text')} as w from documents where text is not null)"
_Q = f"q as (select unnest({_WORDS.format(repr(QUERY))}) as term)"
_BM25 = f"""
  {_DOCS}, {_Q},
  qt as (select term, count(*) as q from q group by 1),
  n as (select count(*) as n, avg(len(w)) as avgdl from (select w from docs union all select [] as w from documents where text is null)),
  tf as (select doc_id, len(w) as len, term, count(*) as tf from (select doc_id, w, unnest(w) as term from docs) where term in (select term from qt) group by all),
  df as (select term, count(*) as df from tf group by 1),
  bm as (select doc_id, round(sum(q * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 9) as score from tf join df using (term) join qt using (term), n group by 1)
"""
_TRI = f"""
  grams as (select doc_id, unnest(list_distinct(flatten(list_transform(list_filter(w, lambda x: length(x) > 2), lambda x: list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)))))) as g from docs),
  qg as (select distinct unnest(flatten(list_transform(list_filter({_WORDS.format(repr(QUERY))}, lambda x: length(x) > 2), lambda x: list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))))) as g),
  tri as (select doc_id, 0.01::double * count(*) / (select count(*) from qg) as score from grams join qg using (g) group by 1)
"""
_LEX = "lex as (select doc_id, round(sum(score), 9) as score from (select * from bm union all select * from tri) group by 1)"
_QV = "qv as (select embedding as v from embeddings where vec_id = 0)"
_QUANT = "select vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])) * 127 + 0.5))) / 127) as s from embeddings"
_VEC = f"""
  {_QV}, stored as ({_QUANT}),
  vec as (select vec_id, round(list_dot_product(s, list_transform(v, lambda x: x::double / sqrt(list_dot_product(v::double[], v::double[])))), 9) as score from stored, qv)
"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


@query(f"with {_DOCS} select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from docs) group by all")
def lexical_tf(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.term_frequencies(_docs(spark, sf), "doc_id", "text")


@query(f"with {_DOCS} select term, count(distinct doc_id) as df from (select doc_id, unnest(w) as term from docs) group by all")
def lexical_df(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.document_frequencies(_docs(spark, sf), "text")


@query(f"with {_DOCS} select count(*) as documents, sum(len(w)) as total, round(avg(len(w)), 6) as average, max(len(w)) as longest from docs")
def lexical_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    return _docs(spark, sf).where("text is not null").agg(F.count(F.lit(1)).alias("documents"), F.sum(n).alias("total"), F.round(F.avg(n), 6).alias("average"), F.max(n).alias("longest"))


@query(f"with {_BM25} select doc_id, round(score, 6) as score from bm")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf), "doc_id", "text", QUERY).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_BM25} select doc_id, round(score, 6) as score from bm order by bm.score desc, doc_id limit 50")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.bm25(_docs(spark, sf), "doc_id", "text", QUERY).orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_DOCS}, {_TRI} select doc_id, round(score, 9) as score from tri")
def trigram_score(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.trigram_scores(_docs(spark, sf), "doc_id", "text", QUERY).select("doc_id", F.round("score", 9).alias("score"))


@query(f"with {_BM25}, {_TRI}, {_LEX} select doc_id, round(score, 6) as score from lex order by lex.score desc, doc_id limit 50")
def lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.lexical_search(_docs(spark, sf), "doc_id", "text", QUERY, 50).select("doc_id", F.round("score", 6).alias("score"))


@query("select vec_id, list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])) * 127 + 0.5)))::tinyint) as vector from embeddings")
def vector_quantize(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.quantise(table(spark, sf, "embeddings"), "vec_id", "embedding")


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    return table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query(f"with {_VEC} select vec_id, round(score, 9) as score from vec order by vec.score desc, vec_id limit 50")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.vector_search(table(spark, sf, "embeddings"), "vec_id", "embedding", _query_vector(spark, sf), 50).select("vec_id", F.round("score", 9).alias("score"))


@query("select label, i - 1 as place, round(avg(embedding[i]::double), 9) as mean from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by all")
def vector_mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.mean_pool(table(spark, sf, "embeddings"), "label", "embedding").select("label", F.posexplode("vector").alias("place", "mean")).select("label", F.col("place").cast("bigint").alias("place"), F.round("mean", 9).alias("mean"))


@query(f"""
with {_BM25}, {_TRI}, {_LEX}, {_VEC},
  a as (select doc_id as id, row_number() over (order by score desc, doc_id) as r from lex order by score desc, doc_id limit 80),
  b as (select vec_id as id, row_number() over (order by score desc, vec_id) as r from vec order by score desc, vec_id limit 80),
  u as (select id, r, 'lexical' as s from a union all select id, r, 'vector' from b)
select id, round(sum(1.0::double / (60 + r)), 9) as score, max(case when s = 'lexical' then r end)::int as lexical, max(case when s = 'vector' then r end)::int as vector, null::int as graph
from u group by id order by sum(1.0::double / (60 + r)) desc, id limit 20
""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    n = retrieval.oversample(20)
    lists = {
        "lexical": lexical.lexical_search(_docs(spark, sf).withColumnRenamed("doc_id", "id"), "id", "text", QUERY, n),
        "vector": vectors.vector_search(table(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "embedding"), "id", "embedding", _query_vector(spark, sf), n),
    }
    return retrieval.fuse(lists, 20).withColumn("score", F.round("score", 9))


@query(r"select doc_id, ceil(1.3::double * len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{Z}\t\n\v\f\r\p{L}\p{N}]')))::int as tokens from documents where text is not null")
def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("text is not null").select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("""
with r as (select substr(sha256(doc_id::varchar), 1, 6) as k, doc_id::varchar || chr(0) || sha256(doc_id::varchar || chr(0) || coalesce(text, '')) as h from documents),
  s as (select k, sha256(string_agg(h, chr(10) order by h)) as d from r group by k),
  d as (select substr(k, 1, 3) as k, sha256(string_agg(k || d, chr(10) order by k || d)) as d from s group by substr(k, 1, 3))
select sha256(string_agg(k || d, chr(10) order by k || d)) as fingerprint from d
""")
def content_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint(_docs(spark, sf), "doc_id", "text", by="doc_id")

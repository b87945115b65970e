"""Search over all three signals: document n, vector n and page n of the derived graph are one item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import retrieval, vectors
from lorespark.plans.graphs import _NEAR, TG, graph_index
from lorespark.plans.registry import query
from lorespark.plans.retrieval import _BM25, _LEX, _TRI, _VEC, QUERY, _docs, _query_vector
from lorespark.sources.lexical_index import LexicalIndex
from lorespark.sources.shared import shared_folder, state_of, stored
from lorespark.sources.tables import table
from lorespark.sources.vector_store import scored

_SEEDED = _NEAR.replace("s0 as (select unnest(['S:5', 'P:17']) as id, 1.0::double as w)", "s0 as (select 'P:' || id as id, 1.0::double as w from a where r <= 10)")
_LISTS = f"""{_BM25}, {_TRI}, {_LEX}, {_VEC},
  a as (select doc_id as id, row_number() over (order by score desc, doc_id) as r from lex order by score desc, doc_id limit 80),
  b as (select vec_id as id, row_number() over (order by score desc, vec_id) as r from vec order by score desc, vec_id limit 80),
  {_SEEDED},
  g as (select substr(id, 3)::bigint as id, row_number() over (order by w desc, substr(id, 3)::bigint) as r from near where id like 'P:%' order by w desc, substr(id, 3)::bigint limit 80)"""


def lexical_index(spark: SparkSession, sf: str) -> LexicalIndex:
    """The stored index of the documents as they are."""
    source = f"{sf}/documents.parquet"
    index = LexicalIndex(spark, f"{shared_folder(spark)}/stored/lexical-{state_of(spark, source)}")
    if not index.manifest()["segments"]:
        index.update(_docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text"))
    return index


def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """(id, vector): the stored int8 vectors of the embeddings as they are."""
    return stored(spark, "vectors", [f"{sf}/embeddings.parquet"], lambda: vectors.quantise(table(spark, sf, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), "embedding"), "id", "embedding"))


def _signals(spark: SparkSession, sf: str, n: int) -> tuple[dict[str, DataFrame], list[str]]:
    """The ranked lists, and the seeds of the graph's. Each list is at most ``n`` rows; the seeds are ten."""
    found = lexical_index(spark, sf).scores(QUERY).select(F.col("id").cast("bigint").alias("id"), "score").orderBy(F.desc("score"), "id").limit(n)
    rows = [tuple(r) for r in found.collect()]
    words = spark.createDataFrame(rows, "id bigint, score double")
    near = scored(vector_index(spark, sf), "id", _query_vector(spark, sf)).orderBy(F.desc("score"), "id").limit(n)
    seeds = [f"P:{i}" for i, _ in rows[:10]]
    close = graph_index(spark, sf).proximity(seeds).where("id like 'P:%'").select(F.expr("cast(substring(id, 3) as bigint)").alias("id"), F.col("weight").alias("score"))
    return {"lexical": words, "vector": near, "graph": close.orderBy(F.desc("score"), "id").limit(n)}, seeds


@query("select count(*) as texts, sum(w)::bigint as words from (select coalesce(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')), 0) as w from documents)")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Writes the stored indexes of texts, vectors and edges, if they are not there, and gives the size of the first."""
    vector_index(spark, sf)
    graph_index(spark, sf)
    m = lexical_index(spark, sf).manifest()
    return spark.createDataFrame([(m["texts"], m["words"])], "texts bigint, words bigint")


@query(f"with {_BM25}, {_TRI}, {_LEX} select doc_id, round(score, 6) as score from lex order by lex.score desc, doc_id limit 50")
def index_search(spark: SparkSession, sf: str) -> DataFrame:
    found = lexical_index(spark, sf).scores(QUERY).select(F.col("id").cast("bigint").alias("doc_id"), "score")
    return found.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


@query(f"with {_BM25} select doc_id, round(score, 6) as score from bm where doc_id % 7 <> 0".replace("from documents where text", "from (select doc_id, case when doc_id % 5 = 0 then text || ' stale page' else text end as text from documents where doc_id % 7 <> 0) where text"))
def index_update(spark: SparkSession, sf: str) -> DataFrame:
    """An index of all documents after some have changed and some are gone: a second segment, and the search over both."""
    docs = _docs(spark, sf).select(F.col("doc_id").cast("string").alias("id"), "text")
    index = LexicalIndex(spark, f"{shared_folder(spark)}/stored/update-{spark._jvm.java.util.UUID.randomUUID()}")
    index.update(docs)
    left = docs.where("cast(id as bigint) % 7 <> 0")
    index.update(left.withColumn("text", F.when(F.expr("cast(id as bigint) % 5 = 0"), F.concat("text", F.lit(" stale page"))).otherwise(F.col("text"))), whole=True)
    return index.bm25(QUERY).select(F.col("id").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""{TG}, {_LISTS},
  u as (select id, r, 'lexical' as s from a union all select id, r, 'vector' from b union all select id, r, 'graph' from g)
select id, round(sum(1.0::double / (60 + r)), 9) as score, max(case when s = 'lexical' then r end)::int as lexical, max(case when s = 'vector' then r end)::int as vector, max(case when s = 'graph' then r end)::int as graph
from u group by id order by sum(1.0::double / (60 + r)) desc, id limit 20""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.fuse(_signals(spark, sf, retrieval.oversample(20))[0], 20).withColumn("score", F.round("score", 9))


@query(f"{TG}, {_LISTS} select id, round(w, 9) as weight from near where id not in (select 'P:' || id from a where r <= 10) order by w desc, id limit 40")
def ask_related(spark: SparkSession, sf: str) -> DataFrame:
    return graph_index(spark, sf).related(_signals(spark, sf, 80)[1], 40).select("id", F.round("weight", 9).alias("weight"))

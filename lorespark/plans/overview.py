"""Queries that put several analytics together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.operators import checks, ingest, overview
from lorespark.operators.pages import line_counts
from lorespark.plans import graphs as P
from lorespark.plans import ingest as PI  # noqa: F401  its SQL is used below
from lorespark.plans.pages import _pages
from lorespark.plans.registry import ORACLES, query
from lorespark.sources.shared import shared_folder
from lorespark.sources.tables import table
from lorespark.sources.wiki import Wiki


@query(f"{P.TG} select id, kind, from_id, to_id from edges where confidence = 'ambiguous'")
def ambiguous_edges(spark: SparkSession, sf: str) -> DataFrame:
    return overview.ambiguous_edges(P.graph_index(spark, sf).edges).select("id", "kind", "from_id", "to_id")


@query(f"""{P.TG}, {P._DEGREE},
  every as (
    select 'modules' as section, id as key, null::bigint as weight from nodes where kind in ('repository', 'directory', 'module')
    union all select 'entrypoints', id, null from nodes where kind = 'symbol' and regexp_matches(lower(name), '^(main|start|run|handler)$')
    union all select 'hubs', id, degree from degree where degree > 1
    union all select distinct 'cycles', a.from_id || ' > ' || a.to_id, null::bigint from edges a join edges b on a.from_id = b.to_id and a.to_id = b.from_id where a.from_id < a.to_id
    union all select 'flows', a.path || ' > ' || b.path, count(*) from edges e join nodes a on a.id = from_id join nodes b on b.id = to_id where e.kind = 'references' group by all)
select section, place::int as place, key, weight, n > 20 as truncated from (
  select *, row_number() over (partition by section order by weight desc nulls last, key) as place, count(*) over (partition by section) as n from every) where place <= 20""")
def architecture_map(spark: SparkSession, sf: str) -> DataFrame:
    loops = P.two_cycles(spark, sf).select(F.array("a", "b").alias("cycle"))
    return overview.architecture_map(P.tg_nodes(spark, sf), P.graph_index(spark, sf).edges, loops, 20, "references")


@query(f"""{P.TG}, roots as (select 'C:10' as id), {P._ADJ.format(100)},
  m as (select 'C:' || c_custkey as node_id, 'N:' || c_nationkey as community_id from customer),
  own as (select community_id, count(*) as n from m where community_id = (select community_id from m where node_id = 'C:10') group by 1)
select 'node' as part, unnest(['id', 'kind', 'path', 'name']) as key, unnest([id, kind, path, name]) as value from nodes where id = 'C:10'
union all select 'neighbour', id, name from nodes where id <> 'C:10' and id in (select from_id from adj union all select to_id from adj)
union all select 'community', community_id, n::varchar from own
union all select 'community stale', community_id, 'false' from own
union all select 'cited by', id, path from nodes where kind = 'page' and id in (select from_id from edges where to_id = 'C:10')""")
def explain_node(spark: SparkSession, sf: str) -> DataFrame:
    member = table(spark, sf, "customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("community_id"))
    return overview.explain_node(P.tg_nodes(spark, sf), P.graph_index(spark, sf).edges, "C:10", member, False)


@query("""
with f as (select workspace_id || '/' || path as path, min(content_hash) as now from graph_files group by 1),
  i as (select path, case when path like '%a.%' then 'old' else now end as old from f where path not like '%.md')
select count(*) filter (coalesce(old <> now, true)) = 0 as fresh, count(*) as files, count(*) filter (old is null) as added, 0::bigint as removed, count(*) filter (old <> now) as changed from f left join i using (path)
""")
def graph_status(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "graph_files").groupBy(F.concat_ws("/", "workspace_id", "path").alias("path")).agg(F.min("content_hash").alias("source_id"))
    indexed = files.where("path not like '%.md'").withColumn("source_id", F.when(F.col("path").like("%a.%"), "old").otherwise(F.col("source_id")))
    return overview.status(files, indexed)


_FINDINGS = {name: f"select count(*) as findings from ({ORACLES[name]}) t" for name in ("chunk_violations", "stale_chunks", "manifest_counts", "retention_check", "contains_sensitive")}


@query(" union all ".join(f"select '{name}' as \"check\", case when findings = 0 then 'pass' when '{name}' = 'retention_check' then 'warn' else 'fail' end as status, findings from ({sql}) u" for name, sql in _FINDINGS.items()))
def doctor(spark: SparkSession, sf: str) -> DataFrame:
    items, chunks = table(spark, sf, "source_items"), table(spark, sf, "chunk_refs")
    lines = line_counts(_pages(spark, sf), "page", "content").withColumnRenamed("page", "path")
    texts = ingest.leaks(table(spark, sf, "documents").where("text is not null"), "doc_id", "text").distinct().unionAll(ingest.leaks(items, "item_id", "text").distinct())
    return overview.doctor(
        {
            "chunk_violations": checks.chunk_violations(chunks),
            "stale_chunks": checks.stale_chunks(chunks.where("plane = 'wiki'"), lines),
            "manifest_counts": checks.manifest_counts(table(spark, sf, "graph_shards"), table(spark, sf, "graph_manifests")),
            "retention_check": ingest.runs(items).groupBy("source_id").agg(F.count(F.lit(1)).alias("runs")).where("runs > 3"),
            "contains_sensitive": texts,
        },
        warnings=("retention_check",),
    )


@query()
def reindex_page(spark: SparkSession, sf: str) -> DataFrame:
    """All pages indexed, then one of them written anew: what the index finds of a word that only the new text holds."""
    wiki = Wiki(spark, f"{shared_folder(spark)}/stored/wiki-{spark._jvm.java.util.UUID.randomUUID()}")
    pages = _pages(spark, sf)
    wiki.reindex(pages)
    wiki.write("zz/new-page.md", "# Written anew\n\nquokkaword stands here alone.\n")
    wiki.write("zz/new-page.md", "# Written anew\n\nquokkaword stands here again.\n")
    return wiki.index.bm25("quokkaword").select(F.lit("zz/new-page.md").alias("page"), F.round("score", 6).alias("score"))

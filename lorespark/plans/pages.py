"""Queries over pages, chunks, files, vectors and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.ids import bucket, chunk_id
from lorespark.operators import checks, pages, scan
from lorespark.operators.order import numbered
from lorespark.operators.snapshots import chain
from lorespark.plans.graphs import TG, tg_nodes
from lorespark.plans.registry import query
from lorespark.sources.tables import table

_LINES = r"string_split_regex(regexp_replace(content, '\r?\n$', ''), '\r?\n')"
_PAGES = "p as (select distinct page, content from wiki_pages where content is not null)"


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "wiki_pages").select("page", "content").distinct()


@query(f"with {_PAGES} select page, len({_LINES})::int as lines from p")
def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return pages.line_counts(_pages(spark, sf), "page", "content")


@query(rf"""
with {_PAGES}, l as (select page, unnest(range(1, len({_LINES}) + 1)) as i, unnest({_LINES}) as s from p),
  m as (select *, trim(regexp_replace(s, '[ \t\n\v\f\r]', '', 'g')) = '' as blank from l),
  f as (select *, not blank and (lag(blank, 1, true) over w or regexp_matches(s, '^#{{1,6}}[ \t\n\v\f\r]+[^ \t\n\v\f\r]')) as starts from m window w as (partition by page order by i)),
  b as (select *, sum(starts::int) over (partition by page order by i) as block from f)
select page, min(i)::int as start_line, max(i)::int as end_line, ceil(1.3::double * len(regexp_extract_all(string_agg(s, chr(10) order by i), '[\p{{L}}\p{{N}}]+|[^\p{{Z}}\t\n\v\f\r\p{{L}}\p{{N}}]')))::int as tokens from b where not blank group by page, block
""")
def chunk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return pages.blocks(_pages(spark, sf), "page", "content").drop("text")


@query()
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return pages.chunk_pages(_pages(spark, sf), "page", "content")


@query(f"{TG} select id, 'symbol ' || name || ' — ' || path as text from nodes where kind = 'symbol'")
def symbol_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return pages.symbol_chunks(tg_nodes(spark, sf))


@query(r"with t as (select doc_id, unnest(regexp_extract_all(text, '\[[^\]\n]*\]\(([^()\s]+)\)', 1)) as target from documents) select distinct doc_id, regexp_replace(target, '#.*$', '') as target from t where not regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') and regexp_replace(target, '#.*$', '') like '%.md'")
def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return pages.links(table(spark, sf, "documents"), "doc_id", "text")


@query(r"with t as (select page, unnest(regexp_extract_all(content, '\[[^\]\n]*\]\(([^()\s]+)\)', 1)) as target from wiki_pages), l as (select distinct page, regexp_replace(target, '#.*$', '') as target from t where not regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:')) select page, target from l where target like '%.md' and ltrim(regexp_extract(page, '^(.*/)?[^/]*$', 1) || regexp_replace(target, '^(\./)+', ''), '/') not in (select page from wiki_pages)")
def broken_links(spark: SparkSession, sf: str) -> DataFrame:
    return pages.broken_links(_pages(spark, sf), "page", "content")


@query("select distinct workspace_id, path, list_has_any(string_split(path, '/'), ['.git', 'node_modules', 'vendor', 'dist', 'build', 'coverage']) or regexp_matches(string_split(path, '/')[-1], '(?i)(?:^|[._-])(generated|min)\\.') or path ilike '%.map' as excluded from graph_files")
def path_exclude(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "graph_files").select("workspace_id", "path").distinct().withColumn("excluded", T.excluded(F.col("path")))


@query("select distinct workspace_id, path, path not like '/%' and not contains(path, '\\') and len(list_filter(string_split(path, '/'), lambda s: s in ('', '.', '..'))) = 0 as relative from graph_shards")
def path_relative(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "graph_shards").select("workspace_id", "path").distinct().withColumn("relative", T.is_relative(F.col("path")))


@query(
    r"with x as (select distinct workspace_id, path, lower(regexp_extract(path, '\.([A-Za-z0-9]+)$', 1)) as e from graph_files) select workspace_id, path, case "
    "when e in ('ts', 'tsx', 'mts', 'cts') then 'typescript' when e in ('js', 'jsx', 'mjs', 'cjs') then 'javascript' when e in ('py') then 'python' when e in ('go') then 'go' when e in ('rs') then 'rust' when e in ('java') then 'java' when e in ('kt', 'kts') then 'kotlin' when e in ('cs') then 'csharp' when e in ('c', 'h') then 'c' when e in ('cc', 'cpp', 'cxx', 'hpp') then 'cpp' when e in ('rb') then 'ruby' when e in ('php') then 'php' when e in ('sh', 'bash', 'zsh') then 'shell' when e in ('md', 'mdx') then 'markdown' when e in ('json') then 'json' when e in ('yaml', 'yml') then 'yaml' when e in ('toml') then 'toml'"
    " else 'text' end as detected from x"
)
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "graph_files").select("workspace_id", "path").distinct().withColumn("detected", T.language(F.col("path")))


@query("select doc_id, strlen(coalesce(text, '')) as bytes, sum(strlen(coalesce(text, ''))) over (order by doc_id)::bigint as total from documents qualify total <= 65536")
def bounded_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return checks.within_bytes(table(spark, sf, "documents").select("doc_id", "text").distinct(), "doc_id", "text", 65_536)


@query("select distinct id, sha256('chunk' || chr(0) || plane || chr(0) || path || chr(0) || start_line || chr(0) || end_line || chr(0) || content_hash) as computed, substr(content_hash, 1, 1) as bucket from chunk_refs")
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = [F.col(x) for x in ("plane", "path", "start_line", "end_line", "content_hash")]
    return table(spark, sf, "chunk_refs").select("id", chunk_id(*c).alias("computed"), bucket(F.col("content_hash")).alias("bucket")).distinct()


@query("select distinct id, path || '#L' || start_line || '-' || end_line as citation from chunk_refs")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk_refs").select("id", T.citation(F.col("path"), F.col("start_line"), F.col("end_line")).alias("citation")).distinct()


@query("""
select distinct rule, id from (
  select 'lines backward' as rule, id from chunk_refs where end_line < start_line
  union all select 'line below 1', id from chunk_refs where start_line < 1
  union all select 'id wrong', id from chunk_refs where id <> sha256('chunk' || chr(0) || plane || chr(0) || path || chr(0) || start_line || chr(0) || end_line || chr(0) || content_hash)
  union all select 'hash is no digest', id from chunk_refs where not coalesce(regexp_full_match(content_hash, '[0-9a-f]{64}'), false)
  union all select 'id is no digest', id from chunk_refs where not coalesce(regexp_full_match(id, '[0-9a-f]{64}'), false))
""")
def chunk_violations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.chunk_violations(table(spark, sf, "chunk_refs"))


@query(f"with {_PAGES}, n as (select page as path, len({_LINES}) as lines from p) select distinct id, case when lines is null then 'no page' else 'past the end' end as reason from chunk_refs left join n using (path) where plane = 'wiki' and (lines is null or end_line > lines)")
def stale_chunks(spark: SparkSession, sf: str) -> DataFrame:
    lines = pages.line_counts(_pages(spark, sf), "page", "content").withColumnRenamed("page", "path")
    return checks.stale_chunks(table(spark, sf, "chunk_refs").where("plane = 'wiki'"), lines)


@query("""
select model_id, model_revision, case when vector is null then 'missing' when len(vector) = 0 then 'empty' when dims is null then 'unknown model' when len(vector) <> dims then 'wrong length' when list_max(vector) = 0 and list_min(vector) = 0 then 'zero' else 'sound' end as state, count(*) as n
from (select distinct chunk_id, model_id, model_revision, vector from vector_store) left join (select distinct model_id, model_revision, dims from vector_manifest) using (model_id, model_revision) group by all
""")
def vector_states(spark: SparkSession, sf: str) -> DataFrame:
    return checks.vector_states(table(spark, sf, "vector_store"), table(spark, sf, "vector_manifest"))


@query("select distinct chunk_id, model_revision, bucket = substr(chunk_id, 1, 1) as by_id from vector_store where model_revision = 'r3'")
def vector_digest_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vector_store").where("model_revision = 'r3'").select("chunk_id", "model_revision", (F.col("bucket") == F.substring("chunk_id", 1, 1)).alias("by_id")).distinct()


@query(r"with f as (select store_id, generation, count(distinct regexp_replace(path, '^(\./+)+', '')) as found from graph_shards group by all) select distinct store_id, generation, file_count, coalesce(found, 0) as found from graph_manifests left join f using (store_id, generation) where coalesce(found, 0) <> file_count")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return checks.manifest_counts(table(spark, sf, "graph_shards"), table(spark, sf, "graph_manifests"))


@query("select store_id, arg_max(generation, generated_at) as generation, max(delivered_at) > arg_max(delivered_at, generated_at) as late from graph_manifests group by 1")
def latest_generations(spark: SparkSession, sf: str) -> DataFrame:
    return checks.latest_generations(table(spark, sf, "graph_manifests")).select("store_id", "generation", "late")


@query(r"""
with g as (select store_id, generation, row_number() over (partition by store_id order by min(generated_at), generation) as n from graph_manifests group by store_id, generation),
  s as (select store_id, n, regexp_replace(path, '^(\./+)+', '') as path, min(regexp_replace(lower(content_hash), '^sha256:', '')) as h from graph_shards join g using (store_id, generation) group by all)
select c.store_id, c.n::int as ord, count(*) filter (c.h = o.h) as reused, count(*) filter (coalesce(c.h <> o.h, true)) as scanned from s c left join s o on c.store_id = o.store_id and c.path = o.path and c.n = o.n + 1 group by all
""")
def incremental_reuse(spark: SparkSession, sf: str) -> DataFrame:
    return checks.reuse(table(spark, sf, "graph_shards"), chain(table(spark, sf, "graph_manifests")))


@query("select code, count(*) as n, count(*) filter (code like 'UNRESOLVED%' or code like 'AMBIGUOUS%') as unresolved from (select distinct * from graph_diagnostics) group by 1")
def diagnostic_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "graph_diagnostics").distinct()
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code").rlike("^(UNRESOLVED|AMBIGUOUS)")).alias("unresolved"))


@query("""
with o as (select distinct doc_id, text from documents), n as (select distinct doc_id, case when doc_id % 7 = 0 then text || '!' else text end as text from documents where doc_id % 11 <> 0)
select doc_id, case when n.doc_id is null then 'removed' else 'changed' end as change from o left join n using (doc_id) where n.doc_id is null or o.text is distinct from n.text
""")
def changed_paths(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "documents").select("doc_id", "text")
    new = old.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return checks.changed_rows(old, new, "doc_id", "text")


@query("select name, row_number() over (order by lower(name), name)::int as place from (select distinct p_name as name from part)")
def locale_sort(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return numbered(names, [F.lower("name"), F.col("name")]).withColumn("place", F.col("place").cast("int"))


@query()
def scan_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan_files(table(spark, sf, "graph_files"))


@query()
def build_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return scan.assemble(table(spark, sf, "graph_files"))[0]


@query()
def build_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return scan.assemble(table(spark, sf, "graph_files"))[1]


@query()
def build_graph_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return scan.assemble(table(spark, sf, "graph_files"))[2]

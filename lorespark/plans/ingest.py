"""Queries over source items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.canonical import canonical_map
from lorespark.operators import ingest
from lorespark.plans.registry import query
from lorespark.sources.shared import shared_folder
from lorespark.sources.tables import table
from lorespark.streaming.ingest import append_novel

# The expressions of the redaction, written out for the SQL.
_RULES = (
    (r"(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED]"),
    (r"(?i)\b(?:proxy-)?authorization\s*[:=]\s*(?:bearer|basic)?\s*[A-Za-z0-9._~+/=-]{8,}", "authorization: [REDACTED]"),
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED]"),
    (r"(?i)\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|private[_-]?key|secret|token)\s*[:=]\s*[\"'']?[A-Za-z0-9._~+/=-]{8,}[\"'']?", "[REDACTED]"),
    (r"(?i)\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[REDACTED]"),
    (r"\bsk-(?:proj-)?[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    (r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED]"),
    (r"(?i)\b(https?://)[^\s/@:]+:[^\s/@]+@", r"\1[REDACTED]@"),
)
_REDACT = "replace(text, chr(0), '')"
for _p, _r in _RULES:
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '{_r}', 'g')"
_JSON = "case when metadata is not null then '{' || array_to_string(list_transform(list_sort(map_keys(metadata)), lambda k: to_json(k)::varchar || ':' || coalesce(to_json(metadata[k])::varchar, 'null')), ',') || '}' end"
_CONTENT = f"sha256(coalesce(title, '') || chr(0) || coalesce(text, '') || chr(0) || coalesce(url, '') || chr(0) || coalesce(epoch_us(occurred_at)::varchar, '') || chr(0) || coalesce({_JSON}, ''))"
_RUNS = "runs as (select source_id, run_hash, max(fetched_at) as fetched_at, count(distinct item_id) as items from source_items group by all)"


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "source_items")


@query(f"select distinct item_id, {_REDACT} as text from source_items")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("item_id", T.redacted(F.col("text")).alias("text")).distinct()


@query(f"select distinct 'documents' as tbl, doc_id as id from documents where text <> {_REDACT} union all select distinct 'source_items', item_id from source_items where text <> {_REDACT}")
def contains_sensitive(spark: SparkSession, sf: str) -> DataFrame:
    docs = ingest.leaks(table(spark, sf, "documents").where("text is not null"), "doc_id", "text").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"))
    items = ingest.leaks(_items(spark, sf), "item_id", "text").select(F.lit("source_items").alias("tbl"), F.col("item_id").alias("id"))
    return docs.unionAll(items).distinct()


@query("select distinct k as key, regexp_matches(lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '(?:^|[_-])(?:authorization|api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|private[_-]?key|secret|token)(?:$|[_-])') as sensitive from (select unnest(map_keys(metadata)) as k from source_items)")
def sensitive_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select(F.explode(F.map_keys("metadata")).alias("key")).distinct().withColumn("sensitive", T.sensitive_key(F.col("key")))


@query(f"select distinct item_id, {_JSON} as json, sha256({_JSON}) as hash from source_items")
def canonical_json(spark: SparkSession, sf: str) -> DataFrame:
    return _items(spark, sf).select("item_id", canonical_map(F.col("metadata")).alias("json")).distinct().withColumn("hash", F.sha2("json", 256))


@query("""
select distinct rule, key from (
  select 'title empty' as rule, run_hash || '/' || external_id as key from source_items where title = ''
  union all select 'text missing', run_hash || '/' || external_id from source_items where text is null
  union all select 'text too long', run_hash || '/' || external_id from source_items where strlen(text) > 131072
  union all select 'fetched before it occurred', run_hash || '/' || external_id from source_items where occurred_at > fetched_at
  union all select 'too many items in a run', run_hash from (select distinct run_hash, external_id from source_items) group by run_hash having count(*) > 500
  union all select 'source of several kinds', source_id from source_items group by source_id having count(distinct kind) > 1)
""")
def envelope_validate(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.violations(_items(spark, sf))


@query(f"""
with h as (select distinct item_id, source_id, external_id, {_CONTENT} as content, fetched_at, run_hash from source_items)
select source_id, external_id, item_id from h qualify row_number() over (partition by source_id, external_id, content order by fetched_at, run_hash, item_id) = 1
""")
def ingest_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.novel_items(_items(spark, sf).withColumn("occurred_at", F.unix_micros("occurred_at"))).select("source_id", "external_id", "item_id")


@query(f"""
with h as (select distinct item_id, source_id, external_id, {_CONTENT} as content, fetched_at from source_items)
select a.item_id from h a where fetched_at >= timestamptz '2026-04-01' and not exists (select 1 from h b where b.fetched_at < timestamptz '2026-04-01' and (a.source_id, a.external_id, a.content) = (b.source_id, b.external_id, b.content))
""")
def unknown_items(spark: SparkSession, sf: str) -> DataFrame:
    items = _items(spark, sf).withColumn("occurred_at", F.unix_micros("occurred_at"))
    late = F.col("fetched_at") >= F.lit("2026-04-01 00:00:00+00:00").cast("timestamp")
    return ingest.unknown_items(items.where(late), items.where(~late)).select("item_id").distinct()


@query(f"with {_RUNS} select source_id, run_hash, items from runs qualify row_number() over (partition by source_id order by fetched_at desc, run_hash desc) <= 3")
def retention_latest(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.retained_runs(_items(spark, sf), 3).select("source_id", "run_hash", "items")


@query(f"with {_RUNS} select source_id, count(*) as runs from runs group by 1 having count(*) > 3")
def retention_check(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.runs(_items(spark, sf)).groupBy("source_id").agg(F.count(F.lit(1)).alias("runs")).where("runs > 3")


@query(f"with {_RUNS} select source_id, count(*) as runs, sum(items)::bigint as items, max((fetched_at, run_hash))[2] as run_hash from runs group by 1".replace("max((fetched_at, run_hash))[2]", "arg_max(run_hash, (fetched_at, run_hash))"))
def source_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.source_summary(_items(spark, sf)).select("source_id", "runs", "items", "run_hash")


@query("select event_type, count(*) as n, round(sum(value), 2) as total, max(json_extract_string(props, '$.k')::int) as k from events group by 1")
def event_totals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"), F.max(k).alias("k"))


@query("select event_id, user_id, event_type from events")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The events as a file stream, appended once each; running it again adds nothing."""
    root = f"{shared_folder(spark)}/stream-{spark.sql('select uuid()').first()[0]}"
    schema = table(spark, sf, "events").schema
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/event[s].parquet")
        append_novel(spark, stream, f"{root}/out", ["event_id"], f"{root}/log{_}").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "user_id", "event_type")

"""Snapshot queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.operators import snapshots
from lorespark.plans.registry import query
from lorespark.sources.tables import table

@query("""
with g as (select store_id, generation, row_number() over (partition by store_id order by t, generation) as n
           from (select store_id, generation, min(generated_at) as t from graph_manifests group by all)),
  s as (select store_id, regexp_replace(path, '^(\\./+)+', '') as path, n, min(regexp_replace(lower(content_hash), '^sha256:', '')) as h
        from graph_shards join g using (store_id, generation) group by all),
  d as (select coalesce(c.store_id, o.store_id) as store_id, coalesce(c.path, o.path) as path, coalesce(c.n, o.n + 1) as n,
               case when o.n is null then 'added' when c.n is null then 'removed' else 'changed' end as change
        from s c full join s o on c.store_id = o.store_id and c.path = o.path and c.n = o.n + 1
        where o.n is null or c.n is null or c.h is distinct from o.h)
select d.store_id, generation, path, change from d join g on g.store_id = d.store_id and g.n = d.n where d.n > 1
""")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, sf, "graph_shards"), table(spark, sf, "graph_manifests"))

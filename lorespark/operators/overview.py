"""Answers that put several analytics together: the architecture map, the explanation of a node, the state of an index, a check of everything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators import graphs
from lorespark.sources.shared import kept, release

MODULES = ("repository", "directory", "module")


def architecture_map(nodes: DataFrame, edges: DataFrame, cycles: DataFrame, limit: int, flow_kind: str = "imports") -> DataFrame:
    """(section, place, key, weight, truncated): modules, entrypoints, hubs, cycles and flows, of each at most ``limit``.

    ``cycles`` has rows (cycle array<string>). Sections are ordered by key, hubs and flows by weight first; ``truncated`` says
    whether the section has more. Every section is a top-k: no section is gathered before it is cut.
    """
    name = lambda s: F.lit(s).alias("section")
    none = F.lit(None).cast("bigint").alias("weight")
    flows = graphs.flows(nodes, edges, flow_kind)
    sections = [
        nodes.where(F.col("kind").isin(*MODULES)).select(name("modules"), F.col("id").alias("key"), none),
        graphs.entrypoints(nodes, limit + 1).select(name("entrypoints"), F.col("id").alias("key"), none),
        graphs.hubs(edges, limit + 1).select(name("hubs"), F.col("id").alias("key"), F.col("degree").alias("weight")),
        cycles.select(name("cycles"), F.array_join("cycle", " > ").alias("key"), none).distinct(),
        flows.select(name("flows"), F.concat_ws(" > ", "from_path", "to_path").alias("key"), "weight"),
    ]
    # each is cut by a top-k of its own, so the window ranks a few rows; what one shuffled is removed before the next
    first = []
    for s in sections:
        first.append(kept(s.orderBy(F.desc_nulls_last("weight"), "key").limit(limit + 1)))
        release(edges.sparkSession)
    w = Window.partitionBy("section")
    ranked = reduce(DataFrame.unionByName, first).withColumn("place", F.row_number().over(w.orderBy(F.desc_nulls_last("weight"), "key"))).withColumn("truncated", F.count(F.lit(1)).over(w) > limit)
    return ranked.where(F.col("place") <= limit).select("section", "place", "key", "weight", "truncated")


def explain_node(nodes: DataFrame, edges: DataFrame, target: str, membership: DataFrame, stale: bool, cap: int = 100) -> DataFrame:
    """(part, key, value): a node's own fields, its neighbours, its community (node_id, community_id) and the pages that cite it.

    The target is named by id, path or name, the smallest id counts; an unknown one gives no row. ``stale`` says that the
    membership belongs to an older graph.
    """
    own = graphs.exact_target(nodes, target).orderBy("id").limit(1)
    found = own.first()
    if found is None:
        return nodes.sparkSession.createDataFrame([], "part string, key string, value string")
    root = own.select("id")
    near = graphs.context(nodes, edges, root, cap).where(F.col("id") != found["id"])
    row = lambda df, part, key, value: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    mine = membership.where(F.col("node_id") == found["id"]).select("community_id").limit(1)
    size = membership.join(mine, "community_id", "left_semi").groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))
    return reduce(
        DataFrame.unionByName,
        [
            own.select(F.explode(F.create_map(*[x for c in ("id", "kind", "path", "name") for x in (F.lit(c), F.col(c))])).alias("key", "value")).select(F.lit("node").alias("part"), "key", "value"),
            row(near, "neighbour", F.col("id"), F.col("name")),
            row(size, "community", F.col("community_id"), F.col("n")),
            row(size, "community stale", F.col("community_id"), F.lit(stale)),
            row(graphs.citing_pages(nodes, edges, found["id"]), "cited by", F.col("id"), F.col("path")),
        ],
    )


def status(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """(fresh, files, added, removed, changed): whether an index (path, source_id) is that of the files (path, source_id) as they are."""
    a = indexed.select("path", F.col("source_id").alias("_a"), F.lit(True).alias("_ia")).dropDuplicates(["path"])
    b = files.select("path", F.col("source_id").alias("_b"), F.lit(True).alias("_ib")).dropDuplicates(["path"])
    both = a.join(b, "path", "full_outer")
    n = both.agg(
        F.count("_ib").alias("files"),
        F.count_if(F.col("_ia").isNull()).alias("added"),
        F.count_if(F.col("_ib").isNull()).alias("removed"),
        F.count_if(F.col("_ia") & F.col("_ib") & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
    )
    return n.select((F.col("added") + F.col("removed") + F.col("changed") == 0).alias("fresh"), "files", "added", "removed", "changed")


def doctor(checks: dict[str, DataFrame], warnings: tuple[str, ...] = ()) -> DataFrame:
    """(check, status, findings): pass for a check whose table of findings is empty, else fail, or warn for those named.

    One aggregate a check; ``all is well`` is ``bool_and(status <> 'fail')`` over the rows.
    """
    rows = [df.agg(F.count(F.lit(1)).alias("findings")).select(F.lit(name).alias("check"), F.lit("warn" if name in warnings else "fail").alias("_bad"), "findings") for name, df in checks.items()]
    each = reduce(DataFrame.unionByName, rows)
    return each.select("check", F.when(F.col("findings") == 0, "pass").otherwise(F.col("_bad")).alias("status"), "findings")


def ambiguous_edges(edges: DataFrame) -> DataFrame:
    """All edges whose label leaves their target open."""
    return edges.where("confidence = 'ambiguous'")

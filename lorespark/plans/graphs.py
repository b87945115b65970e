"""Graph queries. The tables hold no graph, so one is derived from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.ids import edge_id
from lorespark.operators import graphs as G
from lorespark.operators import iterative as I
from lorespark.plans.registry import query
from lorespark.sources.graph_index import GraphIndex
from lorespark.sources.tables import table

_ID = "sha256('edge' || chr(0) || kind || chr(0) || from_id || chr(0) || to_id || chr(0) || confidence)"
NODES_SQL = """
  nodes as (
    select 'R:' || r_regionkey as id, 'directory' as kind, 'directory/' || r_regionkey as path, r_name as name from region
    union all select 'N:' || n_nationkey, 'module', 'module/' || n_nationkey, n_name from nation
    union all select 'S:' || s_suppkey, 'symbol', 'symbol/' || s_suppkey, s_name from supplier
    union all select 'C:' || c_custkey, 'symbol', 'symbol/' || c_custkey, c_name from customer
    union all select 'P:' || p_partkey, 'page', 'page/' || p_partkey, p_name from part)"""
_RAW = """
    select 'contains' as kind, 'R:' || n_regionkey as from_id, 'N:' || n_nationkey as to_id, 'exact' as confidence from nation
    union all select 'declares', 'N:' || s_nationkey, 'S:' || s_suppkey, 'exact' from supplier
    union all select 'declares', 'N:' || c_nationkey, 'C:' || c_custkey, 'exact' from customer
    union all select 'references', 'S:' || s_suppkey, 'N:' || s_nationkey, 'heuristic' from supplier
    union all select 'references', 'C:' || c_custkey, 'N:' || c_nationkey, 'heuristic' from customer
    union all select 'calls', 'S:' || l_suppkey, 'P:' || l_partkey, case min(l_returnflag) when 'A' then 'exact' when 'N' then 'resolved' else 'heuristic' end from lineitem group by l_suppkey, l_partkey"""
_MENTIONS = """
    union all select 'mentions', 'P:' || l_partkey, 'C:' || o_custkey, case when min(o_orderstatus) = 'F' then 'inferred' else 'ambiguous' end from lineitem join orders on l_orderkey = o_orderkey group by l_partkey, o_custkey"""
EDGES_SQL = f"  edges as (select {_ID} as id, * from ({_RAW}{_MENTIONS}) t)"
TG = f"with {NODES_SQL},\n{EDGES_SQL}\n"
_SEMANTIC = "('imports','calls','inherits','implements','references','mentions','describes','grounds','related')"
_W = "case {} when 'exact' then 1.0 when 'extracted' then 1.0 when 'resolved' then 0.7 when 'inferred' then 0.7 else 0.4 end::double"
_PLANE = "case when {0} in ('repository','directory','file','module','symbol') then 'code' when {0} = 'page' then 'wiki' when {0} = 'concept' then 'concept' end"


def tg_nodes(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("region", "R", "r_regionkey", "directory", "r_name"), ("nation", "N", "n_nationkey", "module", "n_name"), ("supplier", "S", "s_suppkey", "symbol", "s_name"), ("customer", "C", "c_custkey", "symbol", "c_name"), ("part", "P", "p_partkey", "page", "p_name")]
    out = None
    for name, letter, key, kind, label in parts:
        k = F.col(key).cast("string")
        df = table(spark, sf, name).select(F.concat(F.lit(letter + ":"), k).alias("id"), F.lit(kind).alias("kind"), F.concat(F.lit(kind + "/"), k).alias("path"), F.col(label).alias("name"))
        out = df if out is None else out.unionAll(df)
    return out


GRAPH_TABLES = ("region", "nation", "supplier", "customer", "part", "lineitem", "orders")


def graph_index(spark: SparkSession, sf: str) -> GraphIndex:
    """The derived graph, built once for the files as they are and stored for lookups."""
    return GraphIndex(spark, "graph", [f"{sf}/{t}.parquet" for t in GRAPH_TABLES], lambda: _raw_edges(spark, sf))


def tg_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_edges(spark, sf).select(edge_id(F.col("kind"), F.col("from_id"), F.col("to_id"), F.col("confidence")).alias("id"), "kind", "from_id", "to_id", "confidence")


def _raw_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges without ids."""
    ref = lambda letter, key: F.concat(F.lit(letter + ":"), F.col(key).cast("string"))
    row = lambda df, kind, a, b, c: df.select(F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), (F.lit(c) if isinstance(c, str) else c).alias("confidence"))
    nation, supplier, customer = (table(spark, sf, t) for t in ("nation", "supplier", "customer"))
    items = table(spark, sf, "lineitem")
    calls = items.groupBy("l_suppkey", "l_partkey").agg(F.min("l_returnflag").alias("f"))
    out = [
        row(nation, "contains", ref("R", "n_regionkey"), ref("N", "n_nationkey"), "exact"),
        row(supplier, "declares", ref("N", "s_nationkey"), ref("S", "s_suppkey"), "exact"),
        row(customer, "declares", ref("N", "c_nationkey"), ref("C", "c_custkey"), "exact"),
        row(supplier, "references", ref("S", "s_suppkey"), ref("N", "s_nationkey"), "heuristic"),
        row(customer, "references", ref("C", "c_custkey"), ref("N", "c_nationkey"), "heuristic"),
        row(calls, "calls", ref("S", "l_suppkey"), ref("P", "l_partkey"), F.when(F.col("f") == "A", "exact").when(F.col("f") == "N", "resolved").otherwise("heuristic")),
    ]
    seen = items.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_partkey", "o_custkey").agg(F.min("o_orderstatus").alias("s"))
    out.append(row(seen, "mentions", ref("P", "l_partkey"), ref("C", "o_custkey"), F.when(F.col("s") == "F", "inferred").otherwise("ambiguous")))
    all_ = out[0]
    for df in out[1:]:
        all_ = all_.unionAll(df)
    return all_


def _ids(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


@query(f"{TG} select id, kind, path, name from nodes")
def all_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return tg_nodes(spark, sf)


@query(f"{TG} select id, kind, from_id, to_id, confidence from edges")
def edge_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tg_edges(spark, sf)


@query(f"{TG} select id, sha256('node' || chr(0) || kind || chr(0) || path || chr(0) || name || chr(0) || chr(0)) as node_id from nodes")
def node_ids(spark: SparkSession, sf: str) -> DataFrame:
    from lorespark.functions.ids import node_id

    return tg_nodes(spark, sf).select("id", node_id(F.col("kind"), F.col("path"), F.col("name")).alias("node_id"))


@query(f"{TG} select id, kind, path, name from nodes where id = 'S:7'")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return tg_nodes(spark, sf).where("id = 'S:7'")


@query(f"{TG} select kind, count(*) as n from edges where kind in {_SEMANTIC} group by 1")
def semantic_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.semantic(graph_index(spark, sf).edges).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"{TG} select {_PLANE.format('kind')} as plane, count(*) as n from nodes group by 1")
def planes(spark: SparkSession, sf: str) -> DataFrame:
    return tg_nodes(spark, sf).groupBy(G.plane(F.col("kind")).alias("plane")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{TG} select kind, confidence, {_W.format('confidence')} as weight, count(*) as n from edges group by all")
def weights(spark: SparkSession, sf: str) -> DataFrame:
    return graph_index(spark, sf).edges.groupBy("kind", "confidence", G.weight(F.col("confidence")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


_DEGREE = "degree as (select id, count(*) as degree from (select from_id as id from edges union all select to_id from edges) group by 1)"


@query(f"{TG}, {_DEGREE} select * from degree")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(graph_index(spark, sf).edges)


@query(f"{TG}, {_DEGREE} select * from degree where degree > 1 order by degree desc, id limit 100")
def hubs(spark: SparkSession, sf: str) -> DataFrame:
    return G.hubs(graph_index(spark, sf).edges)


@query(f"{TG}, {_DEGREE} select id, kind, path, name, degree from degree join nodes using (id) order by degree desc, id limit 10")
def god_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.god_nodes(tg_nodes(spark, sf), graph_index(spark, sf).edges, 10)


@query(f"{TG} select count(*) as files, (select count(*) from edges) as edges, (select count(*) from nodes where kind = 'symbol') as symbols from nodes")
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = tg_nodes(spark, sf).agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols"))
    return n.crossJoin(F.broadcast(graph_index(spark, sf).edges.agg(F.count(F.lit(1)).alias("edges")))).select("files", "edges", "symbols")


_CAND = f"""{TG}, {_DEGREE},
  c as (select id, lower(name) as n, lower(path) as p, lower(name || ' ' || path) as h from nodes),
  w as (select list_sort(list_distinct(regexp_extract_all(lower('Supplier 0001'), '[a-z0-9_]+'))) as ws),
  f as (select id, n from c, w where len(list_filter(ws, lambda x: not contains(h, x))) = 0 {{seed}})
select id, (case when n = 'supplier 0001' then 1900 else 0 end + case when starts_with(n, 'supplier 0001') then 500 else 0 end + 200 + least(coalesce(degree, 0), 50))::bigint as score
from f left join degree using (id) order by score desc, id limit 20"""


@query(_CAND.format(seed="and list_has_any(regexp_extract_all(h, '[a-z0-9_]+'), ws)"))
def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return G.ranked_candidates(tg_nodes(spark, sf), graph_index(spark, sf).edges, "Supplier 0001", 20).withColumn("score", F.col("score").cast("bigint"))


@query(_CAND.format(seed=""))
def scored_scan(spark: SparkSession, sf: str) -> DataFrame:
    return G.ranked_candidates(tg_nodes(spark, sf), graph_index(spark, sf).edges, "Supplier 0001", 20, seeded=False).withColumn("score", F.col("score").cast("bigint"))


@query(f"{TG} select id, kind, path, name from nodes where id = 'ASIA' or path = 'ASIA' or lower(name) = 'asia'")
def exact_target(spark: SparkSession, sf: str) -> DataFrame:
    return G.exact_target(tg_nodes(spark, sf), "ASIA")


_ROOTS = "roots as (select unnest(['N:3', 'S:5', 'P:17']) as id)"
_ADJ = """adj as (select distinct id, kind, from_id, to_id, confidence from (
    select e.*, row_number() over (partition by from_id order by e.id) as k from edges e where from_id in (select id from roots)
    union all select e.*, row_number() over (partition by to_id order by e.id) from edges e where to_id in (select id from roots)) where k <= {})"""


@query(f"{TG}, {_ROOTS}, {_ADJ.format(20)} select * from adj")
def adjacency_capped(spark: SparkSession, sf: str) -> DataFrame:
    return graph_index(spark, sf).adjacent(["N:3", "S:5", "P:17"], 20)


@query(f"{TG}, {_ROOTS}, {_ADJ.format(100)} select id, kind, path, name from nodes where id in (select from_id from adj union all select to_id from adj union all select id from roots)")
def context_one_hop(spark: SparkSession, sf: str) -> DataFrame:
    return graph_index(spark, sf).context(tg_nodes(spark, sf), ["N:3", "S:5", "P:17"], 100)


@query(f"{TG} select e.id from edges e where from_id in (select id from nodes where kind <> 'page') and to_id in (select id from nodes where kind <> 'page')")
def contained_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.contained(graph_index(spark, sf).edges, tg_nodes(spark, sf).where("kind <> 'page'")).select("id")


def _impact_sql(step: str, depth: int, root: str, graph: str = TG) -> str:
    return f"{graph}, step as ({step}), r(id, d) as (select '{root}', 0 union select b, d + 1 from r join step on a = r.id where d < {depth}) select id, min(d)::int as depth from r group by 1".replace("with ", "with recursive ", 1)


_OUT, _IN = "select from_id as a, to_id as b from edges", "select to_id as a, from_id as b from edges"


@query(_impact_sql(_IN, 3, "P:17"))
def impact_inbound(spark: SparkSession, sf: str) -> DataFrame:
    return G.impact(graph_index(spark, sf).edges, _ids(spark, "P:17"), "inbound", 3, via=False).select("id", "depth")


@query(_impact_sql(_OUT, 3, "N:3"))
def impact_outbound(spark: SparkSession, sf: str) -> DataFrame:
    return G.impact(graph_index(spark, sf).edges, _ids(spark, "N:3"), "outbound", 3, via=False).select("id", "depth")


@query(_impact_sql(f"{_OUT} union all {_IN}", 2, "S:5"))
def impact_both(spark: SparkSession, sf: str) -> DataFrame:
    return G.impact(graph_index(spark, sf).edges, _ids(spark, "S:5"), "both", 2, via=False).select("id", "depth")


@query(f"{TG} select id from nodes where path in ('symbol/5', 'page/17', 'module/3') order by id limit 50")
def path_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return G.at_paths(tg_nodes(spark, sf), spark.createDataFrame([("symbol/5",), ("page/17",), ("module/3",), ("no/such",)], "path string"), 50)


@query(f"{TG}, step as ({_IN}), r(id, d) as (select id, 0 from nodes where path in ('symbol/5', 'page/17') union select b, d + 1 from r join step on a = r.id where d < 5) select id, min(d)::int as depth from r group by 1".replace("with ", "with recursive ", 1))
def change_impact(spark: SparkSession, sf: str) -> DataFrame:
    seeds = G.at_paths(tg_nodes(spark, sf), spark.createDataFrame([("symbol/5",), ("page/17",)], "path string"), 50)
    return G.impact(graph_index(spark, sf).edges, seeds, "inbound", 5, via=False).select("id", "depth")


_HOP = """{out} as (select other as id, max(w) as w from (
    select to_id as other, f.w * {weight} as w from (select *, row_number() over (partition by from_id order by id) as k from edges) e join {front} f on f.id = e.from_id where k <= 100
    union all select from_id, f.w * {weight} from (select *, row_number() over (partition by to_id order by id) as k from edges) e join {front} f on f.id = e.to_id where k <= 100) group by 1)"""
_NEAR = f"""s0 as (select unnest(['S:5', 'P:17']) as id, 1.0::double as w), {_HOP.format(out='s1', front='s0', weight=_W.format('confidence'))}, {_HOP.format(out='s2', front='s1', weight=_W.format('confidence'))},
  near as (select id, max(w) as w from (select * from s0 union all select * from s1 union all select * from s2) group by 1)"""


@query(f"{TG}, {_NEAR} select id, round(w, 9) as weight from near")
def graph_signal(spark: SparkSession, sf: str) -> DataFrame:
    return graph_index(spark, sf).proximity(["S:5", "P:17"]).select("id", F.round("weight", 9).alias("weight"))


@query(f"{TG}, {_NEAR} select id, round(w, 9) as weight from near where id not in ('S:5', 'P:17') order by w desc, id limit 40")
def related_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph_index(spark, sf).related(["S:5", "P:17"], 40).select("id", F.round("weight", 9).alias("weight"))


@query(f"{TG} select a.path as from_path, b.path as to_path, count(*) as weight from edges e join nodes a on a.id = from_id join nodes b on b.id = to_id where e.kind = 'references' group by all")
def import_flows(spark: SparkSession, sf: str) -> DataFrame:
    return G.flows(tg_nodes(spark, sf), graph_index(spark, sf).edges, "references")


@query(f"""{TG} select e.id, {_PLANE.format('a.kind')} as from_plane, {_PLANE.format('b.kind')} as to_plane, confidence from edges e join nodes a on a.id = from_id join nodes b on b.id = to_id
where e.kind not in ('member-of', 'contains') and {_PLANE.format('a.kind')} <> {_PLANE.format('b.kind')} order by {_W.format('confidence')} desc, e.id limit 100""")
def surprising_connections(spark: SparkSession, sf: str) -> DataFrame:
    return G.surprising(tg_nodes(spark, sf), graph_index(spark, sf).edges, 100)


@query(f"{TG} select count(*) as total, count(*) filter (id in (select to_id from edges where kind in ('describes', 'mentions'))) as described, round(count(*) filter (id in (select to_id from edges where kind in ('describes', 'mentions'))) / count(*), 9) as ratio from nodes where kind <> 'page'")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return G.coverage(tg_nodes(spark, sf), graph_index(spark, sf).edges).withColumn("ratio", F.round("ratio", 9))


@query(f"{TG} select id, kind, path, name from nodes where kind = 'page' and id in (select from_id from edges where to_id = 'C:10')")
def citing_pages(spark: SparkSession, sf: str) -> DataFrame:
    return G.citing_pages(tg_nodes(spark, sf), graph_index(spark, sf).edges, "C:10")


_HALF = "substr(id, 1, 1) < '8'"


@query(f"{TG} select id, kind, confidence from edges where from_id in (select id from nodes where kind <> 'directory') and to_id in (select id from nodes where kind <> 'directory')")
def merge_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = tg_nodes(spark, sf).where("kind <> 'directory'"), graph_index(spark, sf).edges
    pages = F.col("kind") == "page"
    return G.merge(nodes.where(~pages), edges.where(_HALF), nodes.where(pages), edges.where(f"not {_HALF} or substr(id, 2, 1) = '0'"), hashed=True)[1].select("id", "kind", "confidence")


@query(f"{TG} select distinct e.id, x as missing from (select id, unnest([from_id, to_id]) as x from edges) e where x not in (select id from nodes where kind <> 'module')")
def dangling_refs(spark: SparkSession, sf: str) -> DataFrame:
    return G.dangling(graph_index(spark, sf).edges, tg_nodes(spark, sf).where("kind <> 'module'"))


@query(f"{TG} select distinct 'page without edge' as rule, id as key from nodes where kind = 'page' and id not in (select from_id from edges where kind = 'mentions')")
def page_checks(spark: SparkSession, sf: str) -> DataFrame:
    from lorespark.operators.pages import page_violations

    return page_violations(tg_nodes(spark, sf), graph_index(spark, sf).edges)


_FAULTY = """, bad as (select id, kind, from_id, to_id, case when substr(id, 1, 2) = '00' then 'extracted' else confidence end as confidence from edges union all select id, kind, from_id, to_id, confidence from edges where substr(id, 1, 2) = '01')"""


@query(f"""{TG}{_FAULTY} select distinct rule, key from (
  select 'edge id repeated' as rule, id as key from bad group by id having count(*) > 1
  union all select 'edge label illegal', id from bad where confidence = 'extracted' and kind not in ('mentions')
  union all select 'edge id wrong', id from bad where id <> {_ID}
  union all select 'node id wrong', id from nodes where id <> sha256('node' || chr(0) || kind || chr(0) || path || chr(0) || name || chr(0) || chr(0)))""")
def graph_violations(spark: SparkSession, sf: str) -> DataFrame:
    e = graph_index(spark, sf).edges  # read once for each rule
    bad = e.withColumn("confidence", F.when(F.col("id").startswith("00"), "extracted").otherwise(F.col("confidence"))).unionByName(e.where("id like '01%'"))
    return G.violations(tg_nodes(spark, sf), bad)


@query(f"{TG} select sha256('edge' || chr(0) || 'member-of' || chr(0) || 'C:' || c_custkey || chr(0) || 'N:' || c_nationkey || chr(0) || 'exact') as id, 'C:' || c_custkey as from_id, 'N:' || c_nationkey as to_id from customer")
def member_of(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    m = c.select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("community_id"))
    return G.member_edges(m).select("id", "from_id", "to_id")


@query(f"""{TG}, m as (select 'C:' || c_custkey as node_id, 'N:' || c_nationkey as community_id from customer),
  t as (select community_id, term, count(*) as n from (select community_id, unnest(regexp_extract_all(lower(name || ' ' || path), '[a-z0-9_]+')) as term from m join nodes on id = node_id) group by all),
  r as (select community_id, string_agg(term, ' ' order by n desc, term) as top_terms from (select *, row_number() over (partition by community_id order by n desc, term) as k from t) where k <= 5 group by 1),
  f as (select community_id, string_agg(node_id, ' ' order by node_id) as first_members from (select *, row_number() over (partition by community_id order by node_id) as k from m) where k <= 200 group by 1)
select community_id, count(*) as members, first_members, count(*) > 200 as truncated, top_terms from m join f using (community_id) join r using (community_id) group by all""")
def community_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "customer").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("node_id"), F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("community_id"))
    return G.community_summary(tg_nodes(spark, sf), m).withColumns({c: F.array_join(c, " ") for c in ("first_members", "top_terms")})


@query()
def suggested_questions(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = tg_nodes(spark, sf), graph_index(spark, sf).edges
    m = I.communities(nodes, edges, hashed=True)
    return G.questions(G.god_nodes(nodes, edges, 3), G.community_summary(nodes, m))


@query()
def communities(spark: SparkSession, sf: str) -> DataFrame:
    return I.communities(tg_nodes(spark, sf), graph_index(spark, sf).edges, hashed=True)


_BOTH = f"s as materialized (select id, from_id as a, to_id as b, 1 / {_W.format('confidence')} as c from edges where kind in {_SEMANTIC} union all select id, to_id, from_id, 1 / {_W.format('confidence')} from edges where kind in {_SEMANTIC})"


@query(f"""{TG}, {_BOTH}, r(id, component) using key (id) as (select id, id from nodes
  union select s.b, min(r.component) from r join s on s.a = r.id join recurring.r as o on o.id = s.b where r.component < o.component group by s.b)
select id, component from r""".replace("with ", "with recursive ", 1))
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return I.components(tg_nodes(spark, sf), G.semantic(graph_index(spark, sf).edges))


_DIST = f"""{TG}, {_BOTH}, r(node, d) using key (node) as (select 'S:5', 0.0::double
  union select s.b, min(round(r.d + s.c, 9)) from r join s on s.a = r.node left join recurring.r as o on o.node = s.b where o.node is null or round(r.d + s.c, 9) < o.d group by s.b)""".replace("with ", "with recursive ", 1)


@query(f"{_DIST} select node, d from r")
def path_distances(spark: SparkSession, sf: str) -> DataFrame:
    return I.distances(graph_index(spark, sf).edges, "S:5")


@query(f"""{_DIST}, back as (select s.b as node, min(s.id) as edge, arg_min(s.a, s.id) as prev from s join r x on x.node = s.a join r y on y.node = s.b where round(x.d + s.c, 9) = y.d group by s.b),
  way(k, node) as (select 0, 'C:10' from r where node = 'C:10' union all select k + 1, prev from way join back using (node) where node <> 'S:5')
select ((select max(k) from way) - k)::int as step, node as node_id, case when node <> 'S:5' then edge end as edge_id, (select d from r where node = 'C:10') as total from way left join back using (node)""")
def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    return I.shortest_path(graph_index(spark, sf).edges, "S:5", "C:10")


@query(f"{TG} select least(a.from_id, a.to_id) as a, greatest(a.from_id, a.to_id) as b from edges a join edges b on a.from_id = b.to_id and a.to_id = b.from_id where a.from_id < a.to_id group by all")
def two_cycles(spark: SparkSession, sf: str) -> DataFrame:
    return G.two_cycles(graph_index(spark, sf).edges)


@query()
def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return I.cycles(graph_index(spark, sf).edges)


@query(f"{TG} select id, name from nodes where kind = 'symbol' and regexp_matches(lower(name), '^(main|start|run|handler)$') order by id limit 100")
def entrypoints(spark: SparkSession, sf: str) -> DataFrame:
    return G.entrypoints(tg_nodes(spark, sf)).select("id", "name")

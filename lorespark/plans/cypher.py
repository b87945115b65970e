"""Cypher queries over the derived graph, each with hand-written SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorespark.cypher.compiler import cypher
from lorespark.plans.graphs import TG, graph_index, tg_nodes
from lorespark.plans.registry import ORACLES, QUERIES

_CASES: dict[str, tuple[str, dict, str]] = {
    "cypher_scan": ("MATCH (n:Node) RETURN n.id AS id, n.kind AS kind, n.scope AS scope", {}, "select id, kind, '' as scope from nodes"),
    "cypher_filter": ("MATCH (n:Node) WHERE n.kind = 'page' AND n.name CONTAINS $part RETURN n.id AS id", {"part": "a"}, "select id from nodes where kind = 'page' and contains(name, 'a')"),
    "cypher_lookup": ("MATCH (n:Node {id: $id}) RETURN n.name AS name", {"id": "N:3"}, "select name from nodes where id = 'N:3'"),
    "cypher_one_hop": ("MATCH (a:Node {id: $id})-[e:Edge]->(b:Node) RETURN b.id AS id, e.kind AS kind, e.confidence AS label", {"id": "S:5"}, "select to_id as id, kind, confidence as label from edges where from_id = 'S:5'"),
    "cypher_inbound": ("MATCH (a:Node {id: 'N:3'})<-[e:Edge]-(b:Node) WHERE b.kind <> 'page' RETURN b.id AS id", {}, "select b.id from edges join nodes b on b.id = from_id where to_id = 'N:3' and b.kind <> 'page'"),
    "cypher_two_hops": ("MATCH (a:Node {id: 'R:1'})-[:Edge]->(b:Node)-[e:Edge {kind: 'declares'}]->(c:Node) RETURN b.name AS nation, count(c) AS n", {}, "select b.name as nation, count(*) as n from edges x join nodes b on b.id = x.to_id join edges e on e.from_id = b.id where x.from_id = 'R:1' and e.kind = 'declares' group by 1"),
    "cypher_optional": ("MATCH (n:Node) WHERE n.kind = 'directory' OPTIONAL MATCH (n)<-[e:Edge]-(m:Node) RETURN n.id AS id, count(m) AS n", {}, "select n.id, count(e.id) as n from nodes n left join edges e on e.to_id = n.id where n.kind = 'directory' group by 1"),
    "cypher_count": ("MATCH (a:Node)-[e:Edge]->(b:Node) RETURN e.kind AS kind, count(e) AS n, count(DISTINCT a.id) AS sources", {}, "select kind, count(*) as n, count(distinct from_id) as sources from edges group by 1"),
    "cypher_unwind": ("UNWIND $ids AS i MATCH (n:Node) WHERE n.id = i RETURN i AS id, n.kind AS kind", {"ids": ["S:5", "N:3", "none"]}, "select id, kind from nodes where id in ('S:5', 'N:3')"),
    "cypher_with": ("MATCH (a:Node)-[e:Edge]->(b:Node) WITH a.id AS id, count(e) AS n WHERE n > 40 RETURN id, n ORDER BY n DESC, id LIMIT 30", {}, "select from_id as id, count(*) as n from edges group by 1 having count(*) > 40 order by n desc, id limit 30"),
    "cypher_cross": ("MATCH (a:Node), (b:Node) WHERE a.kind = 'directory' AND b.kind = 'directory' RETURN a.id AS a, b.id AS b", {}, "select a.id as a, b.id as b from nodes a, nodes b where a.kind = 'directory' and b.kind = 'directory'"),
    "cypher_undirected": ("MATCH (a:Node {id: 'S:5'})-[e:Edge]-(b:Node) RETURN b.id AS id, e.kind AS kind", {}, "select case when from_id = 'S:5' then to_id else from_id end as id, kind from edges where 'S:5' in (from_id, to_id)"),
    "cypher_union": ("MATCH (n:Node) WHERE n.kind = 'directory' RETURN n.id AS id UNION MATCH (n:Node)<-[:Edge]-(m:Node {kind: 'directory'}) RETURN n.id AS id", {}, "select id from nodes where kind = 'directory' union select e.to_id from edges e join nodes m on m.id = e.from_id where m.kind = 'directory'"),
    "cypher_distinct": ("MATCH (n:Node) RETURN DISTINCT n.kind AS kind ORDER BY kind SKIP 1 LIMIT 3", {}, "select distinct kind from nodes order by kind limit 3 offset 1"),
}


def _add(name: str, text: str, params: dict, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return cypher(tg_nodes(spark, sf), graph_index(spark, sf).edges, text, params)

    run.__name__ = name
    QUERIES[name], ORACLES[name] = run, TG + sql


for _name, _case in _CASES.items():
    _add(_name, *_case)

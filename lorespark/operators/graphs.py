"""The property graph: model, neighbourhood, ranking, traversal and analytics.

``nodes``: id, kind, path, name and optionally scope. ``edges``: id, kind, from_id, to_id, confidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.ids import edge_id, node_id
from lorespark.functions.text import ascii_words
from lorespark.sources.shared import kept, release

# The kinds, planes and labels of the model.
CODE_KINDS = ("repository", "directory", "file", "module", "symbol")
WIKI_KINDS, CONCEPT_KINDS, SOURCE_KINDS = ("page",), ("concept",), ("source",)
SEMANTIC = ("imports", "calls", "inherits", "implements", "references", "mentions", "describes", "grounds", "related")
SCANNER_EDGES = ("contains", "declares", "exports", "imports", "calls", "inherits", "implements", "references")
AGENT_EDGES = ("mentions", "describes", "grounds", "related")
SENT = 100_000  # ids that are sent to all workers; more are joined by a shuffle
WEIGHTS = {"exact": 1.0, "extracted": 1.0, "resolved": 0.7, "inferred": 0.7, "heuristic": 0.4, "ambiguous": 0.4}


def plane(kind: Column) -> Column:
    return F.when(kind.isin(*CODE_KINDS), "code").when(kind.isin(*CONCEPT_KINDS), "concept").when(kind.isin(*WIKI_KINDS), "wiki").when(kind.isin(*SOURCE_KINDS), "source")


def weight(confidence: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[confidence]


def legal(kind: Column, confidence: Column) -> Column:
    """Whether a label is one of its edge family's."""
    return (
        F.when(kind.isin(*SCANNER_EDGES), confidence.isin("exact", "resolved", "heuristic"))
        .when(kind.isin(*AGENT_EDGES), confidence.isin("extracted", "inferred", "ambiguous"))
        .when(kind == "member-of", confidence == "exact")
        .otherwise(False)
    )


def semantic(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("kind").isin(*SEMANTIC))


def contained(edges: DataFrame, nodes: DataFrame, without: tuple[DataFrame, int] | None = None) -> DataFrame:
    """Edges with both ends among the nodes; ``without`` is what ``_missing`` gave, where that is known."""
    missing, n = without or _missing(edges, nodes)
    out = edges.where("from_id is not null and to_id is not null")
    for end in ("from_id", "to_id") if n else ():
        own = missing.withColumnRenamed("id", end)
        out = out.join(F.broadcast(own) if n <= SENT else own, end, "left_anti")
    return out.select(*edges.columns)


def dangling(edges: DataFrame, nodes: DataFrame, without: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(id, missing): ends of edges that are no node, a null end among them."""
    missing, n = without or _missing(edges, nodes)
    own = missing.select(F.col("id").alias("missing"))
    own = F.broadcast(own) if n <= SENT else own
    ends = edges.select("id", F.explode(F.array("from_id", "to_id")).alias("_end"))
    return ends.join(own, F.col("_end").eqNullSafe(F.col("missing"))).select("id", "missing").distinct()


def _missing(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, int]:
    """(id) of the ends that are no node, and their number. Only distinct ends are shuffled; the edges themselves stay where they are."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    missing = kept(ends.join(nodes.select("id"), "id", "left_anti"))
    n = missing.count()
    release(edges.sparkSession)
    return missing, n


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, key): what breaks the model. A sound graph has no row."""
    twice = lambda df, rule: df.groupBy("id").count().where("count > 1").select(F.lit(rule).alias("rule"), F.col("id").alias("key"))
    rules = [
        twice(nodes, "node id repeated"),
        twice(edges, "edge id repeated"),
        nodes.where(plane(F.col("kind")).isNull()).select(F.lit("node kind unknown").alias("rule"), F.col("id").alias("key")),
        edges.where(~F.coalesce(legal(F.col("kind"), F.col("confidence")), F.lit(False))).select(F.lit("edge label illegal").alias("rule"), F.col("id").alias("key")),
        edges.where(F.col("id") != edge_id(F.col("kind"), F.col("from_id"), F.col("to_id"), F.col("confidence"))).select(F.lit("edge id wrong").alias("rule"), F.col("id").alias("key")),
        nodes.where(F.col("id") != node_id(F.col("kind"), F.col("path"), F.col("name"))).select(F.lit("node id wrong").alias("rule"), F.col("id").alias("key")),
        dangling(edges, nodes).select(F.lit("edge end missing").alias("rule"), F.col("id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, rules).distinct()


# Degree


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): ends of edges at each node; a loop counts twice. Combined before the shuffle, so hubs are no hot keys."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, limit: int = 100) -> DataFrame:
    return degrees(edges).where("degree > 1").orderBy(F.desc("degree"), "id").limit(limit)


def god_nodes(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(id, kind, path, name, degree) of the nodes with most edges of any kind."""
    top = degrees(edges).join(nodes, "id", "left_semi").orderBy(F.desc("degree"), "id").limit(limit)
    return nodes.join(top, "id").select("id", "kind", "path", "name", "degree")


# Neighbourhood


def adjacent(edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """Edges at the roots (id): of each root the first ``limit`` inbound and outbound ones in the order of edge ids, each once."""
    both = [edges.join(roots.select(F.col("id").alias(end)), end, "left_semi").withColumn("_root", F.col(end)).withColumn("_side", F.lit(end)) for end in ("from_id", "to_id")]
    w = Window.partitionBy("_root", "_side").orderBy("id")
    ranked = both[0].unionByName(both[1]).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit)
    return ranked.select("id", "kind", "from_id", "to_id", "confidence").distinct()


def context(nodes: DataFrame, edges: DataFrame, roots: DataFrame, limit: int) -> DataFrame:
    """The roots and the other ends of their edges, one step away."""
    near = adjacent(edges, roots, limit).select(F.explode(F.array("from_id", "to_id")).alias("id")).union(roots.select("id")).distinct()
    return nodes.join(near, "id", "left_semi")


def at_paths(nodes: DataFrame, paths: DataFrame, limit: int) -> DataFrame:
    """(id) of the nodes at changed paths (path), the first in the order of ids."""
    return nodes.join(paths.select("path").distinct(), "path", "left_semi").select("id").orderBy("id").limit(limit)


# Lookup


def exact_target(nodes: DataFrame, target: str) -> DataFrame:
    """Nodes that a text names: by id, path, name or scope and name, the last two in any case."""
    t = F.lower(F.lit(target))
    scoped = F.concat(F.coalesce("scope", F.lit("")), F.lit("."), F.col("name")) if "scope" in nodes.columns else F.concat(F.lit("."), F.col("name"))
    return nodes.where((F.col("id") == target) | (F.col("path") == target) | (F.lower("name") == t) | (F.lower(scoped) == t))


def ranked_candidates(nodes: DataFrame, edges: DataFrame, query: str, limit: int, seeded: bool = True) -> DataFrame:
    """(id, score) of nodes that hold every word of the query in name, path or scope.

    With ``seeded`` at least one node in all must have a word of the query as a whole word, and only nodes that have one
    count; without, any substring does. The score adds 1000 for a name or path that is the query, 900 for a qualified name
    that is, 500 for one that begins with it, 100 for every word and up to 50 for edges. Degrees are only counted for the
    nodes that match.
    """
    q = query.strip().lower()
    words = nodes.sparkSession.range(1).select(ascii_words(F.lit(query))).first()[0]
    if not words:
        raise ValueError("an empty query")
    name, path = F.lower("name"), F.lower("path")
    scope = F.coalesce("scope", F.lit("")) if "scope" in nodes.columns else F.lit("")
    full = F.regexp_replace(F.concat(F.lower(scope), F.lit("."), name), r"^\.", "")
    hay = F.concat_ws("\n", name, path, full)
    found = nodes
    if seeded:
        found = found.where(F.arrays_overlap(ascii_words(F.concat_ws(" ", "name", "path")), F.array(*map(F.lit, words))))
    for w in words:
        found = found.where(F.instr(hay, w) > 0)
    one = lambda test, n: F.when(test, n).otherwise(0)
    bonus = one((name == q) | (path == q), 1000) + one(full == q, 900) + one(F.startswith(full, F.lit(q)), 500)
    found = found.select("id", bonus.alias("_b"))
    degree = degrees(edges.join(found.select(F.col("id").alias("from_id")), "from_id", "left_semi").unionByName(edges.join(found.select(F.col("id").alias("to_id")), "to_id", "left_semi")).distinct())
    score = F.col("_b") + 100 * len(words) + F.least(F.coalesce("degree", F.lit(0)), F.lit(50))
    return found.join(degree, "id", "left").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)


# Traversal


def impact(edges: DataFrame, roots: DataFrame, direction: str, depth: int, via: bool = True) -> DataFrame:
    """(id, depth, via): nodes within ``depth`` (1 to 5) steps of the roots, breadth first.

    ``direction`` is inbound, outbound or both; ``via`` is the first edge, by node it comes from and edge id, on a shortest
    way, left out where it is not wanted: edge ids are most of an edge's bytes. One join and one anti-join a level; levels are
    written to the shared folder, so the plan stays flat, and what a level shuffled is removed before the next.
    """
    if not 1 <= depth <= 5:
        raise ValueError("depth must be 1 to 5")
    steps = {
        "outbound": [edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), F.col("id").alias("via"))],
        "inbound": [edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), F.col("id").alias("via"))],
    }
    steps["both"] = steps["outbound"] + steps["inbound"]
    step = reduce(DataFrame.union, steps[direction])
    none = [F.lit(None).cast("string").alias("via")] if via else []
    seen = roots.select("id").distinct().select("id", F.lit(0).alias("depth"), *none)
    front, levels = seen, [seen]
    for d in range(1, depth + 1):
        n = front.count()
        if not n:
            break
        here = front.select(F.col("id").alias("a"))
        on = step.join(F.broadcast(here) if n <= SENT else here, "a")
        reached = on.groupBy("b").agg(F.min(F.struct("a", "via")).alias("m")) if via else on.select("b").distinct()
        past = reduce(DataFrame.union, levels).select(F.col("id").alias("b"))
        front = kept(reached.join(past, "b", "left_anti").select(F.col("b").alias("id"), F.lit(d).alias("depth"), *([F.col("m.via").alias("via")] if via else [])))
        levels.append(front)
        if n > SENT:
            release(edges.sparkSession)
    return reduce(DataFrame.union, levels)


def proximity(edges: DataFrame, seeds: DataFrame, cap: int = 100) -> DataFrame:
    """(id, weight, confidence): the greatest product of edge weights on a way of at most two steps from the seeds (id).

    Seeds have weight 1 and the label exact. Of each node only the first ``cap`` edges per side are walked, by edge id.
    """

    def spread(front: DataFrame) -> DataFrame:
        near = adjacent_with_root(edges, front, cap)
        w = F.col("weight") * weight(F.col("edge_confidence"))
        return near.join(front.select(F.col("id").alias("root"), "weight"), "root").groupBy(F.col("other").alias("id")).agg(F.max(F.struct(w.alias("weight"), F.col("edge_confidence").alias("confidence"))).alias("m")).select("id", "m.weight", "m.confidence")

    start = seeds.select("id").distinct().select("id", F.lit(1.0).alias("weight"), F.lit("exact").alias("confidence"))
    one = spread(start)
    two = spread(one)
    best = start.union(one).union(two).groupBy("id").agg(F.max(F.struct("weight", "confidence")).alias("m"))
    return best.select("id", "m.weight", "m.confidence")


def adjacent_with_root(edges: DataFrame, roots: DataFrame, cap: int) -> DataFrame:
    """(root, other, edge, edge_confidence), capped as in ``adjacent``."""
    sides = []
    for here, there in (("from_id", "to_id"), ("to_id", "from_id")):
        own = edges.join(roots.select(F.col("id").alias(here)), here, "left_semi").select(F.col(here).alias("root"), F.col(there).alias("other"), F.col("id").alias("edge"), F.col("confidence").alias("edge_confidence"))
        w = Window.partitionBy("root").orderBy("edge")
        sides.append(own.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cap).drop("_k"))
    return sides[0].union(sides[1])


def related(edges: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """What is near the seeds but none of them, the nearest first."""
    return proximity(edges, seeds).join(seeds.select("id"), "id", "left_anti").orderBy(F.desc("weight"), "id").limit(limit)


# Analytics


def flows(nodes: DataFrame, edges: DataFrame, kind: str = "imports") -> DataFrame:
    """(from_path, to_path, weight): edges of a kind between the paths of their ends, combined before the shuffle."""
    a, b = (nodes.select(F.col("id").alias(f"{s}_id"), F.col("path").alias(f"{s}_path")) for s in ("from", "to"))
    return edges.where(F.col("kind") == kind).join(a, "from_id").join(b, "to_id").groupBy("from_path", "to_path").agg(F.count(F.lit(1)).alias("weight"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """(a, b) with a < b: nodes with edges both ways.

    Edges down are first reduced to those between ends of edges up, where these are few enough to be sent; then each pair is shuffled once.
    """
    up = edges.where("from_id < to_id").select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    down = edges.where("from_id > to_id").select(F.col("to_id").alias("a"), F.col("from_id").alias("b"))
    for end in ("a", "b"):
        some = kept(up.select(end).distinct())
        if some.count() <= SENT:
            down = down.join(F.broadcast(some), end, "left_semi").select("a", "b")
        release(edges.sparkSession)
    both = up.withColumn("_down", F.lit(False)).unionAll(down.withColumn("_down", F.lit(True)))
    return both.groupBy("a", "b").agg(F.min("_down").alias("_one"), F.max("_down").alias("_other")).where("not _one and _other").select("a", "b")


def surprising(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """(id, from_plane, to_plane, confidence): edges across planes, concept and code first, then the most certain."""
    a, b = (nodes.select(F.col("id").alias(f"{s}_id"), plane(F.col("kind")).alias(f"{s}_plane")) for s in ("from", "to"))
    crossing = edges.where(~F.col("kind").isin("member-of", "contains")).join(a, "from_id").join(b, "to_id").where("from_plane <> to_plane")
    pair = F.array_sort(F.array("from_plane", "to_plane")) == F.array(F.lit("code"), F.lit("concept"))
    return crossing.orderBy(F.when(pair, 0).otherwise(1), F.desc(weight(F.col("confidence"))), "id").limit(limit).select("id", "from_plane", "to_plane", "confidence")


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(total, described, ratio) of code nodes that a page or concept describes or mentions; 0 for an empty graph."""
    code = nodes.where(plane(F.col("kind")) == "code").select("id")
    targets = edges.where(F.col("kind").isin("describes", "mentions")).select(F.col("to_id").alias("id")).distinct()
    hit = code.join(targets.withColumn("_d", F.lit(1)), "id", "left")
    n = hit.agg(F.count(F.lit(1)).alias("total"), F.count("_d").alias("described"))
    return n.select("total", "described", F.coalesce(F.try_divide(F.col("described"), F.col("total")), F.lit(0.0)).alias("ratio"))


def citing_pages(nodes: DataFrame, edges: DataFrame, target: str) -> DataFrame:
    """Pages with an edge to a node."""
    return nodes.where("kind = 'page'").join(edges.where(F.col("to_id") == target).select(F.col("from_id").alias("id")), "id", "left_semi")


def merge(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, hashed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph with new nodes and edges put over old ones of the same id, and the edges (id, missing) that had no end.

    ``hashed`` says that edge ids are hashes of the other columns, so edges of one id are equal: then they are told apart by
    those columns, and no id is shuffled.
    """

    def over(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new.dropDuplicates(["id"]))

    all_nodes = over(nodes, new_nodes)
    if not hashed:
        all_edges = over(edges, new_edges)
        without = _missing(all_edges, all_nodes)
        return all_nodes, contained(all_edges, all_nodes, without), dangling(all_edges, all_nodes, without)
    parts = ["kind", "from_id", "to_id", "confidence"]
    both = edges.unionByName(new_edges)
    without = _missing(both, all_nodes)
    inside = contained(both, all_nodes, without).select(*parts).distinct()
    return all_nodes, inside.select(edge_id(*map(F.col, parts)).alias("id"), *parts), dangling(both, all_nodes, without)


def member_edges(membership: DataFrame) -> DataFrame:
    """Edges from nodes to the leaders of their communities (node_id, community_id)."""
    kind, label = F.lit("member-of"), F.lit("exact")
    return membership.select(edge_id(kind, F.col("node_id"), F.col("community_id"), label).alias("id"), kind.alias("kind"), F.col("node_id").alias("from_id"), F.col("community_id").alias("to_id"), label.alias("confidence"))


def community_summary(nodes: DataFrame, membership: DataFrame, most: int = 200, terms: int = 5) -> DataFrame:
    """(community_id, members, first_members, truncated, top_terms).

    Members are numbered by a window on (community, part of 64) first, so one large community is not one task's sort.
    """
    own = membership.join(nodes.select(F.col("id").alias("node_id"), "name", "path"), "node_id", "left")
    size = own.groupBy("community_id").agg(F.count(F.lit(1)).alias("members"))
    part = Window.partitionBy("community_id", "_part").orderBy("node_id")
    first = own.withColumn("_part", F.pmod(F.xxhash64("node_id"), F.lit(64))).withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= most)
    first = first.groupBy("community_id").agg(F.slice(F.array_sort(F.collect_list("node_id")), 1, most).alias("first_members"))
    count = own.select("community_id", F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "path")), F.lit("([a-z0-9_]+)"), F.lit(1))).alias("term")).groupBy("community_id", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("community_id").orderBy(F.desc("n"), "term")
    top = count.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= terms).groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "term"))), lambda s: s["term"]).alias("top_terms"))
    return size.join(first, "community_id", "left").join(top, "community_id", "left").select("community_id", "members", "first_members", (F.col("members") > most).alias("truncated"), "top_terms")


# The wording of the two kinds of questions.
ABOUT_NODE = "What depends on %s (%s), and what would break if it changed?"
ABOUT_COMMUNITY = 'What is the shared purpose of the %d nodes in community "%s" (top terms: %s)?'


def questions(gods: DataFrame, communities: DataFrame) -> DataFrame:
    """(question) about the three nodes with most edges (name, degree) and the three largest communities of more than one member."""
    terms = F.coalesce(F.nullif(F.array_join("top_terms", ", "), F.lit("")), F.lit("no shared terms"))
    a = gods.orderBy(F.desc("degree"), "id").limit(3).select(F.format_string(ABOUT_NODE, "name", "path").alias("question"))
    b = communities.orderBy(F.desc("members"), "community_id").limit(3).where("members > 1").select(F.format_string(ABOUT_COMMUNITY, "members", "community_id", terms).alias("question"))
    return a.union(b)


def entrypoints(nodes: DataFrame, limit: int = 100) -> DataFrame:
    return nodes.where((F.col("kind") == "symbol") & F.col("name").rlike("(?i)^(main|start|run|handler)$")).orderBy("id").limit(limit)

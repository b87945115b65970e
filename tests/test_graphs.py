import pytest
from pyspark.sql import functions as F

from lorespark.operators import graphs as G
from lorespark.operators import iterative as I
from lorespark.plans import graphs as P

NODE, EDGE = "id string, kind string, path string, name string", "id string, kind string, from_id string, to_id string, confidence string"


def nodes(spark, *ids, kind="symbol"):
    return spark.createDataFrame([(i, kind, f"p/{i}", i) for i in ids], NODE)


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), EDGE)


def e(name, kind="calls", label="exact"):
    return (f"e-{name}", kind, name[0], name[1], label)


def test_communities_of_two_triangles_and_a_weak_bridge(spark):
    g = edges(spark, *map(e, ("ab", "bc", "ca", "de", "ef", "fd")), e("cd", "references", "heuristic"))
    found = {r.node_id: r.community_id for r in I.communities(nodes(spark, *"abcdef"), g).collect()}
    assert found == {"a": "b", "b": "b", "c": "b", "d": "e", "e": "e", "f": "e"}


def test_communities_without_semantic_edges(spark):
    assert {tuple(r) for r in I.communities(nodes(spark, "a", "b"), edges(spark)).collect()} == {("a", "a"), ("b", "b")}
    g = edges(spark, e("ab", "contains"), e("bc", "declares"), e("ac", "exports"))
    assert all(r.node_id == r.community_id for r in I.communities(nodes(spark, *"abc"), g).collect())


def test_shortest_path(spark):
    g = edges(spark, e("ab"), e("bc"), e("ac", "references", "heuristic"))
    rows = I.shortest_path(g, "a", "c").orderBy("step").collect()
    assert [r.node_id for r in rows] == ["a", "b", "c"] and [r.edge_id for r in rows] == [None, "e-ab", "e-bc"] and rows[0].total == 2
    assert I.shortest_path(g, "a", "z").count() == 0
    assert [(r.node_id, r.total) for r in I.shortest_path(g, "a", "a").collect()] == [("a", 0.0)]


def test_god_nodes(spark):
    rows = G.god_nodes(nodes(spark, *"abcd"), edges(spark, e("ab"), e("ac"), e("ad"), e("bc")), 2).collect()
    assert {(r.id, r.degree) for r in rows} == {("a", 3), ("b", 2)}


def test_surprising_and_coverage(spark):
    n = spark.createDataFrame([("p", "page", "p", "p"), ("c", "concept", "c", "c"), ("s", "symbol", "s", "s")], NODE)
    g = edges(spark, ("e-describes", "describes", "p", "c", "extracted"), ("e-mentions", "mentions", "c", "s", "extracted"))
    assert [r.id for r in G.surprising(n, g, 10).collect()] == ["e-mentions", "e-describes"]
    files = spark.createDataFrame([("f1", "file", "f1", "f1"), ("f2", "file", "f2", "f2")], NODE)
    assert tuple(G.coverage(files, edges(spark, ("x", "describes", "p", "f1", "extracted"))).first()) == (2, 1, 0.5)
    assert tuple(G.coverage(files.where("false"), edges(spark)).first()) == (0, 0, 0.0)


def test_cycles_and_flows(spark):
    g = edges(spark, *(e(x, "imports") for x in ("ab", "bc", "ca", "dc")))
    assert [r.cycle for r in I.cycles(g).collect()] == [["a", "b", "c"]]
    assert {tuple(r) for r in G.flows(nodes(spark, *"abcd"), g).collect()} == {("p/a", "p/b", 1), ("p/b", "p/c", 1), ("p/c", "p/a", 1), ("p/d", "p/c", 1)}


def test_proximity_reaches_two_steps(spark):
    g = edges(spark, e("ab"), e("bc"), e("cd"))
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {r.id for r in G.related(g, seeds, 10).collect()} == {"b", "c"}


def test_impact(spark):
    g = edges(spark, e("ab"), e("bc"), e("ac"), e("cd"))
    out = {(r.id, r.depth, r.via) for r in G.impact(g, spark.createDataFrame([("a",)], "id string"), "outbound", 5).collect()}
    assert out == {("a", 0, None), ("b", 1, "e-ab"), ("c", 1, "e-ac"), ("d", 2, "e-cd")}
    with pytest.raises(ValueError):
        G.impact(g, g.select("id"), "inbound", 6)


def test_components_of_a_long_chain(spark):
    ids = [f"{i:03}" for i in range(60)]
    g = edges(spark, *((f"e{a}", "calls", a, b, "exact") for a, b in zip(ids, ids[1:]) if a != "029"))
    found = {r.id: r.component for r in I.components(nodes(spark, *ids, "zzz"), g).collect()}
    assert all(found[i] == ("000" if i <= "029" else "030") for i in ids) and found["zzz"] == "zzz"


def test_substring_queries_need_a_whole_word_when_seeded(spark):
    n = spark.createDataFrame([("a", "symbol", "lib/x", "graphIndex"), ("b", "symbol", "lib/y", "index")], NODE)
    assert [r.id for r in G.ranked_candidates(n, edges(spark), "index", 5).collect()] == ["b"]
    assert [r.id for r in G.ranked_candidates(n, edges(spark), "index", 5, seeded=False).collect()] == ["b", "a"]
    assert G.ranked_candidates(n, edges(spark), "ndex", 5).count() == 0


def test_merge_overwrites_and_reports(spark):
    n, g = nodes(spark, "a", "b"), edges(spark, e("ab"))
    new = spark.createDataFrame([("b", "page", "p", "new")], NODE)
    all_nodes, all_edges, lost = G.merge(n, g, new, edges(spark, e("bz")))
    assert {(r.id, r.name) for r in all_nodes.collect()} == {("a", "a"), ("b", "new")}
    assert [r.id for r in all_edges.collect()] == ["e-ab"] and [tuple(r) for r in lost.collect()] == [("e-bz", "z")]


def test_questions(spark):
    gods = spark.createDataFrame([("h", "hub", "src/hub", 9)], "id string, name string, path string, degree int")
    groups = spark.createDataFrame([("c1", 3, ["alpha", "beta"]), ("c2", 1, ["x"])], "community_id string, members int, top_terms array<string>")
    assert [r.question for r in G.questions(gods, groups).collect()] == [
        "What depends on hub (src/hub), and what would break if it changed?",
        'What is the shared purpose of the 3 nodes in community "c1" (top terms: alpha, beta)?',
    ]


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """A star schema with items of small quantities only: P:17 is joined to S:1, S:5 and C:10 and to nothing by large quantities."""
    at = tmp_path_factory.mktemp("star")
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "r")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "n1", 0), (2, "n2", 0)]),
        "supplier": ("s_suppkey int, s_name string, s_nationkey int", [(1, "s", 1), (5, "s5", 1)]),
        "customer": ("c_custkey int, c_name string, c_nationkey int", [(1, "c", 2), (10, "c10", 1)]),
        "part": ("p_partkey int, p_name string", [(1, "p"), (17, "p17")]),
        "orders": ("o_orderkey int, o_custkey int, o_orderstatus string", [(1, 10, "F")]),
        "lineitem": ("l_orderkey int, l_partkey int, l_suppkey int, l_quantity double, l_returnflag string", [(1, 17, 5, 1.0, "A"), (1, 17, 1, 2.0, "A")]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_analytics_see_small_quantities_and_mentions(spark, star):
    part = {r.id: r.component for r in P.connected_components(spark, star).collect()}
    assert part["S:5"] == part["P:17"] == part["C:10"] == part["N:1"] and part["P:1"] == "P:1"
    group = {r.node_id: r.community_id for r in P.communities(spark, star).collect()}
    assert group["P:17"] == group["S:5"] == group["C:10"]
    way = P.shortest_path(spark, star).orderBy("step").collect()
    assert [r.node_id for r in way] == ["S:5", "P:17", "C:10"] and way[0].total == pytest.approx(1 + 1 / 0.7)
    assert any("P:17" in r.cycle for r in P.cycles(spark, star).collect())
    assert any("the 5 nodes in community" in r.question for r in P.suggested_questions(spark, star).collect())


def test_impact_sees_small_quantities_and_mentions(spark, star):
    near = lambda q: {r.id: r.depth for r in q(spark, star).collect()}
    assert near(P.impact_both) | {"P:17": 1, "C:10": 2} == near(P.impact_both)
    assert near(P.impact_inbound) == {"P:17": 0, "S:1": 1, "S:5": 1, "N:1": 2, "C:10": 3, "R:0": 3}
    assert near(P.change_impact)["S:1"] == 1


def test_distances_reach_every_node(spark, star):
    def near(rows):
        out = {}
        for r in rows:
            out.setdefault(r.from_id, []).append((r.to_id, r.id, r.confidence))
            out.setdefault(r.to_id, []).append((r.from_id, r.id, r.confidence))
        return out

    ids = [f"{i:03}" for i in range(36)]
    chain = edges(spark, *((f"e{a}", "calls", a, b, "exact") for a, b in zip(ids, ids[1:])))
    assert {r.node: r.d for r in I.distances(chain, "000").collect()} == {i: float(k) for k, i in enumerate(ids)}
    got = {r.node: r.d for r in P.path_distances(spark, star).collect()}
    ways = near(G.semantic(P.tg_edges(spark, star)).collect())
    wanted = {n: d for n in ways if (d := I.dijkstra(ways, "S:5", n)) is not None}
    assert got == pytest.approx(wanted) and {"P:17", "C:10", "N:1"} <= set(got) and not {"C:1", "N:2"} & set(got)
    pages = G.semantic(P.tg_edges(spark, star)).where("kind in ('calls', 'references')")
    assert max(r.d for r in I.distances(pages, "S:5").collect()) == 5  # farther than 3


def test_edges_stay_where_they_are(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "id string")
        g = spark.createDataFrame([(f"e{i}", "calls", f"n{i % 23}", f"n{i * 7 % 19}", "exact") for i in range(100)] + [("z", "calls", None, "n1", "exact")], "id string, kind string, from_id string, to_id string, confidence string")
        inside = G.contained(g, nodes)
        assert {r.id for r in inside.collect()} == {f"e{i}" for i in range(100) if i % 23 < 20}
        assert "Exchange hashpartitioning" not in inside._jdf.queryExecution().executedPlan().toString()
        assert {(r.id, r.missing) for r in G.dangling(g, nodes).collect()} == {(f"e{i}", f"n{i % 23}") for i in range(100) if i % 23 >= 20} | {("z", None)}
        roots = spark.createDataFrame([("n1",)], "id string")
        short = G.impact(g, roots, "outbound", 4, via=False)
        assert short.columns == ["id", "depth"] and {tuple(r) for r in short.collect()} == {(r.id, r.depth) for r in G.impact(g, roots, "outbound", 4).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_merge_of_hashed_edges(spark):
    bare = spark.createDataFrame([("calls", f"n{i % 23}", f"n{i * 7 % 19}", "exact") for i in range(300)], "kind string, from_id string, to_id string, confidence string").distinct()
    g = bare.select(G.edge_id(*map(F.col, bare.columns)).alias("id"), "*")
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "id string")
    first, second = g.where("substr(id, 1, 1) < '8'"), g.where("substr(id, 1, 1) >= '4'")
    a, b = (G.merge(nodes.where("id < 'n5'"), first, nodes.where("id > 'n3'"), second, hashed=h) for h in (False, True))
    for x, y in zip(a, b):
        assert sorted(map(tuple, x.select(sorted(x.columns)).collect())) == sorted(map(tuple, y.select(sorted(x.columns)).collect()))


def _random(spark, n, m):
    import random

    r = random.Random(4)
    return edges(spark, *((f"e{k}", "calls", f"n{r.randrange(n)}", f"n{r.randrange(n)}", r.choice(["exact", "resolved", "heuristic"])) for k in range(m)))


def _no_edge_is_shuffled(monkeypatch, at_most):
    """Has ``kept`` fail on what is larger than a result by nodes."""
    kept = I.kept

    def small(df):
        out = kept(df)
        assert out.count() <= at_most
        return out

    monkeypatch.setattr(I, "kept", small)


def test_components_keep_no_more_than_pairs_by_node(spark, monkeypatch):
    g = _random(spark, 60, 3000).union(edges(spark, ("x", "calls", "z1", "z2", "exact"), ("y", "calls", "z3", "z3", "exact"))).coalesce(2)
    _no_edge_is_shuffled(monkeypatch, 2 * 62)
    ids = [f"n{i}" for i in range(60)]
    found = {r.id: r.component for r in I.components(nodes(spark, *ids, "z1", "z2", "z3"), g).collect()}
    assert found == {i: "n0" for i in ids} | {"z1": "z1", "z2": "z1", "z3": "z3"}


def test_spanning_connects_the_same_nodes_whatever_is_carried_on(spark):
    g = _random(spark, 300, 200).select(F.col("from_id").alias("u"), F.col("to_id").alias("v"))

    def parts(pairs):
        up = {f"n{i}": f"n{i}" for i in range(300)}
        top = lambda x: x if up[x] == x else top(up[x])
        for u, v in pairs:
            a, b = sorted((top(u), top(v)))
            up[b] = a
        return {i: top(i) for i in up}

    rows = [tuple(r) for r in g.collect()]
    for block, carried in ((1_000_000, 1_000_000), (7, 5), (50, 1)):
        assert parts([tuple(r) for r in I.spanning(g, block, carried).collect()]) == parts(rows)


def test_distances_keep_no_more_than_costs_by_node(spark, monkeypatch):
    g = _random(spark, 60, 3000).coalesce(2)
    near = {}
    for r in g.collect():
        near.setdefault(r.from_id, []).append((r.to_id, r.id, r.confidence))
        near.setdefault(r.to_id, []).append((r.from_id, r.id, r.confidence))
    _no_edge_is_shuffled(monkeypatch, 60)
    wanted = {n: I.dijkstra(near, "n0", n) for n in near}
    assert {r.node: r.d for r in I.distances(g, "n0").collect()} == pytest.approx(wanted)
    assert {r.node: r.d for r in I.distances(g, "n0", most=7).collect()} == pytest.approx(wanted)


def test_cycles_of_a_large_component_are_read_on_demand(spark, monkeypatch):
    g = _random(spark, 60, 300).union(edges(spark, *((f"t{k}", "calls", a, b, "exact") for k, (a, b) in enumerate([("z1", "z2"), ("z2", "z1"), ("z2", "z2"), ("r", "n1"), ("n1", "s"), ("z2", None)])))).coalesce(2)
    listed = lambda **how: sorted((r.component, r.cycle) for r in I.cycles(g, **how).collect())
    every, some = listed(limit=None), listed(limit=5)
    assert len(every) > 20 and [c for c in every if c[0] == "z1"] == [("z1", ["z1", "z2"]), ("z1", ["z2"])]
    assert len(some) == 7 and set(map(repr, some)) <= set(map(repr, every))
    _no_edge_is_shuffled(monkeypatch, 2 * 62)
    assert listed(limit=5, group=10) == listed(limit=5, group=0) == some and listed(limit=1000, group=0) == every


def _by_label_sweeps(rows, sweeps=20):
    near = {}
    for r in sorted(rows, key=lambda r: (r.id, r.from_id, r.to_id)):
        if r.from_id != r.to_id:
            near.setdefault(r.from_id, []).append((r.to_id, G.WEIGHTS[r.confidence]))
            near.setdefault(r.to_id, []).append((r.from_id, G.WEIGHTS[r.confidence]))
    return I.label_sweeps(sorted(near), near, sweeps)


@pytest.mark.parametrize("n, m", [(40, 90), (60, 600), (400, 700)])
def test_communities_are_one_pass_over_files_and_no_group(spark, n, m):
    g = _random(spark, n, m).union(edges(spark, ("x", "calls", "a", "no", "exact"))).coalesce(2)
    hashed = g.withColumn("id", G.edge_id(*map(F.col, ("kind", "from_id", "to_id", "confidence"))))
    all_nodes = nodes(spark, "a", *(f"n{i}" for i in range(n)))
    for graph, how in ((g, {}), (hashed, {}), (hashed, {"hashed": True})):
        wanted = {f"n{i}": f"n{i}" for i in range(n)} | {"a": "a"} | _by_label_sweeps(graph.where("to_id <> 'no'").collect())
        for dense in (0, 30, 10**9):  # all at once, some, one by one
            out = I.communities(all_nodes, graph, dense=dense, **how)
            assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
            found = [tuple(r) for r in out.collect()]
            assert len(found) == len(wanted) and dict(found) == wanted


def test_labels_do_not_depend_on_blocks(tmp_path):
    import random

    import numpy as np
    import pyarrow as pa

    from lorespark.operators import labels as L

    r = random.Random(8)
    names = [f"{side}{i:03}" for side in "ab" for i in range(60)]
    rows = [(r.randrange(60), 60 + r.randrange(60), r.randrange(6)) for _ in range(900)]  # runs of nodes without edges among them
    near = {}
    id_ = lambda a, b, c: L.sha256("\x00".join(("edge", "imports", names[a], names[b], L.LABELS[c])).encode()).hexdigest()
    for a, b, c in sorted(rows, key=lambda x: (id_(*x), x)):
        near.setdefault(names[a], []).append((names[b], G.WEIGHTS[L.LABELS[c]]))
        near.setdefault(names[b], []).append((names[a], G.WEIGHTS[L.LABELS[c]]))
    wanted = I.label_sweeps(sorted(near), near)
    for block, dense in ((10**6, 1), (50, 1), (7, 100), (10**6, 10**6)):
        at = tmp_path / f"{block}-{dense}"
        at.mkdir()
        work = L.Sweeps(pa.array(names), str(at), block, dense)
        for k in range(0, len(rows), 100):
            a, b, c = (np.array(x) for x in zip(*rows[k : k + 100]))
            work.add(a, b, 6 * L.SEMANTIC.index("imports") + c, None)
        work.arrange()
        label = work.run(20)
        assert {n: names[label[i]] for i, n in enumerate(names) if n in near} == wanted


@pytest.mark.parametrize("own", [False, True])
def test_edges_are_laid_out_as_they_come(tmp_path, own):
    import random

    import numpy as np
    import pyarrow as pa

    from lorespark.operators import labels as L

    r = random.Random(9)
    names = pa.array([f"n{i:02}" for i in range(50)])
    rows = [(*r.sample(range(50), 2), r.randrange(6)) for _ in range(700)]
    count = np.bincount([x for a, b, _ in rows for x in (a, b)], minlength=50)
    ids = [f"{i * 7919 % 1000}" * (i > 200) * (i % 3) for i in range(700)] if own else None  # the first two blocks have none

    def work(name, ends=None):
        (tmp_path / name).mkdir()
        out = L.Sweeps(names, str(tmp_path / name), 50, 30, ends)
        for k in range(0, 700, 100):
            some = ids[k : k + 100] if own else None
            out.add(*(np.array(x) for x in zip(*rows[k : k + 100])), some if some and any(some) else None)
        used = sum(f.stat().st_size for f in (tmp_path / name).iterdir())
        out.arrange()
        return out, used

    first, _ = work("written")
    assert [first.given(k) for k in range(1400)].count("") == 1400 - 2 * sum(map(bool, ids or []))
    for name, ends in (("counted", count), ("more", count + np.arange(50) % 3)):
        out, used = work(name, ends)
        for x in ("other", "code", "start"):
            assert getattr(out, x)[: len(getattr(first, x))].tolist() == getattr(first, x).tolist()
        assert [out.given(k) for k in range(1400)] == [first.given(k) for k in range(1400)]
        assert out.run(20).tolist() == first.run(20).tolist()
        assert own or used <= 5 * ends.sum()  # nothing else is written
    with pytest.raises(ValueError, match="more ends"):
        work("fewer", count - (np.arange(50) == 7))


def test_counted_ends():
    import pyarrow as pa

    from lorespark.operators import labels as L

    batches = [pa.record_batch({"from_id": ["a", "b", "a"], "to_id": ["b", "c", "d"]}), pa.record_batch({"from_id": ["d"], "to_id": ["e"]})]
    whole = lambda: {x["id"]: x["n"] for b in L.counted_ends(iter(batches)) for x in b.to_pylist()}
    wanted = {"a": 2, "b": 2, "c": 1, "d": 2, "e": 1}
    assert whole() == wanted
    with pytest.MonkeyPatch.context() as m:
        m.setattr(L, "BLOCK", 2)
        assert whole() == wanted


def test_two_cycles_shuffle_each_pair_once(spark, monkeypatch):
    g = _random(spark, 40, 900).union(edges(spark, ("x", "calls", "a", None, "exact"), ("y", "calls", "a", "a", "exact")))
    pairs = {(r.from_id, r.to_id) for r in g.collect() if r.to_id}
    wanted = {(a, b) for a, b in pairs if a < b and (b, a) in pairs}
    for sent in (G.SENT, 0):
        monkeypatch.setattr(G, "SENT", sent)
        out = G.two_cycles(g)
        assert sorted(tuple(r) for r in out.collect()) == sorted(wanted) and wanted
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") <= 1

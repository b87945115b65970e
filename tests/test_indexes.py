"""Stored indexes agree with the operators that read everything, and are updated without a rebuild."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lorespark.functions.ids import edge_id
from lorespark.operators import graphs, lexical
from lorespark.sources import shared
from lorespark.sources.graph_index import GraphIndex
from lorespark.sources.lexical_index import LexicalIndex
from lorespark.sources.store import GenerationStore
from lorespark.sources.vector_store import VectorStore

DOCS = [("strong", "graph retrieval graph retrieval"), ("weak", "graph of other things here and there"), ("none", "cooking pasta"), ("null", None), ("empty", "")]


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_lexical_index(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "id string, text string")
    index = LexicalIndex(spark, f"file://{tmp_path}/index")
    assert index.search("graph", 5).count() == 0
    assert index.update(df.selectExpr("*", "1 as len", "2 as tf")) == (5, 0)
    for query in ("graph retrieval", "graph graph", "retrievals", "", "zzz"):
        assert rows(index.search(query, 5)) == rows(lexical.lexical_search(df, "id", "text", query, 5)), query
    assert index.update(df) == (0, 0) and len(index.manifest()["segments"]) == 1
    # one text changes, one is gone, one is new
    now = spark.createDataFrame([("strong", "pasta"), ("weak", DOCS[1][1]), ("new", "graph"), ("null", None), ("empty", "")], "id string, text string")
    assert index.update(now, whole=True) == (2, 1)
    for _ in range(2):
        assert rows(index.search("graph pasta", 9)) == rows(lexical.lexical_search(now, "id", "text", "graph pasta", 9))
        index.compact()
        assert len(index.manifest()["segments"]) == 1
    assert index.remove(spark.createDataFrame([("new",), ("strange",)], "id string")) == 1
    assert rows(index.search("graph", 9)) == rows(lexical.lexical_search(now.where("id <> 'new'"), "id", "text", "graph", 9))
    # a text that comes back
    assert index.update(spark.createDataFrame([("new", "graph")] * 2, "id string, text string")) == (1, 0)
    assert rows(index.search("graph", 9)) == rows(lexical.lexical_search(now, "id", "text", "graph", 9))


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/vectors")
    schema = "chunk_id string, digest string, vector array<double>"
    first = spark.createDataFrame([("a", "1", [3.0, 4.0]), ("b", "1", [1.0, 0.0]), ("c", "1", [1.0]), ("d", "1", None), ("a", "1", [3.0, 4.0])], schema)
    with pytest.raises(LookupError):
        store.read("m/x", "r1")
    assert store.upsert("m/x", "r1", first, 2)[0] == 2
    assert [r.chunk_id for r in store.search("m/x", "r1", [3.0, 4.0], 5).collect()] == ["a", "b"]
    assert store.upsert("m/x", "r1", spark.createDataFrame([("a", "2", [0.0, 1.0]), ("b", "1", [1.0, 0.0])], schema), 2) == (1, 1)
    assert {r.chunk_id: list(r.vector) for r in store.read("m/x", "r1").collect()} == {"a": [0, 127], "b": [127, 0]}
    with pytest.raises(ValueError):
        store.upsert("m/x", "r1", first, 3)
    chunks = spark.createDataFrame([("a", "2", "known"), ("e", "1", "new text"), ("f", "1", None)], "chunk_id string, digest string, text string")
    assert store.embed("m/x", "r1", chunks, lambda texts: [[0.0, float(len(t))] for t in texts], 2) == (1, 0)
    store.mark_unavailable("m/x", "r1", "no model")
    with pytest.raises(LookupError):
        store.search("m/x", "r1", [1.0, 0.0], 1)
    assert store.upsert("m/x", "r1", first.where("false"), 2) == (0, 0) and store.read("m/x", "r1").count() == 3


EDGES = "id string, kind string, from_id string, to_id string, confidence string"


def test_graph_index(spark, tmp_path):
    (tmp_path / "in").write_text("x")
    edges = spark.createDataFrame([(f"e{i}", "calls", f"n{i % 7}", f"n{i * 3 % 11}", ["exact", "resolved", "heuristic"][i % 3]) for i in range(60)], EDGES)
    nodes = spark.createDataFrame([(f"n{i}", "symbol", f"p{i}", f"s{i}") for i in range(12)], "id string, kind string, path string, name string")
    calls = []
    build = lambda: calls.append(1) or edges
    for _ in range(2):
        g = GraphIndex(spark, f"t-{tmp_path.name}", [f"file://{tmp_path}/in"], build)
    assert len(calls) == 1
    seeds = spark.createDataFrame([("n1",), ("n4",)], "id string")
    assert rows(g.proximity(["n1", "n4"], 3)) == rows(graphs.proximity(edges, seeds, 3))
    assert rows(g.context(nodes, ["n1", "n4"], 2)) == rows(graphs.context(nodes, edges, seeds, 2))
    assert rows(g.adjacent(["n1", "n4"], 3)) == rows(graphs.adjacent(edges, seeds, 3))
    assert rows(g.at(seeds)) == rows(g.at(["n1", "n4", "n1"])) and g.at([]).count() == 0
    (tmp_path / "in").write_text("other")
    GraphIndex(spark, f"t-{tmp_path.name}", [f"file://{tmp_path}/in"], build)
    assert len(calls) == 2


def test_graph_index_stores_no_id_that_can_be_made_again(spark, tmp_path):
    (tmp_path / "in").write_text("x")
    bare = spark.createDataFrame([("calls", f"n{i % 700}", f"n{i * 3 % 1100}", "exact") for i in range(20_000)], "kind string, from_id string, to_id string, confidence string").distinct()
    ids = bare.select(edge_id(*[F.col(c) for c in ("kind", "from_id", "to_id", "confidence")]).alias("id"), "*")
    odd = ids.unionAll(spark.createDataFrame([("own", "calls", "n1", "n2", "exact")], ids.schema))
    folder = shared.shared_folder(spark).removeprefix("file://")
    for name, edges, whole in (("hashed", ids, ids), ("none", bare, ids), ("odd", odd, odd)):
        g = GraphIndex(spark, f"{name}-{tmp_path.name}", [f"file://{tmp_path}/in"], lambda edges=edges: edges)
        assert rows(g.edges) == rows(whole) and g.edges.columns == ids.columns
        assert rows(g.at(["n1"])) == rows(g.at(spark.createDataFrame([("n1",)], "id string"))) == rows(g.at(["n1", *[f"no{i}" for i in range(300)]]))
        stored = sum(f.stat().st_size for f in Path(folder, "stored").glob(f"{name}-{tmp_path.name}*/**/*.parquet"))
        assert stored < 20 * whole.count()  # an id alone has 64 hex digits, of 32 bytes at best


def test_pointer_is_replaced_in_one_step(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/g")
    for name in ("a", "b"):
        store._point("current", name)
        assert store._pointer("current") == name


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Context:
        master = "spark://somewhere"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                return Context._sc

        class _sc:
            @staticmethod
            def getCheckpointDir():
                return Context._none

        class _none:
            @staticmethod
            def isDefined():
                return False

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default):
                return default

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
    assert shared.shared_folder(spark).startswith("file://")
    assert spark.range(3).select(F.col("id")).transform(shared.kept).count() == 3


def test_wiki_pages_are_indexed_one_by_one(spark, tmp_path):
    from lorespark.sources.wiki import Wiki

    wiki = Wiki(spark, f"file://{tmp_path}/wiki")
    assert wiki.pages().count() == 0 and wiki.finalise("r0", "2026-01-01T00:00:00Z")
    assert wiki.write("a/b.md", "# Title\n\nalpha beta\n") == (1, 0)
    assert wiki.write("c.md", "gamma\n") == (1, 0)
    assert wiki.read("a/b.md").startswith("# Title") and {r.page for r in wiki.pages().collect()} == {"a/b.md", "c.md"}
    assert wiki.write("a/b.md", "# Title\n\nalpha beta\n") == (0, 0)
    assert wiki.write("a/b.md", "# Title\n\nalpha delta\n") == (1, 1)
    hit = lambda q: wiki.index.bm25(q).count()
    assert (hit("alpha"), hit("beta"), hit("delta"), hit("gamma")) == (1, 0, 1, 1)
    assert wiki.write("c.md", "") == (0, 1) and hit("gamma") == 0 and wiki.read("c.md") == "" and wiki.index.manifest()["texts"] == 1
    for bad in ("../x.md", "/x.md", "x.txt"):
        with pytest.raises(ValueError):
            wiki.write(bad, "")
    with pytest.raises(FileNotFoundError):
        wiki.read("none.md")
    assert wiki.finalise("r1", "2026-01-02T00:00:00Z", "two pages") and not wiki.finalise("r2", "2026-01-03T00:00:00Z")
    assert wiki.state()["run"] == "r1"
    wiki.purge("index", "state")
    assert wiki.state() is None and wiki.index.manifest()["segments"] == [] and wiki.pages().count() == 2


def test_schedules(spark, tmp_path):
    from lorespark.sources.schedules import ScheduleStore, problems

    store = ScheduleStore(spark, f"file://{tmp_path}/schedules.json")
    good = {"id": "b", "command": "ingest", "cron": "0 9 * * mon", "enabled": True, "source_id": "s", "timezone": "Europe/Rome"}
    assert store.list() == [] and store.set(good) and not store.set(good) and store.set(good | {"enabled": False})
    assert store.set({"id": "a", "command": "update", "cron": "* * * * *", "enabled": True})
    assert [r.id for r in store.table().collect()] == ["a", "b"] and store.remove("b") and not store.remove("b")
    for change in ({"id": "../x"}, {"command": "delete"}, {"cron": "x"}, {"timezone": "Mars/Base"}, {"enabled": "yes"}, {"command": "update"}, {"more": 1}, {"source_id": "password=hunter2secret"}):
        assert problems(spark, good | change), change
        with pytest.raises(ValueError):
            store.set(good | change)


def test_overview(spark):
    from lorespark.operators import overview

    nodes = spark.createDataFrame([("a", "module", "m/a", "a"), ("b", "symbol", "s/b", "main"), ("p", "page", "p", "page")], "id string, kind string, path string, name string")
    edges = spark.createDataFrame([("e1", "calls", "a", "b", "exact"), ("e2", "mentions", "p", "b", "ambiguous"), ("e3", "imports", "a", "b", "exact")], EDGES)
    loops = spark.createDataFrame([(["a", "b"],), (["a", "b"],)], "cycle array<string>")
    got = rows(overview.architecture_map(nodes, edges, loops, 1))
    assert got == {("modules", 1, "a", None, False), ("entrypoints", 1, "b", None, False), ("hubs", 1, "b", 3, True), ("cycles", 1, "a > b", None, False), ("flows", 1, "m/a > s/b", 1, False)}
    assert overview.architecture_map(nodes.where("false"), edges.where("false"), loops.where("false"), 5).count() == 0
    member = spark.createDataFrame([("b", "a"), ("a", "a")], "node_id string, community_id string")
    assert rows(overview.explain_node(nodes, edges, "MAIN", member, True)) == {("node", "id", "b"), ("node", "kind", "symbol"), ("node", "path", "s/b"), ("node", "name", "main"), ("neighbour", "a", "a"), ("neighbour", "p", "page"), ("community", "a", "2"), ("community stale", "a", "true"), ("cited by", "p", "p")}
    assert overview.explain_node(nodes, edges, "strange", member, True).count() == 0
    files = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "path string, source_id string")
    assert rows(overview.status(files, files)) == {(True, 3, 0, 0, 0)}
    assert rows(overview.status(files.where("path <> 'x'"), files.withColumn("source_id", F.lit("2")))) == {(False, 2, 0, 1, 1)}
    assert rows(overview.doctor({"good": nodes.where("false"), "bad": nodes, "so so": edges}, ("so so",))) == {("good", "pass", 0), ("bad", "fail", 3), ("so so", "warn", 3)}
    assert rows(overview.ambiguous_edges(edges).select("id")) == {("e2",)}


def test_shuffle_files_are_released_between_the_parts_of_a_segment(spark, tmp_path, monkeypatch):
    from lorespark.sources import lexical_index as L

    seen = []
    monkeypatch.setattr(L, "release", lambda _: seen.append(sorted(p.name for p in next(tmp_path.glob("segment-*")).iterdir())))
    L.LexicalIndex(spark, str(tmp_path)).update(spark.createDataFrame([("1", "some words")], "id string, text string"))
    assert seen == [["documents"], ["documents", "postings"]]

import math
from collections import Counter

import pytest

from lorespark.operators import lexical, retrieval, vectors

DOCS = [("strong", "graph retrieval graph retrieval"), ("weak", "graph of other things here and there"), ("none", "cooking pasta"), ("null", None), ("empty", "")]


def docs(spark):
    return spark.createDataFrame(DOCS, "id string, text string")


def test_bm25_order_and_values(spark):
    got = {r.id: r.score for r in lexical.bm25(docs(spark), "id", "text", "graph retrieval").collect()}
    texts = {k: (t or "").split() for k, t in DOCS}
    n, avg = len(texts), sum(map(len, texts.values())) / len(texts)
    want = {}
    for k, ws in texts.items():
        tf = Counter(ws)
        for q in ("graph", "retrieval"):
            df = sum(q in w for w in texts.values())
            if tf[q]:
                want[k] = want.get(k, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf[q] * 2.2 / (tf[q] + 1.2 * (0.25 + 0.75 * len(ws) / avg))
    assert got == pytest.approx(want) and got["strong"] > got["weak"]


def test_trigrams_find_inflections(spark):
    rows = lexical.lexical_search(docs(spark), "id", "text", "retrievals", 5).collect()
    assert [r.id for r in rows] == ["strong"]


def test_empty_query_and_table(spark):
    assert lexical.lexical_search(docs(spark), "id", "text", "", 5).count() == 0
    assert lexical.lexical_search(docs(spark).where("false"), "id", "text", "graph", 5).count() == 0


def test_fusion_ties_by_id(spark):
    a = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    b = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "id string, score double")
    rows = retrieval.fuse({"lexical": a, "vector": b}, 5).collect()
    assert [(r.id, r.lexical, r.vector, r.graph) for r in rows] == [("a", 1, 2, None), ("b", 2, 1, None)]
    with pytest.raises(ValueError):
        retrieval.fuse({"other": a}, 5)


def test_quantise_rounds_halves_up_and_keeps_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id int, v array<double>")
    assert {r.id: list(r.vector) for r in vectors.quantise(df, "id", "v").collect()} == {1: [0, 0], 2: [76, 102]}
    assert [r.id for r in vectors.vector_search(df, "id", "v", [3.0, 4.0], 2).collect()] == [2, 1]

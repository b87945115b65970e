import numpy as np

from lorespark.llm import neighbours as N

STORE = "chunk_id string, model_id string, model_revision string, vector array<tinyint>"
MANIFEST = "model_id string, model_revision string, dims int"


def store(spark, rows):
    return spark.createDataFrame(rows, STORE), spark.createDataFrame([("m", "r1", 16), ("m", "r1", 16), ("m", "r2", 4)], MANIFEST)


def exact(rows, dims, k=5):
    own = {r[0]: np.array(r[3], float) for r in rows if r[3] is not None and len(r[3]) == dims and any(r[3])}
    ids = sorted(own)
    v = np.array([own[i] for i in ids])
    n = (v * v).sum(1)
    s = np.round((v @ v.T) / np.sqrt(n[:, None] * n[None, :]), 12)
    np.fill_diagonal(s, -2)
    return {i: [(ids[j], s[a, j]) for j in np.argsort(-s[a], kind="stable")[:k]] for a, i in enumerate(ids)}


def clustered(n, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-90, 90, (max(1, n // 8), dims))
    return [(f"{i:05}", "m", "r1", np.clip(centres[rng.integers(len(centres))] + rng.integers(-9, 10, dims), -127, 127).tolist()) for i in range(n)]


def pairs(truth, least):
    return {(min(a, b), max(a, b)) for a, near in truth.items() for b, s in near if s >= least}


def test_recall_against_brute_force(spark):
    rows = clustered(3000)
    got = {tuple(r) for r in N.similar_pairs(*store(spark, rows), leaf=64).collect()}
    want = pairs(exact(rows, 16), 0.75)
    assert len(got & want) / len(want) > 0.9 and len(got & want) / len(got) > 0.9


def test_copies_ties_and_dirt(spark):
    rows = clustered(60) + [(f"copy{i:02}", "m", "r1", [5] * 16) for i in range(30)] + [("copy00", "m", "r1", [5] * 16)]
    rows += [("other", "m", "r2", [1, 2, 3, 4]), ("long", "m", "r1", [1] * 17), ("zero", "m", "r1", [0] * 16), ("none", "m", "r1", None), ("empty", "m", "r1", []), ("strange", "z", "r1", [1] * 16)]
    got = {tuple(r) for r in N.similar_pairs(*store(spark, rows)).collect()}
    assert got == pairs(exact([r for r in rows if r[2] == "r1" and r[1] == "m"], 16), 0.75)


def test_a_hot_leaf_is_cut_into_blocks_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 20)
    rows = clustered(150)
    got = {tuple(r) for r in N.similar_pairs(*store(spark, rows), leaf=10_000).collect()}
    assert got == pairs(exact(rows, 16), 0.75)


def test_empty_and_wide(spark):
    df, manifest = store(spark, [])
    assert N.similar_pairs(df, manifest).count() == 0
    df, manifest = store(spark, clustered(20))
    wide = df.selectExpr("*", "'x' as space", "'y' as class", "1 as tree", "true as member")
    assert N.similar_pairs(wide, manifest.selectExpr("*", "1 as other")).count() == N.similar_pairs(df, manifest).count() > 0


def test_queue_visits_the_nearest_leaf_first():
    rng = np.random.default_rng(0)
    v = rng.standard_normal((2000, 16)).astype(np.float32)
    f = N.Forest(v, 2000, 4, 64)
    at = f.project(v)
    own = f.own(at)
    for i in range(50):
        visits = f.probe(at[i].tolist(), 12)
        assert len(set(visits)) == 12 and set(enumerate(own[i].tolist())) <= set(visits)


def test_leaves_stay_as_large_as_rows_grow():
    rng = np.random.default_rng(0)
    sample = rng.standard_normal((4_000, 16)).astype(np.float32)
    for rows in (80_000, 640_000, 10_000_000):
        f = N.Forest(sample, rows, 2, 512)
        assert 128 < rows / 2**f.depth <= 512
        assert sum(b.size for b in f.borders) <= 2 * 2 * 4_000  # the table is no larger than the sample allows
    f = N.Forest(sample, 1_000_000, 2, 512)
    assert f.fitted < f.depth
    more = rng.standard_normal((20_000, 16)).astype(np.float32)
    at = f.project(more)
    own = f.own(at)
    leaves = np.bincount(own[:, 0], minlength=1 << f.depth)
    assert leaves.max() < 40 * len(more) / len(leaves)  # borders below the sample still halve the nodes
    for i in range(20):
        assert set(enumerate(own[i].tolist())) <= set(f.probe(at[i].tolist(), N.probes_at(f.depth)))


def test_a_large_class_is_salted_and_a_space_outside_the_sample_is_searched(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 7)
    rows = clustered(60) + [(f"copy{i:02}", "m", "r1", [5] * 16) for i in range(30)]
    want = pairs(exact(rows, 16), 0.75)
    rows += [("x1", "m", "r2", [1, 2, 3, 4]), ("x2", "m", "r2", [2, 4, 6, 8]), ("x3", "m", "r2", [-1, 2, 3, 4])]
    got = {tuple(r) for r in N.similar_pairs(*store(spark, rows), sample=5).collect()}
    assert got == want | {("x1", "x2"), ("x1", "x3"), ("x2", "x3")}


def test_equal_similarities_take_the_smaller_ids(spark):
    rows = [(f"{i}", "m", "r2", [i + 1, 0, 0, 0]) for i in range(9)]  # nine vectors of one direction
    got = {tuple(r) for r in N.nearest(*store(spark, rows)).select("chunk_id", "other").collect()}
    assert got == {(a[0], b) for a in rows for b in [r[0] for r in rows if r is not a][:5]}

from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.operators import snapshots as S

SHARDS = "workspace_id string, store_id string, generation string, path string, content_hash string"
MANIFESTS = "store_id string, generation string, generated_at timestamp"
A, B = "a" * 64, "b" * 64


def frames(spark, chains: dict[str, list[dict[str, str | None]]]):
    rows, heads = [], []
    for store, snaps in chains.items():
        for n, snap in enumerate(snaps):
            heads.append((store, f"g{n}", datetime(2026, 1, 1 + n)))
            rows += [("w", store, f"g{n}", p, h) for p, h in snap.items()]
    return spark.createDataFrame(rows, SHARDS), spark.createDataFrame(heads, MANIFESTS)


def expected(chains):
    out = set()
    for store, snaps in chains.items():
        for n in range(1, len(snaps)):
            old, new = snaps[n - 1], snaps[n]
            out |= {(store, f"g{n}", p, "added") for p in new.keys() - old.keys()}
            out |= {(store, f"g{n}", p, "removed") for p in old.keys() - new.keys()}
            out |= {(store, f"g{n}", p, "changed") for p in old.keys() & new.keys() if old[p] != new[p]}
    return out


def got(spark, chains):
    rows = S.snapshot_changes(*frames(spark, chains)).collect()
    assert len(rows) == len(set(rows))
    return set(map(tuple, rows))


def test_all_changes(spark):
    chains = {"s": [{"a": A, "b": A}, {"a": B, "c": None}, {}, {"a": B, "c": None}, {"a": B, "c": A}], "t": [{"a": A}]}
    assert got(spark, chains) == expected(chains)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from("abcd"), st.sampled_from([A, B, None]), max_size=4), min_size=1, max_size=6))
def test_against_brute_force(spark, snaps):
    chains = {"s": snaps, "t": snaps[::-1]}
    assert got(spark, chains) == expected(chains)


def test_notations_repeats_and_late_manifests(spark):
    shards = spark.createDataFrame(
        [("w", "s", "g0", "./a", A.upper()), ("w", "s", "g0", "./a", A.upper()), ("w", "s", "g1", "a", f"sha256:{A}"), ("w", "s", "g1", None, A), ("w", "s", "g1", "b", "short"), ("w", "s", "gx", "a", B)], SHARDS
    )
    heads = [("s", "g1", datetime(2026, 1, 2)), ("s", "g0", datetime(2026, 1, 1)), ("s", "g0", datetime(2026, 1, 1)), ("s", None, None)]
    assert [tuple(r) for r in S.snapshot_changes(shards, spark.createDataFrame(heads, MANIFESTS)).collect()] == [("s", "g1", "b", "added")]


def test_empty_and_clashing_columns(spark):
    shards, heads = frames(spark, {})
    assert S.snapshot_changes(shards, heads).count() == 0
    chains = {"s": [{"a": A}, {"a": B}]}
    shards, heads = frames(spark, chains)
    wide = shards.selectExpr("*", "1 as ord", "2 as last", "'x' as digest", "'y' as change")
    assert set(map(tuple, S.snapshot_changes(wide, heads.selectExpr("*", "'z' as path", "3 as ord")).collect())) == expected(chains)


def test_no_shuffle_but_the_needed_ones(spark):
    plan = S.interval_events(S.validity_intervals(*(lambda s, m: (s, S.chain(m)))(*frames(spark, {"s": [{"a": A}, {"a": B}]}))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    after = plan[: plan.index("REPARTITION_BY_COL")]
    assert after.count("Exchange hashpartitioning") == 1  # that one

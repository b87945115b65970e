import pytest
from pyspark.sql import functions as F

from lorespark.functions.schedule import valid_cron, valid_timezone
from lorespark.operators.report import graph_report
from lorespark.sources import git
from lorespark.streaming.ingest import append_novel, dedupe_stream, windowed_counts


@pytest.mark.parametrize("text", ["* * * * *", "0 9 * * mon-fri", "*/15 0-6,22 1 jan,dec 7", "5/10 * * * *"])
def test_cron(text):
    assert valid_cron(text)


@pytest.mark.parametrize("text", ["", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "5-1 * * * *", "*/0 * * * *", "* * * foo *", "*-5 * * * *"])
def test_bad_cron(text):
    assert not valid_cron(text)


def test_timezone():
    assert valid_timezone("Europe/Rome") and not valid_timezone("Mars/Base")


def test_git(spark):
    blob = "a" * 40
    assert git.index_blobs(f"100644 {blob} 0\tsrc/a b.py\x00100644 {blob} 2\tconflict\x00") == {"src/a b.py": blob}
    assert git.porcelain_paths(" M a\0R  new\0old\0?? c d\0") == ["a", "c d", "new", "old"]
    assert {tuple(r) for r in git.changed(spark, ["a", "b"], ["b", "c"]).collect()} == {("a", "committed"), ("b", "working-tree"), ("c", "working-tree")}
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("bin", "\0z")], "path string, content string")
    got = {r.path: r.source_id for r in git.source_ids(files, spark.createDataFrame([("a", blob)], "path string, blob string")).collect()}
    assert got["a"] == f"git:{blob}" and got["b"].startswith("worktree:") and set(got) == {"a", "b"}


def test_repository(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 'é'\n")
    (tmp_path / "src/b.bin").write_bytes(b"\x10\x00\x01")
    (tmp_path / "src/c.bin").write_bytes(b"\x10\x01")
    (tmp_path / "node_modules/d.js").write_text("x")
    assert {tuple(r) for r in git.skipped_files(spark, str(tmp_path), 9).collect()} == {("src/b.bin", "BINARY_FILE")}
    assert {tuple(r) for r in git.skipped_files(spark, str(tmp_path), 2).collect()} == {("src/a.py", "FILE_TOO_LARGE"), ("src/b.bin", "FILE_TOO_LARGE")}
    assert {r.path: r.content for r in git.read_repository(spark, str(tmp_path)).collect()} == {"src/a.py": "x = 'é'\n", "src/c.bin": "\x10\x01"}


def test_report(spark):
    nodes = spark.createDataFrame([("a", "symbol", "p/a", "a"), ("b", "page", "p/b", "b")], "id string, kind string, path string, name string")
    edges = spark.createDataFrame([("e", "mentions", "b", "a", "ambiguous")], "id string, kind string, from_id string, to_id string, confidence string")
    text = graph_report(nodes, edges, nodes.select(F.col("id").alias("node_id"), F.lit("a").alias("community_id")))
    assert text.count("\n## ") == 6 and "1 of 1 code nodes are described (100.0%)" in text and "- e: wiki to code (ambiguous)" in text
    empty = graph_report(nodes.where("false"), edges.where("false"), nodes.where("false").select(F.col("id").alias("node_id"), F.lit("a").alias("community_id")))
    assert empty.count("Nothing found.") == 6


def test_streams(spark, tmp_path):
    df = spark.sql("select cast(id % 5 as string) as k, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int)) as ts, 1.0D as value from range(20)")
    df.write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for n in range(2):  # a second run over the same rows adds nothing
        append_novel(spark, stream(), f"file://{tmp_path}/out", ["k"], f"{tmp_path}/log{n}").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list("01234")
    for name, out in (("dedupe", dedupe_stream(stream(), ["k"], "ts", "1 hour")), ("counts", windowed_counts(stream(), "ts", "k", "10 minutes", "1 minute"))):
        out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.table("dedupe").collect()) == list("01234")
    assert all(r.n == 2 and r.total == 2.0 for r in spark.table("counts").collect())


def test_places_and_running_sums_over_ranges(spark):
    from lorespark.operators.checks import within_bytes
    from lorespark.operators.order import numbered

    df = spark.range(200).selectExpr("cast(199 - id as int) as k", "case when id % 3 = 0 then 'ab' else '' end as t").repartition(7)
    assert {(r.k, r.place) for r in numbered(df, [F.col("k")]).collect()} == {(k, k + 1) for k in range(200)}
    got = sorted((r.k, r.bytes, r.total) for r in within_bytes(df, "k", "t", 6).collect())
    want, total = [], 0
    for k in range(200):
        n = 2 if (199 - k) % 3 == 0 else 0
        total += n
        if total <= 6:
            want.append((k, n, total))
    assert got == want
    assert numbered(df.where("false"), [F.col("k")]).count() == 0

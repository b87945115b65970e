from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text as T
from lorespark.functions.canonical import canonical_map, nfkc
from lorespark.functions.unigram import Unigram, encode_column
from lorespark.operators import checks, ingest, pages, scan
from lorespark.sources.store import GenerationStore, upsert

ITEM = "item_id bigint, source_id string, kind string, host string, fetched_at timestamp, run_hash string, external_id string, title string, text string, url string, occurred_at timestamp, metadata map<string,string>"


def item(i, run="r1", ext="x", text="t", day=1, **more):
    row = dict(item_id=i, source_id="s", kind="slack", host="cli", fetched_at=datetime(2026, 1, day), run_hash=run, external_id=ext, title=None, text=text, url=None, occurred_at=None, metadata=None) | more
    return tuple(row[c.split()[0]] for c in ITEM.replace("map<string,string>", "map").split(", "))


def test_items(spark):
    df = spark.createDataFrame([item(1), item(1), item(2, "r2", day=2), item(3, "r3", text="new", day=3), item(4, "r3", ext="y", day=3, kind="fax", title="")], ITEM)
    assert {r.item_id for r in ingest.novel_items(df).collect()} == {1, 3, 4}
    assert {r.item_id for r in ingest.unknown_items(df, df.where("run_hash = 'r1'")).collect()} == {3, 4}
    assert {r.run_hash for r in ingest.retained_runs(df, 2).collect()} == {"r2", "r3"}
    assert {(r.rule, r.key) for r in ingest.violations(df).collect()} == {("kind unknown", "r3/y"), ("title empty", "r3/y"), ("source of several kinds", "s")}
    assert tuple(ingest.source_summary(df).first())[:3] == ("s", 3, 4)
    assert ingest.novel_items(df.where("false")).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("api_key=abcdef123456 rest", "[REDACTED] rest"),
        ("Authorization: Bearer abcdefgh123", "authorization: [REDACTED]"),
        ("bearer abcdefgh1234 x", "Bearer [REDACTED] x"),
        ("https://user:pass@host/x", "https://[REDACTED]@host/x"),
        ("èbearer abcdefgh1234", "èBearer [REDACTED]"),
        ("nothing\0 here", "nothing here"),
        ("token: short", "token: short"),
        (None, None),
    ],
)
def test_redaction(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(T.redacted(F.col("t")).alias("r"), T.sensitive(F.col("t")).alias("s")).first()
    assert df.r == want and df.s == (text != want)


def test_metadata(spark):
    df = spark.createDataFrame([({"apiKey": "x", "note": "password=12345678", "b": None},), (None,), ({},)], "m map<string,string>")
    rows = df.select(T.redacted_map(F.col("m")).alias("r"), canonical_map(F.col("m")).alias("j")).collect()
    assert rows[0].r == {"apiKey": "[REDACTED]", "note": "[REDACTED]", "b": None}
    assert [r.j for r in rows] == ['{"apiKey":"x","b":null,"note":"password=12345678"}', None, "{}"]
    assert spark.createDataFrame([("ﬁ",), (None,)], "t string").select(nfkc("t")).collect()[0][0] == "fi"


def brute_chunks(text, least=200, most=400):
    import math
    import re

    lines, blocks, current = re.split(r"\r?\n", text), [], []
    for n, line in enumerate([*lines, ""], 1):
        heading = re.match(r"#{1,6}\s+\S", line)
        if current and (heading or not line.strip()):
            blocks.append((current[0][0], current[-1][0], "\n".join(x for _, x in current)))
            current = []
        if line.strip():
            current.append((n, line))
    count = lambda s: math.ceil(1.3 * len(re.findall(r"[^\W_]+|[^\w\s]|_", s)))
    out, open_ = [], None
    for a, b, s in blocks:
        k = count(s)
        if open_ and open_[2] >= least and open_[2] + k > most:
            out.append((open_[0], a - 1, open_[2]))
            open_ = None
        open_ = (a if open_ is None else open_[0], b, (open_[2] if open_ else 0) + k)
        if open_[2] >= most:
            out.append(open_)
            open_ = None
    return out + ([(open_[0], len(lines), open_[2])] if open_ else [])


def test_chunks_against_brute_force(spark):
    para = lambda n, w: " ".join(f"{w}{i}" for i in range(n))
    texts = {"a": f"# T\n\n{para(100, 'a')}\n\n{para(90, 'b')}\n## U\n{para(200, 'c')}\n\n{para(400, 'd')}\n\nend\n", "b": "", "c": "\n\n", "d": "one\r\ntwo\r\n\r\nthree", "e": None}
    df = spark.createDataFrame(list(texts.items()), "page string, content string")
    got = {}
    for r in pages.chunk_pages(df, "page", "content").collect():
        got.setdefault(r.page, []).append((r.start_line, r.end_line, r.tokens))
    assert {k: sorted(v) for k, v in got.items()} == {k: c for k, t in texts.items() if t is not None and (c := brute_chunks(t))}


def test_links(spark):
    df = spark.createDataFrame([("docs/a.md", "[x](b.md#top) [y](http://h/c.md) [z](../up.md) [w](gone.md) [i](i.png)"), ("docs/b.md", None)], "page string, content string")
    assert {r.target for r in pages.broken_links(df, "page", "content").collect()} == {"../up.md", "gone.md"}


def test_bytes(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "é"), (3, None), (4, "abc")], "k int, t string")
    assert [(r.k, r.total) for r in checks.within_bytes(df, "k", "t", 5).orderBy("k").collect()] == [(1, 2), (2, 4), (3, 4)]


def test_scanner_scopes_and_calls():
    found = scan.scan_text("class First:\n    def run(self):\n        helper()  # no()\n\nclass Second:\n    def run(self):\n        s = 'no()'\n", "python")
    assert [(n, s) for w, n, s, *_ in found if w == "symbol"] == [("First", None), ("run", "First"), ("Second", None), ("run", "Second")]
    assert [(n, s) for w, n, s, *_ in found if w == "call"] == [("helper", "First.run")]


def test_assembly(spark):
    files = [
        ("w", "src/app.ts", "typescript", 'import { helper } from "./helper.js";\nimport x from "gone";\nexport function main() {\n  helper();\n}\n'),
        ("w", "src/helper.ts", "typescript", "export function helper() {}\n"),
        ("w", "src/null.py", "python", None),
        ("w", "README.md", "markdown", "# x"),
    ]
    n, e, d = scan.assemble(spark.createDataFrame(files + files[:1], "workspace_id string, path string, language string, content string"))
    names = {r.id: r.name for r in n.collect()}
    assert {(r.kind, names[r.from_id], names[r.to_id]) for r in e.where("kind in ('imports', 'calls')").collect()} == {("imports", "app.ts", "helper.ts"), ("calls", "main", "helper")}
    assert {(r.path, r.code) for r in d.collect()} == {("src/app.ts", "UNRESOLVED_IMPORT"), ("README.md", "LEXICAL_FILE_ONLY")}


def test_store(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/g")
    nodes = lambda x: spark.createDataFrame([(x, "file", x, x)], "id string, kind string, path string, name string")
    edges = spark.createDataFrame([], "id string, kind string, from_id string, to_id string, confidence string")
    first = store.write(nodes("a"), edges)
    assert store.write(nodes("a"), edges) == first
    second, third = store.write(nodes("b"), edges), store.write(nodes("c"), edges)
    assert store.read()[2:] == (third, False)
    assert sorted(p.name for p in (tmp_path / "g").iterdir() if p.name.startswith("g-")) == sorted([second, third])
    (tmp_path / "g" / third / "_DONE").unlink()
    assert store.read()[2:] == (second, True)


def test_upsert(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    rows = lambda *r: spark.createDataFrame(list(r), "id string, digest string, bucket string")
    assert upsert(spark, path, rows(("a", "1", "0"), ("b", "1", "1")), "id", "digest", "bucket") == (2, 0)
    assert upsert(spark, path, rows(("a", "2", "0"), ("b", "1", "1")), "id", "digest", "bucket") == (1, 1)
    assert {(r.id, r.digest) for r in spark.read.parquet(path).collect()} == {("a", "2"), ("b", "1")}


def test_unigram(spark):
    config = {"model": {"type": "Unigram", "unk_id": 2, "vocab": [["<s>", 0], ["</s>", 0], ["<unk>", 0], ["▁he", -1.0], ["llo", -1.5], ["▁hello", -2.0], ["▁", -3.0], ["h", -4.0]]}, "added_tokens": [{"id": 0, "content": "<s>"}, {"id": 1, "content": "</s>"}], "truncation": {"max_length": 6}}
    model = Unigram.from_json(config)
    assert model.encode("hello") == [0, 5, 1] and model.encode("") == [0, 1] and model.encode("hello zz") == [0, 5, 6, 2, 1]
    df = spark.createDataFrame([(1, "hello"), (2, None)], "k int, t string")
    assert {r.k: list(r.ids) for r in encode_column(df, "k", "t", model).collect()} == {1: [0, 5, 1], 2: []}

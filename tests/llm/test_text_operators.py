import random
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespark.llm import bpe, leakage, reading, splitting


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.read_ranks()


@pytest.fixture(scope="module")
def reference():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


# Encoding


def test_the_hash_is_minimal_and_perfect(vocabulary):
    assert vocabulary.n == 50_256 == len(vocabulary.keys) and None not in vocabulary.keys
    assert sorted(vocabulary.values) == list(range(50_256)) and vocabulary.get(b"no such token at all") == -1
    assert bpe.MinimalPerfectHash([], []).get(b"x") == -1


@settings(max_examples=150, deadline=None)
@given(st.text())
def test_ids_equal_the_tokenizer_s(vocabulary, reference, text):
    assert bpe.Encoder(vocabulary).encode(text).tolist() == reference.encode_ordinary(text)


def test_long_and_special_texts(vocabulary, reference):
    for t in ("a" * 20_000, "<|endoftext|> x", "日本" * 500, "\u200d🧵" * 300, " \n\t " * 99):
        assert bpe.Encoder(vocabulary).encode(t).tolist() == reference.encode_ordinary(t)


def test_encoded_table(spark, reference):
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (4, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'y' as ids")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_texts(df).collect()}
    assert got == {1: reference.encode_ordinary("hello world"), 2: [], 3: [], 4: reference.encode_ordinary("x" * 5000)}
    assert bpe.encode_texts(df.where("false")).count() == 0


# Leakage


def test_leaks(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"before {passage.upper().replace(' ', ', ')} after"), (2, " ".join(f"w{i}" for i in range(12))), (3, None), (4, ""), (5, "x w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 y"), (6, passage.replace("w9", "v9")), (1, "again")]
    items = [(10, passage), (11, "Instruction: " + passage), (12, None), (13, "short"), (10, passage)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "5 as item_id")
    i = spark.createDataFrame(items, "item_id bigint, item_text string").selectExpr("*", "5 as doc_id")
    assert {tuple(r) for r in leakage.leaked_items(d, i).collect()} == {(1, 10), (1, 11), (5, 10), (5, 11)}
    text = docs[0][1]
    spans = {(r.doc_id, r.item_id): text[r.start_pos : r.end_pos] for r in leakage.leaked_spans(d, i).collect() if r.doc_id == 1}
    assert spans[1, 10] == passage.upper().replace(" ", ", ")
    assert leakage.leaked_items(d, i.where("false")).count() == leakage.leaked_items(d.where("false"), i).count() == 0
    assert {tuple(r) for r in leakage.leaked_spans(d, i, block_chars=60).select("doc_id", "item_id").distinct().collect()} == {(1, 10), (1, 11), (5, 10), (5, 11)}


@pytest.mark.parametrize("size, length", [(4, 8), (5, 11), (13, 40)])
def test_leaks_against_brute_force(size, length):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "Straße", "ÇA"])
    items = [(k // 2, " ".join(word() for _ in range(rng.randrange(length)))) for k in range(12)]  # two texts of each item
    items += [(9, " ".join(["a"] * length))]
    known = leakage.Items(items, size)
    fold = lambda t: [w.casefold() for w in t.split()]
    grams = lambda ws: {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}
    for k in range(200):
        words = [word() for _ in range(length)]
        if k % 2:  # a piece of an item
            piece = rng.choice(items)[1].split()
            words[3 : 3 + len(piece)] = piece
        text = " ".join(words)
        spans = known.spans(text)
        assert {i for i, _, _ in spans} == {i for i, t in items if grams(fold(t)) & grams(fold(text))}
        for item, first, last in spans:  # each stretch stands in the item, and none lies within another
            stretch = " ".join(fold(text)[first : last + 1])
            assert last - first + 1 >= size and any(stretch in " ".join(fold(t)) for i, t in items if i == item)
        assert not any(x != y and x[0] == y[0] and x[1] <= y[1] and y[2] <= x[2] for x in spans for y in spans)


def test_a_full_block_of_items_fits_in_a_worker():
    code = f"""
import random, resource
from lorespark.llm import leakage
rng = random.Random(1)
words = [f"w{{i}}" for i in range(50_000)]
items = [(k, " ".join(rng.choices(words, k=1000))) for k in range({leakage.BLOCK_CHARS} // 6_000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
leakage.Items(items, 13)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2])
    assert int(out.stdout.split()[-1]) < 1000, out.stderr


def test_repeated_rows_of_a_corpus_are_found_without_moving_it(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c"), (3, "d"), (None, "e"), (None, "e"), (4, None)], "doc_id bigint, text string")
    want = sorted(map(repr, {tuple(r) for r in df.collect()}))
    for most in (10, 1):
        assert sorted(repr(tuple(r)) for r in bpe.repeated_once(df, "doc_id", most).collect()) == want
    once = df.where("doc_id = 2 or text is null")
    assert bpe.repeated_once(once, "doc_id").count() == 2 and bpe.repeated_once(df.where("false"), "doc_id").count() == 0


# Splitting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n。é", max_size=400), st.integers(10, 60), st.integers(0, 9))
def test_pieces(text, limit, overlap):
    pieces = splitting.cut(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b in pieces)
    assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(pieces, pieces[1:]))
    assert len(pieces) == 1 or len(text) > limit


def test_natural_and_hard_cuts():
    text = "a" * 60 + "\n\n" + "b" * 20 + ". " + "c" * 60
    assert splitting.cut(text, 100, 10)[0] == (0, 62)
    assert splitting.cut("x" * 250, 100, 10) == [(0, 100), (90, 190), (180, 250)]
    with pytest.raises(ValueError):
        splitting.cut("x", 5, 5)


def test_chunks(spark):
    page = "\r\n".join(["l" * 30] * 10) + "\n"
    pages = spark.createDataFrame([("p", page, 1), ("p", page, 1), ("n", None, 1), ("e", "", 1)], "page string, content string, updated_at int").selectExpr("*", "'x' as id", "0 as start_line")
    refs = [("a", "p", 1, 10), ("a", "p", 1, 10), ("b", "p", 9, 99), ("c", "gone", 1, 2), ("d", "n", 1, 2), ("e", "p", 20, 30), ("f", "p", 5, 2), ("g", "e", 1, 1), ("h", "p", None, 3), ("i", "p", 0, 3)]
    r = spark.createDataFrame(refs, "id string, path string, start_line int, end_line int").selectExpr("*", "'y' as content", "1 as piece")
    texts = {x.id: x.text for x in splitting.chunk_texts(r, pages).collect()}
    assert {k: len(t) for k, t in texts.items()} == {"a": 309, "b": 61, "e": 0, "f": 0, "g": 0, "i": 92}
    rows = sorted(map(tuple, splitting.split_chunks(r, pages, 100, 10).collect()))
    assert {x[0] for x in rows} == {"a"} and all(x[7] == texts["a"][x[3] : x[4]] and len(x[7]) <= 100 for x in rows)
    assert all(x[5] == 1 + texts["a"][: x[3]].count("\n") for x in rows) and rows[-1][6] == 10
    assert splitting.split_chunks(r.where("false"), pages).count() == splitting.split_chunks(r, pages.where("false")).count() == 0


# Reading levels

WORDS = {
    1: "the cat is on the red mat and it is good for you to see it",
    2: "the team asked us to update the weekly report so that nobody has to guess about it",
    3: "the asynchronous cache invalidates the persistent index and consequently reduces the latency of the initial query",
    4: "the epistemic status of heuristically inferred relations vitiates the irreducible ambiguity of unqualified identifiers",
}


def document(level, rng, n=12):
    out = []
    for _ in range(n):
        k = level if rng.random() < 0.8 else min(4, max(1, level + rng.choice((-1, 1))))
        ws = WORDS[k].split()
        a = rng.randrange(3)
        out.append(" ".join(ws[a : a + rng.randrange(9, 13)]).capitalize() + ".")
    return " ".join(out)


def test_levels_on_held_out_documents(spark):
    rng = random.Random(7)
    truth = {i: rng.randrange(1, 5) for i in range(300)}
    rows = [(i, document(k, rng), "mail") for i, k in truth.items()]
    labels = [(i, min(4, max(1, k + (rng.choice((-1, 1)) if rng.random() < 0.15 else 0))), rater) for i, k in truth.items() if i < 100 for rater in "ab"] + [(5, None, "a"), (99_999, 2, "a"), (7, 9, "c")]
    rows += [(900, None, "mail"), (901, "", "mail"), (902, "the cat is here", "mail"), (903, document(2, rng), "log"), (904, "der die das und ist nicht ein eine den dem des mit von zu auf für im sich " * 4, "mail"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, doc_kind string").selectExpr("*", "1 as level", "2 as levels")
    ratings = spark.createDataFrame(labels, "doc_id bigint, level int, rater string").selectExpr("*", "'x' as text")
    got = {r.doc_id: r.level for r in reading.reading_levels(docs, ratings).collect()}
    assert set(got) == set(truth)
    held = [i for i in truth if i >= 100]
    assert sum(got[i] == truth[i] for i in held) / len(held) > 0.9
    assert reading.reading_levels(docs, ratings.where("false")).count() == reading.reading_levels(docs.where("false"), ratings).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic_is_monotone_and_keeps_the_mean(points):
    import numpy as np

    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    end, mean = reading.isotonic(x, y)
    assert (np.diff(mean) > 0).all() and (np.diff(end) > 0).all() and end[-1] == x.max()
    fitted = mean[np.searchsorted(end, x)]
    assert abs(fitted.mean() - y.mean()) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.floats(-9, 9)), max_size=40))
def test_quartiles_of_many_owners_at_once(pairs):
    import numpy as np

    x, owner = np.array([p[1] for p in pairs], float), np.array([p[0] for p in pairs], int)
    got = reading.quartile_means(x, owner, 6)
    for k in range(6):
        own = x[owner == k]
        assert got[k] == pytest.approx(np.quantile(own, reading.QUARTILES).mean() if len(own) else 0)


def test_weights_follow_the_text():
    rng = random.Random(9)
    chained = [[["a", "b", "c", "d"] * 3 for _ in range(4)] for _ in range(60)]
    mixed = [[[rng.choice("abcdefgh") for _ in range(12)] for _ in range(4)] for _ in range(60)]
    ratings = [float(1 + k % 4) for k in range(60)]
    one, two = reading.Levels(chained, ratings).weights, reading.Levels(mixed, ratings).weights
    assert abs(sum(one) - 1) < 1e-9 and one[0] > 0.8 > two[0] and two[1] > one[1]
    assert reading.Levels(chained[:3], ratings[:3]).weights == reading.WEIGHTS


def test_reading_counts_every_rated_document(spark):
    import numpy as np

    vocabulary = [f"word{chr(97 + i)}" for i in range(20)]
    docs = [[[vocabulary[(i * 7 + j * (1 + i % 4)) % 20] for j in range(12)] for _ in range(3)] for i in range(3_100)]
    schema = "sentences array<array<string>>, levels array<int>, held boolean"
    models, scale = reading.trained(spark.createDataFrame([(d, [1 + i % 4], i % 5 == 0) for i, d in enumerate(docs)], schema).repartition(5))
    here = reading.Levels(docs, [float(1 + i % 4) for i in range(len(docs))])
    assert models.vocabulary == here.vocabulary and (models.codes == here.codes).all()
    assert np.allclose(models.bigram, here.bigram) and np.allclose(models.weights, here.weights)
    assert scale.border == pytest.approx(reading.Scale(here.read(docs)[2], [[1 + i % 4] for i in range(len(docs))]).border)

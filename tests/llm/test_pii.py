import random

import pytest

from lorespark.llm import pii

TEXT = "tbl string, row_id bigint, text string"


def lexicon():
    return pii.Flags(pii.GIVEN | {"torvin"}, frozenset(("ulmveld", "ravnhagen", "wexmere")))


def found(text):
    return {(k, text[a:b]) for k, a, b, v in pii.candidates(text, lexicon())}


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("write to anna.x+wiki@mail.example now", "EMAIL", "anna.x+wiki@mail.example"),
        ("cc anna [at] mail [dot] example", "EMAIL", "anna [at] mail [dot] example"),
        ("cc anna (at) mail.example", "EMAIL", "anna (at) mail.example"),
        ("to anna dot wexmere at mail dot example.", "EMAIL", "anna dot wexmere at mail dot example"),
        ("mailto:ANNA＠MAIL.EXAMPLE", "EMAIL", "ANNA＠MAIL.EXAMPLE"),
        ("Tel. +44 20 7946 0123.", "PHONE", "+44 20 7946 0123"),
        ("call (205) 555-0131 soon", "PHONE", "(205) 555-0131"),
        ("Tel. 030/23125-400", "PHONE", "030/23125-400"),
        ("her passport number is X68879215", "ID", "X68879215"),
        ("tax id QQ 12 34 56 C", "ID", "QQ 12 34 56 C"),
        ("Codice fiscale: RARGLB96A83Z026B", "ID", "RARGLB96A83Z026B"),
        ("SSN on the form: 966-56-4704", "ID", "966-56-4704"),
        ("Invoice to 198 Foxglove Blvd, Apt 16D, Halder, please", "ADDRESS", "198 Foxglove Blvd, Apt 16D, Halder"),
        ("Invoice to Birkenfeldstraße 99, 40668 Quillport.", "ADDRESS", "Birkenfeldstraße 99, 40668 Quillport"),
        ("Invoice to Via delle Querce 63, 17568 Lower", "ADDRESS", "Via delle Querce 63, 17568 Lower"),
        ("Invoice to 167 bis avenue du Vieux Phare, 27352 Lower", "ADDRESS", "167 bis avenue du Vieux Phare, 27352 Lower"),
        ("Invoice to P.O. Box 2732, Halder", "ADDRESS", "P.O. Box 2732, Halder"),
        ("ask Anna Ulmveld about it", "NAME", "Anna Ulmveld"),
        ("ask ANNA ULMVELD about it", "NAME", "ANNA ULMVELD"),
        ("ask torvin ulmveld about it", "NAME", "torvin ulmveld"),
        ("ask Anna M. von Ravnhagen about it", "NAME", "Anna M. von Ravnhagen"),
        ("ask O'Wexmere, Anna about it", "NAME", "O'Wexmere, Anna"),
        ("ask T. Ulmveld-Wexmere about it", "NAME", "T. Ulmveld-Wexmere"),
    ],
)
def test_proposed(text, kind, span):
    assert (kind, span) in found(text)


@pytest.mark.parametrize("text, span", [("ask H. Ravnhågen about it", "H. Ravnhågen"), ("ask Ravnhågen, H. about it", "Ravnhågen, H."), ("ask torvin ulmvéld about it", "torvin ulmvéld"), ("ask José García about it", "José García"), ("ask H. RAVNHÅGEN about it", "H. RAVNHÅGEN"), ("ask Torvin WexMere about it", "Torvin WexMere")])
def test_accents_hide_no_name(text, span):
    assert any(k == "NAME" and s.rstrip(".") == span.rstrip(".") for k, s in found(text))


@pytest.mark.parametrize(
    "text, spans",
    [
        ("Tel. 030 1234567 / 0171 2345678", ["030 1234567", "0171 2345678"]),
        ("call 212 555 0142 - 646 555 0199 now", ["212 555 0142", "646 555 0199"]),
        ("seen 2026-01-05 020 7946 0958 there", ["020 7946 0958"]),
        ("call +44 20 7946 0958 020 7946 0123", ["+44 20 7946 0958", "020 7946 0123"]),
        ("call (205) 555-0131 / (205) 555-0199", ["(205) 555-0131", "(205) 555-0199"]),
        ("sum 12345678901234567890", []),
    ],
)
def test_numbers_in_one_group_of_digits(text, spans):
    assert {s for k, s in found(text) if k == "PHONE"} == set(spans)


@pytest.mark.parametrize("span", ["Postfach 10234", "P.O. Box 45012", "Via Libertà 12", "Apartado de correos 70123", "Lindenweg\u00a012", "Am\u00a0Markt 3", "Calle O’Donnell’ 7", "Hafenring\n4"])
def test_address_alone_in_its_text(span):
    assert ("ADDRESS", span) in found(f"send it to {span}")


@pytest.mark.parametrize("text", ["Install @kiln/x@1.6.4 first", "Mention @oncall", "ask amber-weaver about Amber Weaver", "2026-03-20T19:30:45Z WARN offset=71", "", "x" * 50_000])
def test_not_proposed(text):
    assert not {k for k, _ in found(text)} - {"ADDRESS"}


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("ask Élodie Wexmere about it", "NAME", "Élodie Wexmere"),
        ("ask Łukasz Ulmveld about it", "NAME", "Łukasz Ulmveld"),
        ("担当者：田中 太郎さんに連絡してください", "NAME", "田中 太郎"),
        ("山田太郎様へ", "NAME", "山田太郎"),
        ("氏名：アンナ・ミュラー", "NAME", "アンナ・ミュラー"),
        ("住所：東京都千代田区丸の内1丁目9-2 です", "ADDRESS", "東京都千代田区丸の内1丁目9-2"),
        ("ship it to 12 Oak Way, Halder", "ADDRESS", "12 Oak Way, Halder"),
        ("адрес: ул. Ленина, 12", "ADDRESS", "ул. Ленина, 12"),
        ("woont in Keizersgracht 12b", "ADDRESS", "Keizersgracht 12b"),
        ("Tel. ０３０ １２３４５６７８", "PHONE", "０３０ １２３４５６７８"),
    ],
)
def test_other_scripts_and_streets(text, kind, span):
    assert (kind, span) in found(text)


@pytest.mark.parametrize("text", ["担当者様へ", "The Wexmere report", "Mr Wexmere said", "Dear Ulmveld"])
def test_titles_and_offices_are_no_names(text):
    assert not any(k == "NAME" and "+" in v[:2] and s.split()[0] in ("The", "Mr", "Dear", "担当者") for k, s, v in [(k, text[a:b], v) for k, a, b, v in pii.candidates(text, lexicon())])


def test_cyrillic_names_are_learned(spark):
    given, last = ["Мария", "Иван", "Ольга", "Пётр"], ["Иванова", "Сидоров", "Кузнецова"]
    rng = random.Random(3)
    names = [f"{rng.choice(given)} {rng.choice(last)}" for _ in range(60)]
    rows = [("documents", i, f"Автор: {n} написал отчёт {i}. Harbor Street is only a code name.") for i, n in enumerate(names)] + [("documents", 100 + i, t) for i, (_, _, t) in enumerate(corpus(60)[0])]
    got = {(r.row_id, r.start_pos) for r in pii.find_mentions(spark.createDataFrame(rows, TEXT)).collect() if r.pii_type == "NAME"}
    assert sum((i, 7) in got for i in range(60)) >= 55


def test_quick_looks_hide_nothing(monkeypatch):
    """With and without the looks that spare searches the candidates are the same."""
    rng = random.Random(4)
    words = ["12 Oak Way", "Tel. 030/23125-400", "X68879215", "St", "Dr", "3 Elm St.", "7 Main Ave,", "QQ 12 34 56 C", "2026-01-05", "a", "Anna", "Ulmveld", "\u00a0", "\n", "5 rue du Port", "(205) 555-0131", "RARGLB96A83Z026B", "é", "1", "22", "9 High\u00a0Rd"]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(400)]
    flag = lexicon()
    quick = [pii.candidates(t, flag) for t in texts]
    monkeypatch.setattr(pii, "has_number", lambda t: True)

    class Every(list):
        def iter(self, text):
            return [(0, "street"), (0, "bare"), (0, "number")]

    flag.automaton = Every()
    monkeypatch.setattr(pii, "STREET_QUICK", pii.re.compile(""))
    assert quick == [pii.candidates(t, flag) for t in texts]


def test_em_finds_reliabilities():
    rng, counts = random.Random(1), {}
    for _ in range(4000):
        true = rng.random() < 0.3
        votes = "".join("+" if (rng.random() < p) == true else "-" for p in (0.95, 0.9, 0.7)) + rng.choice("-0+")
        counts[votes] = counts.get(votes, 0) + 1
    p = pii.em(counts)
    assert all(p[v] > 0.9 for v in p if v.startswith("+++")) and all(p[v] < 0.1 for v in p if v.startswith("---"))
    assert abs(p["+++-"] - p["++++"]) < 0.05  # a labeler of noise tells nothing
    assert pii.em({}) == {}


def corpus(n):
    given, last = ["Anna", "Hugo", "Marta", "Torvin", "Zerelle"], ["Ulmveld", "Ravnhagen", "Wexmere", "Brimsley", "Yarrova"]
    out, truth, rng = [], set(), random.Random(2)
    for i in range(n):
        name = f"{rng.choice(given)} {rng.choice(last)}"
        mail = f"user{i}@mail.example"
        text = f"Please ask {name} about amber-weaver. Write to {mail} if Amber Weaver in amber-weaver fails. Call +44 20 7946 0{i % 900 + 100} soon."
        text += rng.choice(["", " Build 2026.310.555 took 252 ms on 192.0.2.27.", " Checksum 00482193-77 belongs to batch 7.", " Order 4471-02-9930 was moved.", " Harbor Street is only the code name of the amber-weaver cluster."])
        truth |= {("documents", i, "NAME", text.index(name)), ("documents", i, "EMAIL", text.index(mail)), ("documents", i, "PHONE", text.index("+44"))}
        out.append(("documents", i, text))
    return out, truth


def test_end_to_end(spark):
    rows, truth = corpus(120)
    extra = [("documents", 900, None), ("documents", 901, ""), ("documents", 902, "plain words only"), rows[0]]
    df = spark.createDataFrame(rows + extra, TEXT).selectExpr("*", "1 as votes", "'x' as span")
    mentions = pii.find_mentions(df)
    got = {(r.tbl, r.row_id, r.pii_type, r.start_pos) for r in mentions.collect()}
    assert len(got & truth) / len(truth) > 0.95 and len(got & truth) / len(got) > 0.95
    clean = {r.row_id: r.text for r in pii.redact(df.select("tbl", "row_id", "text"), mentions).collect()}
    assert len(clean) == 123 and clean[900] is None and clean[902] == "plain words only"
    assert clean[5].startswith("Please ask [NAME] about amber-weaver. Write to [EMAIL] if") and "[PHONE] soon" in clean[5]


def test_empty_table(spark):
    df = spark.createDataFrame([], TEXT)
    assert pii.find_mentions(df).count() == 0 and pii.redact(df, pii.find_mentions(df)).count() == 0


def test_redaction_counts_code_points(spark):
    texts = spark.createDataFrame([("d", 1, "🧵é a@b.example 🧵 x"), ("d", 2, "z" * 100_000 + " end")], TEXT)
    mentions = spark.createDataFrame([("d", 1, "EMAIL", 3, 14), ("d", 1, "NAME", 5, 9), ("d", 2, "NAME", 100_001, 100_004)], "tbl string, row_id bigint, pii_type string, start_pos int, end_pos int")
    got = {r.row_id: r.text for r in pii.redact(texts, mentions).collect()}
    assert got[1] == "🧵é [EMAIL] 🧵 x" and got[2] == "z" * 100_000 + " [NAME]"


def test_surname_with_one_given_name(spark):
    """It is learned at any count, and copies of a text count once."""
    rows, _ = corpus(60)
    own = [("documents", 1000 + i, f"Note {i}: please ask Chidi Okafor about amber-weaver.") for i in range(5)]
    copies = [("documents", 2000 + i, "Restart Frobel Quandril in the cluster.") for i in range(300)]
    for texts in (rows + own, rows + own[:1], rows + own + own[:1] * 200):
        given, surnames = pii.learn_lexicon(spark.createDataFrame(texts, TEXT))[:2]
        assert "okafor" in surnames
    one, many = (pii.learn_lexicon(spark.createDataFrame(rows + own + copies[:k], TEXT))[1] for k in (1, 300))
    assert one == many and "okafor" in many


def test_two_letter_and_unicode_names(spark):
    assert ("NAME", "Wei Xu") in found("please ask Wei Xu about it") and ("NAME", "Anna Li") in found("ask Anna Li about it")
    rows, _ = corpus(60)
    own = [("documents", 1000 + i, f"Note {i}: please ask {n} about amber-weaver.") for i, n in enumerate(("Wei Xu", "Anna Xu", "Anna Öztürk", "Hugo Öztürk", "Marta Łuczak", "Anna Łuczak", "Łucja Ulmveld", "Łucja Wexmere"))]
    given, surnames = pii.learn_lexicon(spark.createDataFrame(rows + own, TEXT))[:2]
    assert {"xu", "ozturk", "łuczak"} <= surnames and "łucja" in given
    flag = pii.Flags(given, surnames)
    for text, span in (("ask Xu, Anna about it", "Xu, Anna"), ("ask H. Öztürk about it", "H. Öztürk"), ("ask marta łuczak about it", "marta łuczak")):
        assert ("NAME", span) in {(k, text[a:b]) for k, a, b, _ in pii.candidates(text, flag)}


def test_no_name_is_lost_beyond_the_lexicon_sent(spark, monkeypatch):
    rows, _ = corpus(60)
    own = [("documents", 1000 + i, t) for i, t in enumerate(("It is by R. Ulmveld, they say.", "ask Yarrova, Z. about it", "ask zerelle brimsley about it"))]
    texts = spark.createDataFrame(rows + own, TEXT)
    key = lambda: {tuple(r)[:5] for r in pii.find_mentions(texts).collect()}
    whole = key()
    assert {r[1] for r in whole if r[2] == "NAME"} >= {1000, 1001, 1002}
    monkeypatch.setattr(pii, "LEXICON", 1)
    assert pii.learn_lexicon(texts)[2].count() > 0 and key() == whole

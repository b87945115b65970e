"""Personal information in free text, by weak supervision.

1. Names need a lexicon that no list can hold. Every pair of capitalised words of
   the corpus is voted on by a gazetteer of given names, by the words around it and
   by its use as a code name; expectation-maximisation over the counts of vote
   patterns gives each pattern a probability, and averaging these over a word's
   pairs gives the given names and surnames of this corpus.
2. Regular expressions and the lexicon propose candidates of all types in every
   text, each with the votes of the labelers of its type.
3. EM over the vote patterns of a type estimates how reliable each labeler is, and
   so a probability for each pattern.
4. A logistic model of votes, shape, letter groups and context words, trained on
   these probabilities, decides about every candidate.

Texts are read twice where they lie and never shuffled; what is exchanged are
counts of words and patterns, aggregated before every shuffle, and candidates.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.sources.shared import kept, spread

TYPES = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
#: Candidates that the span model is trained on, at most about this many for all types.
TRAINED_ON = 30_000
#: Words of the learned lexicon that are sent to all workers, the most frequent first; rarer ones are joined to the texts that hold them.
LEXICON = 200_000
DIMS = 1 << 13

# Common given names of several languages.
GIVEN = frozenset(
    """adam ahmed aisha alan alba albert alessandro alexander alice alina amara amelia amina ana andrea andreas andrew angela anita anna anne antonio arjun
    astrid barbara beatrice ben bianca brenna bruno camille carla carlos carmen caroline catherine charles chiara chloe chris christian claire clara claudia
    daniel david diana diego dmitri elena elisa elizabeth ella emil emily emma enrico eric erik eva fatima felix fernando francesca frank gabriel george
    giulia grace greta hanna hannah hans helen helena henrik hugo ibrahim ines ingrid ioana irene isabel ivan jack jacob jakob james jan jane javier jean
    jennifer john jonas jorge jose joseph juan julia julian karen karim karl katarina kenji laila lars laura lea leila lena leo lina linda lisa louis
    luca lucia luis lukas maeve magda marc marco margaret maria marie mario mark marta martin mary matteo maya mehmet michael miguel mina miriam mirko
    mohamed monica nadia natalia nicolas nina noah nora olga oliver omar oscar pablo patricia paul paula pedro peter philip pierre pietro priya rachel
    rafael raj rebecca richard robert roberto rosa ruth saanvi samuel sandra sara sarah sebastian sofia sophie stefan stephen susan sven tanja teresa thomas
    tomas ursula valentina vera victor viktor vincent wei william yasmin yuki yusuf zoe""".split()
)
# Words that stand before a person, and before things.
PERSON_BEFORE = re.compile(
    r"(?:\b(?:author|from|signed-off-by|reviewed by|interviewed|cc|contact|ask|ask for|thanks to|according to|laut|secondo|según|selon|d'après|sentire|reach|regards,|grüße,?|saluti,?|cordialement,?|saludos,?"
    r"|(?:number|address|e-?mail|account) of|goes to|(?:sent?d?|ship(?:ped)?|deliver(?:ed)?|handed|given?|assigned|forwarded) (?:\S+ ){0,3}to|applicant|ansprechp(?:erson|artner(?:in)?)(?: ist)?|contacto(?: es)?|chez|zu händen|z\. ?hd\.|atención de|attn|attention"
    r"|(?:spedire|inviare|scrivere|chiedere) a|list|on (?:file|record)|owner|reporter|name|fyi|contact person|mr|mrs|ms|dr|prof|frau|herr|sig|mme|señora?|доктор|господин|госпожа|автор|контакт)"
    r"\s*[:：=.]?[\"']*\s*[:=]?\s*[\"'(]?\s*|(?:連絡先|担当者?|氏名|名前|作成者|宛先)：|（)$",
    re.I,
)
THING_BEFORE = re.compile(r"\b(?:in|into|with|both|via|inside|see|use|restart|function|renamed|dans|en|nel|open|called|cluster|at|on|than|about|between|of the)\s+$", re.I)
PERSON_AFTER = re.compile(
    r"^(?:\s*<|['’]s (?:badge|laptop|account|desk|e-?mail|phone|office|calendar|manager|team|number|birthday|shift)|\s+(?:owns|left|wants|said|says|asked|joined|wrote|writes|called|replied|confirmed|agreed|suggested|works|lives|reported|noted)\b"
    r"|,? (?:tel|tél|phone)|,? [(（]?[+0(]\d|\s?[(（][\w.+-]+ ?[@＠(\[]| \| )",
    re.I,
)
PARTICLES = frozenset(("von", "van", "de", "di", "the", "and"))


def _letters(kind: Callable[[str], bool]) -> str:
    """The ranges of a character class of all letters of a kind."""
    at = [i for i in range(0x10000) if kind(chr(i)) and chr(i).isalpha()]
    starts, ends = [i for i, j in zip(at, [-1, *at]) if i != j + 1], [i for i, j in zip(at, [*at[1:], -1]) if j != i + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


_UP, _LOW = _letters(str.isupper), _letters(str.islower)
PAIR = re.compile(rf"(?<![\w-])(?=([{_UP}][{_LOW}]+)(?: [{_UP}]\.)? ((?:[vV]on )?(?:[OD]['’])?[{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)?)(?![\w-]))[{_UP}]")
# Words and identifiers; what goes on after a dot, a sign or an underscore is an address or a file name and says nothing.
TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*(?:[@＠.+_]\w)?")
CAMEL = re.compile(r"[a-z]+(?:[A-Z][a-z]{2,}){1,4}")

_DOT = r"(?:[.．]|\s?[(\[{]\s?dot\s?[)\]}]\s?|\s+dot\s+)"
_HOST = rf"[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+"
EMAIL = re.compile(rf"(?<![\w@/.+-])([^\W_][\w.%+'-]*(?:\s+dot\s+[\w+-]+)*?)(\s?[@＠]\s?|\s?[(\[{{]\s?at\s?[)\]}}]\s?|\s+at\s+(?=[\w-]+\s+dot\s))({_HOST})", re.I)
DIGITS = re.compile(r"(?<![\w.:/#-])(?:[+＋]\s?|\((?=\d{2,4}\)))?\d(?:[\d().\-/   ‑–]*\d)?(?![\w])")
DATE = re.compile(r"(?<!\d)(?:\d{4}([-./])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2\d{4})(?!\d)")
DIGIT_RUN = re.compile(r"(?:[+＋]\s?)?(?:\((?=\d+\)))?\d+\)?")
CODES = (re.compile(r"[A-Z]{1,6}[ -]?\d[0-9A-Z -]{4,14}[0-9A-Z](?![\w-])"), re.compile(r"(?=\d{8})(?<!\d)\d{8}[ -]?[A-Z](?![\w-])"))
CODE_SHAPES = re.compile(r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D]|[XYZKLM][ -]?\d{7}[ -]?[A-Z]|[A-Z]{1,2}\d{7,9}|\d{8}[ -]?[A-Z]")
_NUMBER = r"\d{1,4}(?:\s?(?:bis|ter|quater)\b|[a-zA-Z]\b)?"
_CAP = r"[A-ZÀ-Þ][\w'’.-]*"
NUMBER_FIRST = re.compile(
    rf"(?=\d)(?<![\w-])(?:{_NUMBER},?\s(?:{_CAP}\s){{1,3}}(?:Lane|Road|Street|Avenue|Terrace|Drive|Close|Court|Crescent|Square|Boulevard|Parkway|Way|Walk|Place|Grove|Gardens|Mews|Highway|Circle|(?:St|Ave|Blvd|Rd|Ln|Dr)\b\.?)"
    rf"|{_NUMBER},?\s(?:rue|avenue|chemin|boulevard|place|allée|quai|impasse|route|square|cours)\s(?:de\sla\s|de\sl['’]|des\s|du\s|de\s|d['’])?{_CAP})"
)
STREET_FIRST = re.compile(
    r"(?<![\w-])(?:(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig)|(?:Am|An\sde[rn]|Auf\sde[rm]|Im|In\sde[rn]|Zum|Zur|Unter\sden|Alte[rs]?|Neue[rs]?|Obere|Untere|Große|Kleine)\s[A-ZÄÖÜ][\wäöüß-]+)\s\d{1,4}\s?[a-z]?\b"
    r"|(?:ул\.|улица|проспект|пер\.|[Uu]l\.|[Uu]lica)\s[^\W\d_][\w-]+,?\s(?:д\.\s)?\d{1,4}\b|[A-Z][a-z]+(?:straat|laan|plein|gracht|kade)\s\d{1,4}\s?[a-z]?\b"
    r"|(?:Via|Viale|Piazza|Corso|Vicolo|Largo|Calle|Paseo|Avenida|Plaza|Camino|Carrera|Ronda|Rua|Travessa)\s(?:[\w'’.]+\s){1,4}?\d{1,4}\b"
    r"|(?:P\.?\s?O\.?\s?Box|Postfach|Casella\spostale|Apartado(?:\sde\scorreos)?|Boîte\spostale)\s\d+)"
)
# A street without a number: rather the name of something else.
BARE_STREET = re.compile(rf"(?<![\w-])(?:{_CAP}\s){{1,2}}(?:Street|Road|Lane|Avenue)\b")
BARE_WORDS = (" Street", " Road", " Lane", " Avenue")
# What may follow: flat, postal code and place.
TAIL = re.compile(r"(?: [A-ZÀ-Þ][\w'’-]+(?=,))?(?:,\s(?:Apt\.?\s\w+|\d+\.º\s\w))?(?:(?:,\s|\n)(?:\d{5}\s[A-ZÀ-Þ][\w'’-]+|[A-ZÀ-Þ][\w'’-]+\s\d{5})|,\s[A-ZÀ-Þ][\w'’-]+)?")
# The street words of NUMBER_FIRST; and words of which one stands in everything that STREET_FIRST finds.
STREET_WORDS = frozenset("Lane Road Street Avenue Terrace Drive Close Court Crescent Square Boulevard Parkway St Ave Blvd Rd Ln Dr".split())
STREET_STARTS = tuple("straße|strasse|str. |weg |gasse |platz |allee |ring |damm |ufer |steig |Am |An de|Auf de|Im |In de|Zu|Unter|Alte|Neue|Obere|Große|Kleine|Via|Piazza|Corso|Vicolo|Largo|Calle|Paseo|Avenida|Plaza|Camino|Carrera|Ronda|Rua|Travessa|ул. |улица |проспект |пер. |Ul. |ul. |Ulica |ulica |straat |laan |plein |gracht |kade |Box |Postfach|Casella|Apartado|Boîte".split("|"))
# What stands in everything that STREET_FIRST finds: a blank of any kind before a number, after a letter or another sign of its words.
STREET_QUICK = re.compile(r"[\w'’.,-]\s\d")
# The words of which one stands in everything that NUMBER_FIRST finds, each after a blank of any kind; the short ones end there.
NUMBER_WORDS = "Lane Road Street Avenue Terrace Drive Close Court Crescent Square Boulevard Parkway Way Walk Place Grove Gardens Mews Highway Circle rue avenue chemin boulevard place allée quai impasse route square cours".split()
NUMBER_SHORT = "St Ave Blvd Rd Ln Dr".split()
# A quick look for digits near each other: what may stand between the digits of a number is taken out, and all else is one sign.
_BETWEEN = b" ().-/ABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256))
_AS_DIGITS = bytes(48 if 48 <= c <= 57 else 120 for c in range(256))
OTHER_DIGITS = re.compile("[" + "".join(c for c in map(chr, range(128, 0x10000)) if re.match(r"\d", c)) + "]")
SPACES = [c for c in map(chr, range(0x3001)) if re.match(r"\s", c)]
# Names and addresses of scripts that write words without blanks or capitals. A name needs a word of address after it or a label before it.
HAN = "\u3400-\u4dbf\u4e00-\u9fff々"
EAST = re.compile(f"[{HAN}\u30a1-\u30fa]{{2}}")
EAST_LABEL = re.compile(r"(?:担当者?|氏名|名前|連絡先|作成者|宛先|報告者|申請者|承認者|著者)[はが]?[:：]?\s*[（「]?$")
EAST_NAME = re.compile(f"(?<![{HAN}])(?:[{HAN}]{{1,4}}[ \u3000][{HAN}\u3041-\u3096\u30a1-\u30fa]{{1,5}}?|[{HAN}]{{4}}|[\u30a1-\u30fa\u30fc]{{2,10}}・[\u30a1-\u30fa\u30fc]{{2,10}})(?=\\s?(さん|さま|様|氏|先生|殿)|[^{HAN}\u3041-\u3096\u30a1-\u30fa\u30fc]|$)")
EAST_OFFICE = re.compile("[者部課社店局係長員]$")
EAST_ADDRESS = re.compile(f"(?:〒\\s?\\d{{3}}-\\d{{4}}\\s?)?(?:東京都|北海道|京都府|大阪府|[{HAN}]{{2,3}}県)[{HAN}\u3041-\u3096\u30a1-\u30fa\u30fc]{{1,24}}?\\d+(?:(?:丁目|番地?|号|[-−‐－の])\\d*)*")
EAST_PLACE = re.compile(r"(?:住所|所在地|宛先|届け先|送付先)[はが]?[:：]?\s*$")
POSTCODE = re.compile(r"^[,\s]{0,3}(?:[^\n,]{0,12},\s)?(?:\d{5}\b|[A-ZÀ-Þ][\w'’-]+(?: [A-Z]\w+)?(?:\s\d{5}\b|[.,\n]|\s))")
WORD = re.compile(r"(?:[OoDd]['’])?[^\W\d_]+(?:[-][^\W\d_]+)*")
NOT_PHONE = re.compile(r"\d{4}-\d{2}-\d{2}|(?:\d{1,3}\.){3}\d{1,3}$|\d{1,2}[./]\d{1,2}[./]\d{4}$|\d{4}\.\d|\d+[.,]\d+$")
PHONE_WORDS = re.compile(r"(?:call|tel|tél|phone|ring|text|sms to|reach|number|numero|número|numéro|telefono|telefon|fax|mobil|cell|find|電話|\bat|to=|on file)\W*(?:[\w'’.\-]+,? ){0,4}\W*$", re.I)
ID_WORDS = re.compile(r"\b(?:id|ssn|passport|tax|insurance|national(?:_id)?|ausweis|personalausweis|steuer\w*|codice fiscale|documento|identidad|identité|sozialversicherung\w*|versicherung\w*|personal number|nif|nie|dni|badge|social security)\b(?:(?<=n[ro])\.|_id\b|[^.\n;|]){0,24}$", re.I)
THING_WORDS = re.compile(r"(?:order|checksum|build|trace|commit|revisions?|lines?|version|retry|batch|ticket|rev|offset|depth|limit|width|total|score|weight|budget|port|issue|page|step|lane|after)\W*$", re.I)
PLACE_WORDS = re.compile(
    r"(?:invoice to|visit us at|office is at|moved (?:from|to)|lives? (?:at|in)|\b(?:to|chez) [^\n,]{2,40},|lieferadresse:|\b(?:ship|send|sent|deliver(?:ed)?|spedire|inviare|envoyer|liefern|enviar) (?:\S+ ){0,2}(?:to|a|à|an|chez) (?:[^\n]{2,40},)?"
    r"|address:?|indirizzo:?|dirección:?|adresse:?|адрес:?|on (?:file|record): [^\n]{2,60},|\baddr(?:ess)?\w*\s?[=:]\s?[\"']?|\n)\s*$",
    re.I,
)
CODE_NAME = re.compile(r"^[^\n.]{0,12}\b(?:is|was) (?:only |just )?(?:the |a |an )?(?:code ?name|name of|cluster|project|branch)", re.I)


ACCENTS = re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if unicodedata.combining(c)) + "]+")


def plain(word: str) -> str:
    """Lower case without accents."""
    return word.lower() if word.isascii() else without_accents(word.lower())


def without_accents(text: str) -> str:
    """A text as ``plain`` leaves its words, but in its own case."""
    return text if text.isascii() else ACCENTS.sub("", unicodedata.normalize("NFKD", text.replace("ø", "o").replace("Ø", "O")))


def surname_parts(word: str) -> list[str]:
    """The words of a surname without particles: ``von Wex-Ulm`` has two."""
    return [p for w in plain(word).replace("’", "'").removeprefix("von ").split("-") if (p := w.removeprefix("o'").removeprefix("d'"))]


# The last words of what stands before persons: a quick look that spares most searches.
_PERSON_LAST = frozenset(
    "author from signed-off-by by interviewed cc contact ask for to laut secondo según selon d'après sentire reach regards, grüße grüße, saluti saluti, cordialement cordialement, saludos saludos, of applicant ist es contacto ansprechperson ansprechpartner ansprechpartnerin chez händen hd de attn attention a list file record owner reporter name fyi person mr mrs ms dr prof frau herr sig mme señor señora доктор господин госпожа автор контакт".split()
)


def person_before(before: str) -> bool:
    tail = before.rstrip(" \t\n\r\u00a0\u202f\"'(:：=.")
    word = tail[max(tail.rfind(" "), tail.rfind("\n")) + 1 :].lstrip("{\"'(|[<,;#/").lower()
    if word not in _PERSON_LAST and not any(word.endswith(w) for w in ("author", "contact", "from", "name", "reporter", "owner", "by", "先", "当", "者", "名", "前", "（")):
        return False
    return PERSON_BEFORE.search(before) is not None


def vote(*values: int) -> str:
    return "".join("-0+"[v + 1] for v in values)


# 1. The lexicon


def name_pairs(text: str) -> Iterator[tuple[str, str, str]]:
    """(first word, last word, votes) of the capitalised pairs of a text."""
    for m in PAIR.finditer(text):
        first, last = plain(m.group(1)), "-".join(surname_parts(m.group(2)))
        if first in PARTICLES or not last:
            continue
        if last in GIVEN:  # of two given names the second will come with the surname; this one counts against the first word
            last = ""
        a, b = m.start(), m.end(2)
        before = text[max(0, a - 30) : a]
        person, thing = person_before(before), THING_BEFORE.search(before)
        yield first, last, vote(
            1 if first in GIVEN else 0,
            1 if person else -1 if thing else 0,
            1 if PERSON_AFTER.search(text[b : b + 24]) else 0,
            -1 if before[-2:-1].isdigit() or m.group(2) in STREET_WORDS else 0,
        )


def word_uses(tokens: Counter) -> Counter:
    """Counts of (word, use): a part of an identifier such as fable-anchor or scanFableAnchor, or an ordinary lower-case word."""
    uses: Counter = Counter()
    for t, n in tokens.items():
        if not t[0].islower() or not t.isascii() and not t.isalpha() or t[-2:-1] in ("@", "＠", ".", "+", "_"):
            continue
        if t.islower():
            parts = t.split("-")
            for w in parts:
                uses[w, "lower" if len(parts) == 1 else "code"] += n
        elif CAMEL.fullmatch(t):
            for w in re.findall(r"[A-Z][a-z]+", t):
                uses[w.lower(), "code"] += n
    return uses


def em(patterns: dict[str, float], rounds: int = 60) -> dict[str, float]:
    """The probability of each vote pattern, by expectation-maximisation over the patterns' counts.

    Each labeler votes +, - or nothing with probabilities of its own for true and for false candidates (smoothed, so
    that no pattern is impossible); votes are independent given the truth. The start trusts every labeler moderately.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    count = np.array([patterns[p] for p in names], float)
    votes = np.array([["-0+".index(c) for c in p] for p in names])
    n = votes.shape[1]
    # the start: a majority of the votes, weakly; without any vote rather not
    p = 1 / (1 + np.exp(1 - 1.2 * (votes - 1).sum(1)))
    for _ in range(rounds):
        prior = (count @ p + 1) / (count.sum() + 2)
        true, false = np.full(len(names), np.log(prior)), np.full(len(names), np.log(1 - prior))
        for j in range(n):
            t, f = np.full(3, 0.5), np.full(3, 0.5)
            np.add.at(t, votes[:, j], count * p)
            np.add.at(f, votes[:, j], count * (1 - p))
            t, f = t / t.sum(), f / f.sum()
            # a vote may be worthless, but never speaks for its opposite
            for c, (more, less) in ((2, (t, f)), (0, (f, t))):
                if more[c] < less[c]:
                    more[c] = less[c] = (more[c] + less[c]) / 2
            true += np.log(t[votes[:, j]])
            false += np.log(f[votes[:, j]])
        p = 1 / (1 + np.exp(np.clip(false - true, -50, 50)))
    return dict(zip(names, p.tolist()))


def learn_lexicon(texts: DataFrame) -> tuple[frozenset[str], frozenset[str], DataFrame | None]:
    """The given names and surnames of a corpus (tbl, row_id, text), of each the LEXICON most frequent, and the rest as (word, is_surname), if any.

    A pair counts once for each distinct text it stands in.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            seen: Counter = Counter()
            tokens: Counter = Counter()
            for t, digest in zip(f["text"], f["digest"]):
                seen.update((*pair, digest) for pair in name_pairs(t))
                tokens.update(TOKEN.findall(t))
            rows = [(a, b, v, d, n) for (a, b, v, d), n in seen.items()] + [(w, use, "", 0, n) for (w, use), n in word_uses(tokens).items()]
            yield pd.DataFrame(rows, columns=["first", "last", "votes", "digest", "uses"])

    counted = texts.select("text", F.xxhash64("text").alias("digest")).mapInPandas(count, "first string, last string, votes string, digest bigint, uses bigint")
    counted = kept(counted.groupBy("first", "last", "votes", "digest").agg(F.sum("uses").alias("uses")).groupBy("first", "last", "votes").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("n")))
    pairs = counted.where("votes <> ''").withColumn("word", F.element_at(F.split("last", "-"), -1))
    # a word is part of the code's names, or an ordinary word, if it stands there more often than in pairs
    own = pairs.select("uses", F.explode(F.array("first", "word")).alias("w")).groupBy("w").agg(F.sum("uses").alias("paired"))
    use = counted.where("votes = ''").groupBy("first").agg(F.sum(F.when(F.col("last") == "code", F.col("uses"))).alias("code"), F.sum(F.when(F.col("last") == "lower", F.col("uses"))).alias("lower"))
    use = own.join(use, own["w"] == use["first"]).select("w", (F.col("code") * 4 > F.col("paired")).alias("is_code"), (F.col("lower") > F.col("paired")).alias("is_lower"))
    a, b = (use.select(F.col("w").alias(k), F.col("is_code").alias("c" + k), F.col("is_lower").alias("l" + k)) for k in ("first", "word"))
    minus = lambda x, y: F.when(F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)), "-").otherwise("0")
    pairs = pairs.join(a, "first", "left").join(b, "word", "left")
    pairs = kept(pairs.select("first", "last", F.concat("votes", minus(F.col("cfirst"), F.col("cword")), minus(F.col("lfirst"), F.col("lword"))).alias("votes"), "n", "uses"))
    found = em({r[0]: r[1] for r in pairs.where("last <> ''").groupBy("votes").agg(F.sum("n")).collect()})  # at most 3 ** 6 patterns
    if not found:
        return GIVEN, frozenset(), None
    spark = texts.sparkSession
    every = pairs.join(F.broadcast(spark.createDataFrame(list(found.items()), "votes string, p double")), "votes", "left")
    scored = every.where("last <> ''")
    lasts = scored.select(F.explode(F.split("last", "-")).alias("word"), "first", "n", "p").groupBy("word").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("mean"))
    surnames = lasts.where("mean >= 0.5")
    # not what stands first more often than last: a second given name
    fronts = scored.groupBy(F.col("first").alias("word")).agg(F.sum(F.col("n") * F.col("p")).alias("front"))
    surnames = kept(surnames.join(fronts, "word", "left").where("coalesce(front, 0) <= n * mean").select("word", "n"))
    # a given name stands before surnames: those found, whatever is around this pair
    known = every.withColumn("p", F.when(F.col("last") == "", 0.0).otherwise(F.col("p"))).withColumn("word", F.element_at(F.split("last", "-"), 1)).join(surnames.select("word", F.lit(1.0).alias("sure")), "word", "left")
    firsts = known.groupBy("first").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses"), (F.sum(F.col("n") * F.coalesce("sure", F.col("p") * 0.5)) / F.sum("n")).alias("mean"))
    firsts = kept(firsts.where("mean >= 0.6 and uses >= 2").select(F.col("first").alias("word"), "n"))
    tops, rest = [], None
    for is_surname, words in enumerate((firsts, surnames)):
        rows = words.orderBy(F.desc("n"), "word").limit(LEXICON + 1).collect()
        tops.append(frozenset(r["word"] for r in rows[:LEXICON]))
        if len(rows) > LEXICON:
            n, word = rows[LEXICON - 1]["n"], rows[LEXICON - 1]["word"]  # the last that is sent
            more = words.where((F.col("n") < n) | (F.col("n") == n) & (F.col("word") > word)).select("word", F.lit(bool(is_surname)).alias("is_surname"))
            rest = more if rest is None else rest.union(more)
    return GIVEN | tops[0], tops[1], rest


def with_rare_words(texts: DataFrame, rest: DataFrame) -> DataFrame:
    """Texts with the rare names (rare_given, rare_surnames) that stand in them: a join of their words with the lexicon's rest."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for tbl, row, t in zip(f["tbl"], f["row_id"], f["text"]):
                words = set(WORD.findall(t))
                rows += [(tbl, row, w, True) for w in {p for x in words for p in surname_parts(x)}] + [(tbl, row, w, False) for w in set(map(plain, words))]
            yield pd.DataFrame(rows, columns=["tbl", "row_id", "word", "is_surname"])

    words = texts.mapInPandas(split, "tbl string, row_id bigint, word string, is_surname boolean")
    own = words.join(rest, ["word", "is_surname"]).groupBy("tbl", "row_id")
    own = own.agg(*(F.collect_set(F.when(F.col("is_surname") == s, F.col("word"))).alias(c) for s, c in ((False, "rare_given"), (True, "rare_surnames"))))
    at = [texts[c].eqNullSafe(own[c]) for c in ("tbl", "row_id")]
    return texts.join(own, at, "left").select(texts["tbl"], texts["row_id"], texts["text"], "rare_given", "rare_surnames")


# 2. Candidates


# Capitalised words before a surname that are no given names.
NOT_GIVEN = frozenset(
    """mr mrs ms miss dr prof professor frau herr sig signora signor mme mlle madame monsieur señor señora don doña dear hi hello hallo ciao hola bonjour the a an and or by from to for
    ask cc with of in on at is was please thanks contact regards grüße saluti saludos cordialement author owner reporter reviewer name family team von van de di la le der die das und e y et el""".split()
)


def _may_be_given(word: str, flags: tuple[bool, bool]) -> bool:
    return len(word) > 2 and word[0].isupper() and word[1:].islower() and word.isalpha() and not any(flags) and word.lower() not in NOT_GIVEN


def _names(text: str, flag: Flags, taken: list[tuple[int, int]]) -> Iterator[tuple]:
    """Given name or initial with a surname, in either order, in any case.

    The first pair of capitalised words of which neither is in the lexicon is proposed too: it shows EM what no name looks like.
    """
    counter = next((m for m in PAIR.finditer(text) if not any(flag[m.group(1)]) and not any(flag[m.group(2)])), None)
    if counter and not any(counter.start() < e and s < counter.end(2) for s, e in taken):
        a, b = counter.start(), counter.end(2)
        person, thing = person_before(text[max(0, a - 40) : a]), THING_BEFORE.search(text[max(0, a - 40) : a])
        yield "NAME", a, b, vote(-1, -1, 1 if person else -1 if thing else 0, 1 if PERSON_AFTER.search(text[b : b + 24]) else 0, 1, 0)
    tokens = [(m.group(), m.start(), m.end()) for m in WORD.finditer(text)]
    n = len(tokens)
    flags = [flag[w] for w, _, _ in tokens]
    used = -1
    for i, (w, a, b) in enumerate(tokens):
        is_given, is_surname = flags[i]
        if a < used or not (is_given or is_surname or len(w) == 1 or w in ("von", "Von", "VON")):
            continue
        initial = len(w) == 1 and w.isupper() and text[b : b + 1] == "."
        last = None
        kind = 0
        if is_given or initial:
            j, at = i + 1, b + initial
            if j < n and text[at : tokens[j][1]] in (" ", " ", "\n"):
                w2, _, b2 = tokens[j]
                # something in the middle: an initial or a second given name
                if is_given and j + 1 < n and (len(w2) == 1 and w2.isupper() and text[b2 : b2 + 1] == "." or flags[j][0] and not flags[j][1]):
                    dot = len(w2) == 1
                    if text[b2 + dot : tokens[j + 1][1]] in (" ", " ", "\n"):
                        j += 1
                if j + 1 < n and tokens[j][0].lower() in ("von", "van", "de", "di") and text[tokens[j][2] : tokens[j + 1][1]] == " ":
                    j += 1
                w2 = tokens[j][0]
                if flags[j][1] or is_given and w2[:1].isupper() and len(w2) > 1 and not flags[j][0] and (w[:1].isupper()):
                    last, kind = j, 1
        if last is None and (is_surname or w.lower() == "von" and i + 1 < n and flags[i + 1][1]):
            j = i + (w.lower() == "von" and not is_surname)
            e = tokens[j][2]
            if j + 1 < n and re.fullmatch(r",[  ]", text[e : tokens[j + 1][1]]) and (flags[j + 1][0] or len(tokens[j + 1][0]) == 1 and text[tokens[j + 1][2] : tokens[j + 1][2] + 1] == "."):
                # the word before must not make this the end of another name
                last, kind = j + 1, 2
        if last is None and is_surname and i and _may_be_given(tokens[i - 1][0], flags[i - 1]) and text[tokens[i - 1][2] : a] == " " and w[:1].isupper() and tokens[i - 1][1] >= used:
            # a surname of the lexicon after a capitalised word that it does not know
            i, a, last = i - 1, tokens[i - 1][1], i
        if last is None:
            continue
        end = tokens[last][2]
        if any(a < e and s < end for s, e in taken):
            continue
        used = end
        sure = any(flags[k][1] for k in range(i, last + 1))
        first_given = any(flags[k][0] for k in range(i, last + 1)) or initial
        before, after = text[max(0, a - 40) : a], text[end : end + 24]
        span = text[a:end]
        person, thing = person_before(before), THING_BEFORE.search(before)
        yield (
            "NAME",
            a,
            end,
            vote(
                1 if first_given else 0,
                1 if sure else -1,
                1 if person else -1 if thing else 0,
                1 if PERSON_AFTER.search(after) else 0,
                1 if span.istitle() or span.isupper() else 0 if kind == 2 or "'" in span or not span.islower() else -1,
                -1 if re.match(r"[-_/]\w|\.\w", after) or re.search(r"[\w][-_/.]$|[@#/]$", before) else 0,
            ),
        )


class Flags(dict):
    """word -> (is a given name, is a surname), remembered."""

    def __init__(self, given: frozenset, surnames: frozenset):
        self.given, self.surnames = given, surnames
        # a name needs a surname in any case, or a given name that begins with a capital
        self.names = ahocorasick.Automaton()
        for w in given | surnames:
            self.names.add_word(w, (len(w), w not in surnames))
        self.names.make_automaton()
        self.automaton = ahocorasick.Automaton()
        for w in STREET_STARTS:
            for c in SPACES if " " in w else " ":
                self.automaton.add_word(w.replace(" ", c), "street")
        for w in BARE_WORDS:
            self.automaton.add_word(w, "bare")
        for w in (*NUMBER_WORDS, *NUMBER_SHORT):
            for c in SPACES:
                if (found := c + w) in self.automaton:  # one of BARE_WORDS
                    self.automaton.add_word(found, "both")
                else:
                    self.automaton.add_word(found, "number" if w in NUMBER_WORDS else "short")
        self.automaton.make_automaton()

    def beside(self, given: Iterable[str], surnames: Iterable[str]) -> RareFlags:
        return RareFlags(self, frozenset(given), frozenset(surnames))

    def hints_at_name(self, text: str) -> bool:
        """Whether a text holds a word of the lexicon, with or without its accents; a quick look at letters, not at words."""
        own = without_accents(text)
        low = own.lower()
        for end, (n, capital) in self.names.iter(low):
            start = end - n + 1
            # words of two letters stand within most others
            if n < 3 and (low[start - 1 : start].isalpha() or low[end + 1 : end + 2].isalpha()):
                continue
            if not capital or own[start].isupper():
                return True
        return False

    def __missing__(self, word: str) -> tuple[bool, bool]:
        out = plain(word) in self.given, any(p in self.surnames for p in surname_parts(word))
        if len(self) < 500_000:
            self[word] = out
        return out


_KNOWN: dict[str, Flags] = {}


def _flags(mark: str, given: frozenset, surnames: frozenset) -> Flags:
    """The flags of one lexicon, built once in each worker process and kept until another lexicon is asked for."""
    if mark not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[mark] = Flags(given, surnames)
    return _KNOWN[mark]


class RareFlags(dict):
    """Flags with the rare names of one text."""

    def __init__(self, flags: Flags, given: frozenset, surnames: frozenset):
        self.flags, self.given, self.surnames, self.automaton = flags, given, surnames, flags.automaton

    def __missing__(self, word: str) -> tuple[bool, bool]:
        given, surname = self.flags[word]
        self[word] = given or plain(word) in self.given, surname or any(p in self.surnames for p in surname_parts(word))
        return self[word]


def shape(s: str, n: int) -> tuple[bool, bool, bool]:
    """(international prefix, shape of an identity number, national shape) of a digit group of n digits."""
    prefix = s[0] in "+＋" or n >= 11 and bool(re.match(r"00[1-9]", s))
    id_shape = bool(re.fullmatch(r"\d{3}([- ])\d{2}\1\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{11}|\d{8,10}", s))
    national = not id_shape and bool(re.fullmatch(r"(?:\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0[1-9]\d{0,3}[ /-]?[\d -]{6,12}|\d{3} \d{3} \d{4})", s))
    return prefix, id_shape, national


def has_number(text: str) -> bool:
    """Whether six digits may belong together; no number of a person has fewer. A look at bytes, which spares most searches."""
    if b"000000" in text.encode("utf-8", "surrogatepass").translate(_AS_DIGITS, _BETWEEN):
        return True
    return not text.isascii() and OTHER_DIGITS.search(text) is not None


def digit_groups(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of the groups of 8 to 15 digits.

    A longer one is several: its dates are taken out, and the rest is cut at separators so that parts of a known shape cover
    most digits, then any parts. A run of digits is never cut.
    """
    for m in DIGITS.finditer(text):
        if m.end() - m.start() < 8:
            continue
        n = sum(map(str.isdigit, m.group()))
        if n <= 15:
            if n >= 8:
                yield m.start(), m.end(), n
            continue
        at = m.start()
        for a, b in [*((d.start(), d.end()) for d in DATE.finditer(text, m.start(), m.end())), (m.end(), m.end())]:
            yield from _parts(text, [(r.start(), r.end()) for r in DIGIT_RUN.finditer(text, at, a)])
            at = b


def _parts(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The parts of 8 to 15 digits of consecutive runs of digits, by dynamic programming."""
    best: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)]  # value, the runs before the last part, the last part
    for j in range(len(runs)):
        value, back, part = best[j][0], j, None
        n = 0
        for i in range(j, -1, -1):
            n += sum(map(str.isdigit, text[runs[i][0] : runs[i][1]]))
            if n > 15:
                break
            if n >= 8:
                a, b = runs[i][0], runs[j][1] - (text[runs[j][1] - 1] == ")")
                gain = best[i][0] + n * (1 if any(shape(text[a:b], n)) else 0.1) - 0.01
                if gain > value:
                    value, back, part = gain, i, (a, b, n)
        best.append((value, back, part))
    out, j = [], len(runs)
    while j:
        _, j, part = best[j] if best[j][2] else (0, j - 1, None)
        out += [part] if part else []
    return out[::-1]


def candidates(text: str, flag: Flags, rare: bool = False) -> list[tuple[str, int, int, str]]:
    """(type, start, end, votes) of everything in a text that may be personal. rare: it is known to hold a name of the lexicon."""
    hints = set()
    for end, kind in flag.automaton.iter(text):
        if kind == "both":
            hints.update(("bare", "number"))
        elif kind != "short":
            hints.add(kind)
        elif not (text[end + 1 : end + 2].isalnum() or text[end + 1 : end + 2] == "_"):
            hints.add("number")
    numbers = has_number(text)
    out: list[tuple[str, int, int, str]] = []
    taken: list[tuple[int, int]] = []
    lowered = text.lower()
    if "@" in text or "＠" in text or "at)" in lowered or "at]" in lowered or " dot " in lowered or "at }" in lowered or "at}" in lowered or "at )" in lowered:
        for m in EMAIL.finditer(text):
            local, at, host = m.groups()
            a, b = m.span()
            if local.lower().startswith("mailto:"):
                a += 7
            labels = re.split(_DOT, host, flags=re.I)
            after = text[b : b + 2]
            remote = local.lower() in ("git", "svn", "hg", "ssh") or after[:1] == ":" and after[1:2].strip() != "" and not after[1:2].isdigit()
            plain_sign = at.strip() in "@＠"
            out.append(
                (
                    "EMAIL",
                    a,
                    b,
                    vote(
                        1 if labels[-1].isalpha() and 2 <= len(labels[-1]) <= 12 else -1,
                        -1 if remote else 1,
                        1 if re.search(r"(?:mailto:|<|\bto |cc |an |mail|[(|;,\"]\s?)$", text[max(0, a - 8) : a], re.I) else 0,
                        1 if plain_sign else 0 if len(labels) > 1 else -1,
                        -1 if re.search(r"(?:://|@)$", text[max(0, a - 3) : a]) or "/" in after else 0,
                    ),
                )
            )
            taken.append((a, b))
    for m in chain(*(c.finditer(text) for c in CODES)) if numbers else ():
        m = CODE_SHAPES.match(text, m.start()) if not re.match(r"[\w-]", text[m.start() - 1 : m.start()] if m.start() else "") else None
        if not m or re.match(r"[\w-]", text[m.end() : m.end() + 1]):
            continue
        a, b = m.span()
        if any(a < e and s < b for s, e in taken):
            continue
        before = text[max(0, a - 40) : a]
        out.append(("ID", a, b, vote(1 if ID_WORDS.search(before) else -1 if THING_WORDS.search(before) else 0, 1, 0, -1 if re.match(r"[-_/.]\w", text[b : b + 2]) else 1)))
        taken.append((a, b))
    for a, b, n in digit_groups(text) if numbers else ():
        s = text[a:b]
        if any(a < e and x < b for x, e in taken):
            continue
        before, after = text[max(0, a - 40) : a], text[b : b + 12]
        id_said, phone_said, thing = ID_WORDS.search(before), PHONE_WORDS.search(before), THING_WORDS.search(before)
        dated = NOT_PHONE.match(s)
        prefix, id_shape, national = shape(s, n)
        if not (prefix or national or id_shape or id_said or phone_said or thing):
            continue
        out.append(("PHONE", a, b, vote(1 if phone_said and not id_said else -1 if id_said else 0, -1 if thing else 0, 1 if prefix else 0, 1 if national or prefix else -1, -1 if dated or re.match(r"[-_.]?\w", after) else 0, 1 if 9 <= n <= 13 else -1, -1 if id_shape else 0)))
        out.append(("ID", a, b, vote(1 if id_said else -1 if thing or phone_said else 0, 1 if id_shape else -1, -1 if prefix or dated else 0, -1 if re.match(r"[-_.]?\w", after) else 1)))
        taken.append((a, b))
    searched = [NUMBER_FIRST] if "number" in hints else []
    if "street" in hints and STREET_QUICK.search(text):
        searched.append(STREET_FIRST)
    if "bare" in hints:
        searched.append(BARE_STREET)
    for expression in searched:
        for m in expression.finditer(text):
            a, b = m.span()
            if any(a < e and s < b for s, e in taken):
                continue
            before, after = text[max(0, a - 70) : a], text[b : b + 30]
            out.append(("ADDRESS", a, b, vote(1 if PLACE_WORDS.search(before) else 0, 1 if POSTCODE.match(after) else 0, -1 if CODE_NAME.match(after) or THING_WORDS.search(before) else 0, 1 if re.search(r"\d", m.group()) else -1)))
            b = TAIL.match(text, b).end() if expression is not BARE_STREET else b
            out[-1] = ("ADDRESS", a, b, out[-1][3])
            taken.append((a, b))
    if not text.isascii() and EAST.search(text):
        out += _eastern(text, taken)
    if rare or flag.hints_at_name(text):
        out += _names(text, flag, taken)
    return out


def _eastern(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple]:
    """Names and addresses in Japanese texts; what is found is taken."""
    for m in EAST_ADDRESS.finditer(text):
        if not any(m.start() < e and s < m.end() for s, e in taken):
            yield "ADDRESS", m.start(), m.end(), vote(1 if EAST_PLACE.search(text[max(0, m.start() - 12) : m.start()]) else 0, 1 if "〒" in m.group() else 0, 0, 1)
            taken.append(m.span())
    for m in EAST_NAME.finditer(text):
        said = EAST_LABEL.search(text[max(0, m.start() - 12) : m.start()])
        if (said or m.group(1)) and not EAST_OFFICE.search(m.group()) and not any(m.start() < e and s < m.end() for s, e in taken):
            yield "NAME", m.start(), m.end(), vote(1 if " " in m.group() or "\u3000" in m.group() or "・" in m.group() else 0, 1, 1 if said else 0, 1 if m.group(1) else 0, 1, 0)
            taken.append(m.span())


# 4. The span model


def features(kind: str, votes: str, span: str, before: str, after: str) -> list[int]:
    """Places of the features of a candidate in a vector of DIMS."""
    got = [kind + "b"] + [f"{kind}v{i}{c}" for i, c in enumerate(votes)] + [f"{kind}V{votes}"]
    words = re.findall(r"\w+|[^\w\s]", before)[-2:]
    got += [f"{kind}p{k}{w.lower()}" for k, w in enumerate(reversed(words))]
    got += [f"{kind}n{w.lower()}" for w in re.findall(r"\w+|[^\w\s]", after)[:1]]
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", re.sub(r"\d", "9", span)))
    got.append(f"{kind}s{shape[:24]}")
    if kind == "NAME":
        for w in WORD.findall(plain(span)):
            got += [f"Nx{w[:3]}", f"Ny{w[-3:]}", f"Nz{w[-4:]}"]
    return [zlib.crc32(g.encode()) % DIMS for g in got]


class SpanModel:
    """Logistic regression on hashed features, fitted to probabilities."""

    def __init__(self, rows: list[list[int]], target: np.ndarray, rounds: int = 120, rate: float = 0.5, decay: float = 1e-4):
        self.weights = np.zeros(DIMS)
        if not rows:
            return
        at = np.concatenate([np.asarray(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        squares = np.full(DIMS, 1e-6)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.bincount(owner, self.weights[at], len(rows))))
            g = np.bincount(at, (p - target)[owner], DIMS) / len(rows) + decay * self.weights
            squares += g * g
            self.weights -= rate * g / np.sqrt(squares)

    def probability(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([1 / (1 + np.exp(-np.clip(self.weights[r].sum(), -30, 30))) for r in rows])


_CANDIDATE = "tbl string, row_id bigint, pii_type string, start_pos int, end_pos int, votes string, span string, before string, after string"


def find_mentions(texts: DataFrame, trained_on: int = TRAINED_ON) -> DataFrame:
    """(tbl, row_id, pii_type, start_pos, end_pos, p) of every mention in texts (tbl, row_id, text).

    Positions are code points, the end exclusive. Null and empty texts hold none; repeated rows count once; a table
    without any candidate gives no row. Where two types claim one place the more probable one counts. Texts of any length
    are read whole.
    """
    spark = texts.sparkSession
    texts = spread(texts.where("text is not null and text <> ''").select("tbl", "row_id", "text"))
    given, surnames, rest = learn_lexicon(texts)
    lexicon = spark.sparkContext.broadcast((given, surnames))
    read = texts if rest is None else with_rare_words(texts, rest)

    mark = uuid.uuid4().hex

    def propose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flag = _flags(mark, *lexicon.value)
        for f in frames:
            rows = []
            none = [None] * len(f)
            for tbl, row, t, given, surnames in zip(f["tbl"], f["row_id"], f["text"], f.get("rare_given", none), f.get("rare_surnames", none)):
                rare = given is not None
                for kind, a, b, v in candidates(t, flag.beside(given, surnames) if rare else flag, rare):
                    rows.append((tbl, row, kind, a, b, v, t[a:b][:80], t[max(0, a - 24) : a], t[b : b + 12]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CANDIDATE.split(", ")])

    proposed = kept(read.mapInPandas(propose, _CANDIDATE))
    by_type: dict[str, dict[str, float]] = {}
    for kind, votes, n in proposed.groupBy("pii_type", "votes").count().collect():  # at most 3 ** 6 patterns a type
        by_type.setdefault(kind, {})[votes] = n
    found = {kind: em(patterns) for kind, patterns in by_type.items()}
    total = sum(sum(p.values()) for p in by_type.values())
    share = min(1.0, trained_on / max(1, total))
    sample = proposed.where(F.pmod(F.xxhash64("tbl", "row_id", "start_pos"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else proposed
    learned = sample.select("pii_type", "votes", "span", "before", "after").limit(2 * trained_on).collect()
    model = SpanModel([features(*r) for r in learned], np.array([found[r[0]][r[1]] for r in learned]))
    shared = spark.sparkContext.broadcast(model)

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = shared.value.probability([features(*r) for r in zip(f["pii_type"], f["votes"], f["span"], f["before"], f["after"])])
            yield f[["tbl", "row_id", "pii_type", "start_pos", "end_pos"]].assign(p=p)[p >= 0.5]

    decided = proposed.mapInPandas(decide, "tbl string, row_id bigint, pii_type string, start_pos int, end_pos int, p double")
    w = Window.partitionBy("tbl", "row_id", "start_pos").orderBy(F.desc("p"), "pii_type")
    return decided.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def redact(texts: DataFrame, mentions: DataFrame) -> DataFrame:
    """(tbl, row_id, text): each mention replaced by ``[TYPE]``, all else kept. Null texts stay null; repeated rows count once."""
    cut = F.struct(F.col("start_pos"), F.col("end_pos"), F.col("pii_type"))
    spans = mentions.groupBy("tbl", "row_id").agg(F.sort_array(F.collect_list(cut)).alias("spans"))
    text = F.col("text")

    def add(acc: Column, s: Column) -> Column:
        grown = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start_pos"] - acc["at"]), F.lit("["), s["pii_type"], F.lit("]"))
        return F.when(s["start_pos"] >= acc["at"], F.struct(grown.alias("out"), s["end_pos"].alias("at"))).otherwise(acc)

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate("spans", start, add, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    rows = texts.select("tbl", "row_id", "text").distinct().join(spans, ["tbl", "row_id"], "left")
    return rows.select("tbl", "row_id", F.when(F.col("spans").isNull(), text).otherwise(clean).alias("text"))

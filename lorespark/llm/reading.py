"""Reading level of documents.

One interpolated bigram model for each level is trained on all rated documents,
by counts that the workers add up. Documents mix sentences of neighbouring levels and raters err,
so training alternates: a sentence goes to the level whose model finds it least
surprising (a prior keeps it near its document's rating), then the models are
counted anew. The weights of interpolation are fitted by EM on every fifth
document, under counts of the others.

Every document is then read in full. For every level t each sentence has a
surprisal, in bits a word, under the best model below t and under the best at t or
above; the differences of a document's sentences are a distribution, of which the
quartiles' mean places the document. Isotonic regression on the ratings maps it
monotonically to the chance of being rated t or higher. The level is the highest t
with an even chance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.shared import kept, spread

LEVELS = 4
ROUNDS = 4
LEAST_WORDS = 40
SKIPPED_KINDS = ("log", "code")
#: Sentences of fewer words have no pair of words to judge by (list marks, single words).
SENTENCE_WORDS = 2
WEIGHTS = (0.60, 0.38, 0.02)  # of bigram, unigram and uniform estimates, before they are fitted
QUARTILES = (0.25, 0.5, 0.75)
UNKNOWN, START = 0, 1
# Frequent function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to a in is that it for was on with as are be at by this from or an not which but they you we have has can their his her its will would if then after before",
    "de": "der die das und ist nicht ein eine den dem des mit von zu auf für im sich auch noch wird wurde bitte alle nach bei wie aus sind wir",
    "fr": "le la les des et est un une dans pour que qui ne pas sur avec plus du au en par ce cette doit été reste parce",
    "it": "il lo la gli di e è che non un una per con del della nel nella più si da sono stato ancora alla anche va",
    "es": "el la los las de y es que no un una en por con del se para más su al está debe todavía porque cuando",
}
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence; every number is the same word."""
    found = (WORD.findall(s) for s in SENTENCE.split(text.lower()))
    return [["0" if w[0].isdigit() else w for w in s] for s in found if s]


_LANGUAGE = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}
_ANY = frozenset().union(*_LANGUAGE.values())


def is_english(words: list[str]) -> bool:
    """More English function words than of any other language, and at least one for 20 words."""
    n = Counter(filter(_ANY.__contains__, words))
    hits = {lang: sum(n[w] for w in own if w in n) for lang, own in _LANGUAGE.items()}
    return hits["en"] * 20 >= len(words) and hits["en"] > max(v for k, v in hits.items() if k != "en")


def eligible(text: str | None, kind: str | None) -> list[list[str]] | None:
    """The sentences of an English prose document that is long enough, else None."""
    if not text or kind in SKIPPED_KINDS or len(text.split()) < LEAST_WORDS:
        return None
    parts = sentences(text)
    return parts if is_english([w for s in parts for w in s]) else None


class Levels:
    """Interpolated bigram models of all levels over one vocabulary."""

    def __init__(self, documents: list[list[list[str]]], ratings: list[float], rounds: int = ROUNDS):
        """Trained on documents that are at hand; ``trained`` does the same on the workers."""
        seen = Counter(w for d in documents for w in {w for s in d for w in s})
        self._begin((w for w, n in seen.items() if n >= least_documents(len(documents))))
        held = np.arange(len(documents)) % 5 == 0
        for k in range(rounds):
            self.learn(*self.tally(documents, ratings, held), fit=k == rounds - 1 and len(documents) >= 20)

    @classmethod
    def over(cls, words: Iterable[str]) -> Levels:
        """Untrained models over a vocabulary."""
        new = cls.__new__(cls)
        new._begin(words)
        return new

    def _begin(self, words: Iterable[str]) -> None:
        self.vocabulary = {w: i + 2 for i, w in enumerate(sorted(words))}
        self.size, self.weights = len(self.vocabulary) + 2, WEIGHTS
        self.codes: np.ndarray | None = None

    def tally(self, documents: list[list[list[str]]], ratings: list[float], held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code, level, held, n): pairs of words by the level of their sentence and whether their document is held out.

        A sentence's level is its document's rating before anything is learned, then that of the model it fits best.
        """
        words, starts, owner = self._numbered(documents)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        codes, rated = self._codes(words, starts), np.asarray(ratings, float)[owner]
        if self.codes is None:
            level = np.clip(np.round(rated), 1, LEVELS).astype(int) - 1
        else:
            # fixed prior of a sentence's level, by its distance from the document's rating
            prior = np.log(np.array([0.70, 0.14, 0.02, 0.01])[np.minimum(3, np.abs(np.arange(1, LEVELS + 1)[None, :] - np.round(rated)[:, None])).astype(int)])
            level = np.argmax(np.add.reduceat(self._logs(codes, words), starts, axis=0) * np.log(2) + prior, axis=1)
        sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
        key, n = np.unique((codes * LEVELS + level[sentence]) * 2 + np.asarray(held, bool)[owner][sentence], return_counts=True)
        return key // 2 // LEVELS, key // 2 % LEVELS, key % 2, n

    def learn(self, code: np.ndarray, level: np.ndarray, held: np.ndarray, n: np.ndarray, fit: bool) -> None:
        """Takes over the counts of ``tally``, over all documents; with ``fit`` the weights of interpolation are fitted too."""
        self.codes, at = np.unique(code, return_inverse=True)
        parts = np.zeros((2, len(self.codes), LEVELS))
        np.add.at(parts, (held, at, level), n)
        if fit:
            self.weights = self._fitted(*parts)
        first, second, third = self._estimates(parts.sum(0))
        base = self.weights[1] * second + self.weights[2] * third
        self.unigram = np.log2(base)
        self.bigram = np.log2(self.weights[0] * first + base[self.codes % self.size])

    def _estimates(self, bi: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Of each known pair and level its chance after its first word, of each word and level its chance, and that of any word."""
        uni, before, prev = np.zeros((self.size, LEVELS)), np.zeros((self.size, LEVELS)), self.codes // self.size
        np.add.at(uni, self.codes % self.size, bi)
        np.add.at(before, prev, bi)
        return bi / np.maximum(before[prev], 1), uni / np.maximum(uni.sum(0), 1), 1 / self.size

    def _fitted(self, others: np.ndarray, held: np.ndarray, rounds: int = 20) -> tuple[float, float, float]:
        """The weights that make the held-out words most likely, under counts of the others."""
        if not held.any() or not others.any():
            return WEIGHTS
        first, second, third = self._estimates(others)
        pair, level = np.nonzero(held)
        n = held[pair, level]
        chances = np.stack([first[pair, level], second[self.codes[pair] % self.size, level], np.full(len(pair), third)], axis=1)
        weights = np.array(WEIGHTS)
        for _ in range(rounds):
            share = chances * weights
            weights = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        return tuple((weights + 1e-3) / (weights + 1e-3).sum())

    def _logs(self, codes: np.ndarray, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where((self.codes[at] == codes)[:, None], self.bigram[at], self.unigram[words])

    def _numbered(self, documents):
        known, words, starts, owner = self.vocabulary, [], [], []
        for k, d in enumerate(documents):
            for s in d:
                if len(s) >= SENTENCE_WORDS:
                    starts.append(len(words))
                    owner.append(k)
                    words.extend(known.get(w, UNKNOWN) for w in s)
        return np.array(words, np.int64), np.array(starts, np.int64), np.array(owner, np.int64)

    def _codes(self, words, starts):
        prev = np.empty_like(words)
        prev[1:] = words[:-1]
        prev[starts] = START
        return prev * self.size + words

    def read(self, documents: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: the share of sentences best explained at each level, the mean surprisal in bits a word, and its
        place at each border between levels (the mean of quartiles of its sentences' differences, in bits a word)."""
        words, starts, owner = self._numbered(documents)
        shares, bits, places = np.zeros((len(documents), LEVELS)), np.zeros(len(documents)), np.zeros((len(documents), LEVELS - 1))
        if not len(starts) or not len(self.codes):
            return shares, bits, places
        score = np.add.reduceat(self._logs(self._codes(words, starts), words), starts, axis=0)
        np.add.at(shares, (owner, np.argmax(score, axis=1)), 1)
        np.add.at(bits, owner, -score.max(axis=1))
        lengths = np.diff(np.append(starts, len(words)))
        length = np.bincount(owner, lengths, len(documents))
        for t in range(1, LEVELS):
            places[:, t - 1] = quartile_means((score[:, t:].max(1) - score[:, :t].max(1)) / lengths, owner, len(documents))
        return shares / np.maximum(shares.sum(1, keepdims=True), 1), bits / np.maximum(length, 1), places


def quartile_means(x: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The mean of the quartiles (interpolated) of each owner's values; 0 for one without values."""
    order = np.lexsort((x, owner))
    x, count = x[order], np.bincount(owner, minlength=n)
    start = np.cumsum(count) - count
    out = np.zeros(n)
    some = np.flatnonzero(count)
    for q in QUARTILES:
        at = q * (count[some] - 1)
        low = np.floor(at).astype(int)
        a, b = x[start[some] + low], x[start[some] + np.minimum(low + 1, count[some] - 1)]
        out[some] += (a + (at - low) * (b - a)) / len(QUARTILES)
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the upper end of each block of x with the block's mean of y, rising."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, upper end
    for a, b in zip(x[order], y[order]):
        if blocks and blocks[-1][2] == a:
            blocks[-1][0] += b
            blocks[-1][1] += 1
        else:
            blocks.append([float(b), 1, float(a)])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, end]
    return np.array([b[2] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Scale:
    """The monotone maps from places to levels."""

    def __init__(self, places: np.ndarray, ratings: list[list[int]]):
        rows = np.repeat(np.arange(len(ratings)), [len(r) for r in ratings])
        given = np.array([v for r in ratings for v in r])
        self.border = []
        for t in range(2, LEVELS + 1):
            x = places[rows, t - 2]
            end, mean = isotonic(x, (given >= t).astype(float))
            over = np.flatnonzero(mean >= 0.5)
            if not len(over):
                self.border.append(np.inf)
            elif over[0] == 0:
                self.border.append(-np.inf)
            else:  # half way between the last point below and the first above
                k = over[0]
                self.border.append((end[k - 1] + x[x > end[k - 1]].min()) / 2)

    def levels(self, places: np.ndarray) -> np.ndarray:
        return 1 + (places >= np.array(self.border)).sum(1)


def least_documents(n: int) -> int:
    """In how many of n documents a word must be to be known."""
    return 3 if n > 30 else 1


def trained(rated: DataFrame, rounds: int = ROUNDS) -> tuple[Levels, Scale] | None:
    """Models and scale from all rated documents (sentences, levels, held); None if there are none.

    Texts stay on the workers. The driver sees the vocabulary and the counts of pairs of words, which grow with the language,
    and of each rated document its three places and its ratings.
    """
    spark, n = rated.sparkSession, rated.count()
    if not n:
        return None
    words = rated.select(F.explode(F.array_distinct(F.flatten("sentences"))).alias("w")).groupBy("w").count().where(F.col("count") >= least_documents(n))
    models = Levels.over(r["w"] for r in words.select("w").collect())
    lists = lambda frame: [[list(s) for s in d] for d in frame["sentences"]]
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(models)

        def count(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame(dict(zip(("code", "level", "held", "n"), sent.value.tally(lists(frame), [float(np.mean(v)) for v in frame["levels"]], frame["held"].to_numpy()))))

        counts = rated.mapInPandas(count, "code bigint, level int, held int, n bigint").groupBy("code", "level", "held").agg(F.sum("n").alias("n")).toPandas()
        models.learn(*(counts[c].to_numpy(np.int64) for c in ("code", "level", "held", "n")), fit=k == rounds - 1 and n >= 20)
    sent = spark.sparkContext.broadcast(models)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"places": list(sent.value.read(lists(frame))[2]), "levels": frame["levels"]})

    found = rated.mapInPandas(place, "places array<double>, levels array<int>").toPandas()
    return models, Scale(np.array(found["places"].tolist(), float).reshape(-1, LEVELS - 1), [list(v) for v in found["levels"]])


def reading_profile(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, level, bits, share_1 .. share_4): level of every English prose document of at least 40 words.

    ``bits`` is the mean surprisal of its words under the best model of their sentence, ``share_k`` the share of sentences
    at level k. Null and short texts, other languages, logs and code have no row; repeated rows count once; ratings
    without a level or of no document are ignored; without any rating there is nothing to learn from and no row.
    """
    spark = documents.sparkSession
    levels = ratings.where(f"level between 1 and {LEVELS} and doc_id is not null").select("doc_id", F.col("level").cast("int").alias("level"), "rater").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    texts = documents.where(F.col("text").isNotNull() & ~F.coalesce(F.col("doc_kind").isin(*SKIPPED_KINDS), F.lit(False))).select("doc_id", "text", "doc_kind")
    # of a repeated id the greatest text, and every fifth document, by a hash of its id, is held out when weights are fitted
    learned = texts.join(levels, "doc_id").groupBy("doc_id").agg(F.max(F.struct("text", "doc_kind")).alias("d"), F.first("levels").alias("levels"))
    learned = learned.select("d.*", "levels", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("held"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [eligible(t, k) for t, k in zip(frame["text"], frame["doc_kind"])]
            own = frame.assign(sentences=pd.Series(parts, index=frame.index, dtype=object))
            yield own[[p is not None for p in parts]][["sentences", "levels", "held"]]

    schema = "doc_id bigint, level int, bits double, " + ", ".join(f"share_{k} double" for k in range(1, LEVELS + 1))
    found = trained(kept(learned.mapInPandas(split, "sentences array<array<string>>, levels array<int>, held boolean")))
    if found is None:
        return spark.createDataFrame([], schema)
    models, scale = found
    shared = spark.sparkContext.broadcast((models, scale))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, scale = shared.value
        for frame in frames:
            own = [(d, p) for d, t, k in zip(frame["doc_id"], frame["text"], frame["doc_kind"]) if (p := eligible(t, k))]
            shares, bits, places = models.read([p for _, p in own])
            out = pd.DataFrame({"doc_id": [d for d, _ in own], "level": scale.levels(places), "bits": bits})
            for k in range(LEVELS):
                out[f"share_{k + 1}"] = shares[:, k]
            yield out

    return spread(texts).mapInPandas(run, schema).distinct()


def reading_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, level)."""
    return reading_profile(documents, ratings).select("doc_id", "level")

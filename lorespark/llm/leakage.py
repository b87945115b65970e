"""Evaluation texts inside training text.

The normalised words of the test items, cut into consecutive blocks of 7, form one
Aho-Corasick automaton over word numbers: every stretch of 13 words holds a whole
block, so a node for each word is enough. Each text is read once: its words are
numbered by the automaton's own vocabulary and run through it; a block that is
found is extended to both sides as far as text and item agree, and word places are
mapped back to the text's characters only where that makes 13 words.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.shared import spread

WORDS = 13
#: Characters of test items that go into one automaton; more are searched in further passes, none is left out.
BLOCK_CHARS = 10_000_000
# Letters and digits of any script; all else only separates.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Normalised words. Case is folded word by word, as folding can change a text's length."""
    return WORD.findall(text.lower()) if text.isascii() else [w.casefold() for w in WORD.findall(text)]


class Items:
    """The automaton of the blocks of all items, for stretches of at least ``size`` words."""

    def __init__(self, items: list[tuple[int, str]], size: int):
        self.size, self.block = size, (size + 1) // 2
        self.vocabulary: dict[str, int] = {}
        self.words: dict[int, list[array]] = {}  # of each item its texts
        owners: dict[tuple, list[tuple[int, int, int]]] = {}
        for item, text in items:
            numbers = array("i", (self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)))
            own = self.words.setdefault(item, [])
            for at in range(0, len(numbers) - self.block + 1, self.block) if len(numbers) >= size else ():
                owners.setdefault(tuple(numbers[at : at + self.block]), []).append((item, len(own), at))
            own.append(numbers)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, found in owners.items():
            self.automaton.add_word(block, found)
        self.automaton.make_automaton()
        self.empty = not owners

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(item, first word, last word) of each maximal stretch that text and item share."""
        numbers = tuple(map(self.vocabulary.get, words_of(text), repeat(0)))
        if self.empty or len(numbers) < self.size:
            return []
        n, size = len(numbers), self.size
        reached: dict[tuple[int, int, int], int] = {}  # by item, text and shift: the end of the last stretch
        found: set[tuple[int, int, int]] = set()
        for end, owners in self.automaton.iter(numbers):
            for item, k, at in owners:
                shift = end - self.block + 1 - at
                if reached.get((item, k, shift), -1) >= end:
                    continue
                own = self.words[item][k]
                a, b = end - self.block + 1, end
                while a > 0 and a - shift > 0 and numbers[a - 1] == own[a - 1 - shift]:
                    a -= 1
                while b + 1 < n and b + 1 - shift < len(own) and numbers[b + 1] == own[b + 1 - shift]:
                    b += 1
                reached[item, k, shift] = b
                if b - a + 1 >= size:
                    found.add((item, a, b))
        out: list[tuple[int, int, int]] = []
        for item, a, b in sorted(found, key=lambda x: (x[0], x[1], -x[2])):
            if not (out and out[-1][0] == item and b <= out[-1][2]):  # not within another stretch, of an item that repeats itself
                out.append((item, a, b))
        return out


_BUILT: dict[tuple, Items] = {}


def _built(mark: tuple, items: list[tuple[int, str]], size: int) -> Items:
    """The automaton of a block, built once in each worker process and kept until another one is asked for."""
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Items(items, size)
    return _BUILT[mark]


def leaked_spans(documents: DataFrame, items: DataFrame, size: int = WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start_pos, end_pos): maximal stretches of a text that repeat at least ``size`` words of an item.

    Positions are code points, the end exclusive. Null or short texts and items match nothing; repeated rows count
    once; a stretch that stands in several items is found for each of them; a document may hold any number of them.
    Items are gathered on the driver in blocks of at most about ``block_chars`` characters, one scan for each block.
    """
    spark = documents.sparkSession
    items = items.where("item_text is not null and item_id is not null").select("item_id", "item_text").distinct()
    total = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    blocks = total // block_chars + 1
    texts = spread(documents.where("text is not null and text <> ''").select("doc_id", "text"))
    out = None
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])

        mark = uuid.uuid4().hex

        def run(frames: Iterator[pd.DataFrame], shared=shared, mark=mark) -> Iterator[pd.DataFrame]:
            windows = _built((mark, size), shared.value, size)
            for frame in frames:
                rows = []
                for doc, text in zip(frame["doc_id"], frame["text"]):
                    if found := windows.spans(text):
                        at = [m.span() for m in WORD.finditer(text)]
                        rows += [(doc, item, at[a][0], at[b][1]) for item, a, b in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start_pos", "end_pos"])

        part = texts.mapInPandas(run, "doc_id bigint, item_id bigint, start_pos int, end_pos int")
        out = part if out is None else out.union(part)
    return out.distinct()


def leaked_items(documents: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, item_id): the items that leaked into each document."""
    return leaked_spans(documents, items, size).select("doc_id", "item_id").distinct()

"""Encoding of a corpus by a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash (hash and displace) holds the vocabulary in
exactly as many slots as there are tokens and resolves every pre-token that is a
token. A miss is merged from its bytes: a heap of adjacent pairs by rank over a
doubly linked list, O(n log n) in the pre-token's length, so text without blanks
is no trap. Before both, a worker remembers the pre-tokens it has met. The corpus
is encoded where it lies: only keys are shuffled, to learn which of them repeat.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.shared import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern that belongs to this public vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers before it starts anew; bounds its memory.
REMEMBERED = 200_000
_LOW = (1 << 64) - 1


class MinimalPerfectHash:
    """Maps n byte strings to n slots without a collision; each slot keeps its key, so strangers are told apart."""

    def __init__(self, keys: list[bytes], values: list[int], per_bucket: int = 3):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_128_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            groups[(h & _LOW) % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        single = next((k for k, b in enumerate(order) if len(groups[b]) < 2), len(order))
        for b in order[:single]:
            d = 0
            while True:
                slots = [self._slot(hashes[i], d) for i in groups[b]]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
                if d > 1_000_000:
                    raise ValueError("keys must be distinct")
            self.shift[b] = d
            for i, s in zip(groups[b], slots):
                self.keys[s], self.values[s] = keys[i], values[i]
        free = (s for s in range(n) if self.keys[s] is None)
        for b in order[single:]:
            for i in groups[b]:
                s = next(free)
                self.shift[b], self.keys[s], self.values[s] = -s - 1, keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        x = ((h >> 64) + d * (h & _LOW | 1)) & _LOW
        return ((x ^ x >> 29) * 0x9E3779B97F4A7C15 & _LOW) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h & _LOW) % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


def merge_bytes(word: bytes, rank_of) -> tuple[int, ...]:
    """Ids of one pre-token: the pair of lowest rank is merged first, the leftmost among equals."""
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(word[i : i + 2])) >= 0]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, e = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue  # one of the two has been merged since
        alive[j], end[i], after[i] = False, e, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := rank_of(word[i : end[after[j]]])) >= 0:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if before[i] >= 0 and (r := rank_of(word[before[i] : e])) >= 0:
            heapq.heappush(heap, (r, before[i], e))
    return tuple(rank_of(word[i : end[i]]) for i in range(n) if alive[i])


def read_ranks(path: str = VOCABULARY) -> MinimalPerfectHash:
    """The vocabulary file's tokens with their ranks, which are the ids."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return MinimalPerfectHash([base64.b64decode(a) for a, _ in pairs], [int(b) for _, b in pairs])


class Encoder(dict):
    """pre-token -> ids; what it hasn't met goes through the two tiers."""

    def __init__(self, vocabulary: MinimalPerfectHash):
        self.vocabulary, self.pretokens = vocabulary, regex.compile(PATTERN).findall

    def __missing__(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        whole = self.vocabulary.get(raw)
        ids = (whole,) if whole >= 0 else merge_bytes(raw, self.vocabulary.get)
        if len(self) >= REMEMBERED:
            self.clear()
        if len(token) < 100:
            self[token] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.__getitem__, self.pretokens(text))), np.int32)


#: Repeated keys up to which they are sent to all workers; the corpus is shuffled only beyond that.
SENT = 500_000


def repeated_once(rows: DataFrame, key: str, most: int = SENT) -> DataFrame:
    """Distinct rows. Only rows whose key repeats are compared; all others stay where they are."""
    repeated = rows.groupBy(key).count().where("count > 1").select(F.col(key).alias("_key"))
    few = repeated.limit(most + 1).toArrow()
    if few.num_rows > most:
        return rows.dropDuplicates()
    if few.num_rows == 0:
        return spread(rows)
    known = F.broadcast(rows.sparkSession.createDataFrame(few))
    same = rows[key].eqNullSafe(known["_key"])
    again = rows.join(known, same, "left_semi").dropDuplicates()
    return spread(rows.join(known, same, "left_anti")).unionByName(again)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): the ids of each text, without special tokens.

    Null and empty texts have the empty list; the strings of special tokens are ordinary text; a repeated row counts
    once; further columns don't matter. The vocabulary is read by the driver and broadcast (about 50,000 entries).
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            parts = [encoder.encode(t) if t else np.empty(0, np.int32) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    rows = repeated_once(documents.select(F.col(key), F.col(text)), key)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")

"""Unigram segmentation of texts by a given vocabulary of scored pieces."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 32
MARK = "▁"


@dataclass(frozen=True)
class Unigram:
    """Scores and ids of pieces; ``unknown`` costs ten more than the rarest piece."""

    pieces: dict[str, tuple[int, float]]
    unknown: int
    begin: int | None = None
    end: int | None = None
    limit: int = 512

    @classmethod
    def from_json(cls, config: dict) -> Unigram:
        model = config["model"]
        if model.get("type") != "Unigram":
            raise ValueError("only Unigram models are supported")
        added = {t["content"]: t["id"] for t in config.get("added_tokens", ())}
        pieces = {p: (i, s) for i, (p, s) in enumerate(model["vocab"])}
        return cls(pieces, model["unk_id"], added.get("<s>"), added.get("</s>"), (config.get("truncation") or {}).get("max_length", 512))

    def prepare(self, text: str) -> str:
        """NFKC, runs of blanks as one mark, one mark before the text."""
        return MARK + re.sub(r"\s+", MARK, unicodedata.normalize("NFKC", text).strip()) if text.strip() else ""

    def segment(self, text: str) -> list[int]:
        """Ids of the segmentation with the highest total score; neighbouring unknown characters are one unknown piece."""
        n, worst = len(text), min((s for _, s in self.pieces.values()), default=0.0) - 10
        best = [0.0] + [float("-inf")] * n
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                hit = self.pieces.get(text[i:j])
                if hit and best[i] + hit[1] > best[j]:
                    best[j], back[j] = best[i] + hit[1], (i, hit[0])
            if best[i] + worst > best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + worst, (i, self.unknown)
        out: list[int] = []
        at = n
        while at:
            at, piece = back[at]
            if not (piece == self.unknown and out and out[-1] == piece):
                out.append(piece)
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        frame = (self.begin is not None) + (self.end is not None)
        # no more characters than the ids that are kept can come from
        ids = self.segment(self.prepare(text)[: self.limit * LONGEST])[: max(0, self.limit - frame)]
        return [*([self.begin] if self.begin is not None else []), *ids, *([self.end] if self.end is not None else [])]


def encode_column(texts: DataFrame, key: str, text: str, model: Unigram) -> DataFrame:
    """(key, ids); null texts have the empty list."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({key: f[key], "ids": [shared.value.encode(t) if t is not None else [] for t in f[text]]})

    kind = texts.select(F.col(key)).schema[0].dataType.simpleString()
    return texts.select(key, text).mapInPandas(run, f"`{key}` {kind}, ids array<int>")

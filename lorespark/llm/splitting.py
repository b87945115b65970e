"""Cutting oversized chunks at natural boundaries, with overlap.

The lines that a reference names are taken from its page in the JVM (a join by
path and higher-order functions); only texts over the limit reach Python. There
the text's tokens give offsets (prefix sums of their lengths) and one sorted
array of boundaries for each strength of pause. A binary search finds the last
boundary under the limit, the next piece starts ``overlap`` earlier; a stretch
without any boundary is cut hard.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2_000, 200
TOKEN = re.compile(r"\n+|[^\S\n]+|\w+|[^\w\s]")


def boundaries(text: str) -> list[list[int]]:
    """Offsets after which the text pauses, strongest kind first: paragraph, line, sentence, blank."""
    tokens = TOKEN.findall(text)
    ends = list(accumulate(map(len, tokens)))
    kinds: list[list[int]] = [[], [], [], []]
    for k, (token, end) in enumerate(zip(tokens, ends)):
        if token[0] == "\n":
            kinds[0 if len(token) > 1 else 1].append(end)
        elif token in "。！？" or token.isspace() and k and tokens[k - 1] in ".!?:;":
            kinds[2].append(end)
        elif token.isspace():
            kinds[3].append(end)
    return kinds


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the pieces: each at most ``limit`` long, each but the first starting ``overlap`` before the end of the last.

    The strongest pause in the second half of a piece is taken, there the last one; without one in that half the last
    pause of any kind that still makes progress; else the piece is cut at the limit. A text within the limit is one piece.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    n, kinds, start, pieces = len(text), boundaries(text) if len(text) > limit else [], 0, []
    while n - start > limit:
        end = 0
        for least in (max(start + limit // 2, start + overlap), start + overlap):
            for own in kinds:
                i = bisect_right(own, start + limit) - 1
                if i >= 0 and own[i] > least:
                    end = own[i]
                    break
            if end:
                break
        end = end or start + limit
        pieces.append((start, end))
        start = end - overlap
    pieces.append((start, n))
    return pieces


def page_lines(pages: DataFrame) -> DataFrame:
    """(path, lines): the lines of each page with content. Repeated pages count once, the latest version of a page counts."""
    latest = pages.where("page is not null").groupBy("page").agg(F.max(F.struct("updated_at", "content")).alias("p"))
    content = F.regexp_replace(F.col("p.content"), r"\r?\n\z", "")
    return latest.where("p.content is not null").select(F.col("page").alias("path"), F.split(content, r"\r?\n", -1).alias("lines"))


def chunk_texts(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, path, start_line, text): the text of each distinct reference to a page with content.

    Ranges that reach past the page end with it; ranges wholly outside, and backward ones, have the empty text;
    lines before the first count as the first; references without a range are left out.
    """
    own = refs.where("id is not null and start_line is not null and end_line is not null").select("id", "path", F.greatest("start_line", F.lit(1)).alias("start_line"), "end_line").distinct()
    many = F.greatest(F.lit(0), F.least("end_line", F.size("lines")) - F.col("start_line") + 1)
    return own.join(page_lines(pages), "path").select("id", "path", "start_line", F.array_join(F.slice("lines", F.col("start_line"), many), "\n").alias("text"))


def split_chunks(refs: DataFrame, pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, path, piece, start_pos, end_pos, start_line, end_line, text): the pieces of every chunk over the limit.

    ``piece`` counts from 1; positions are code points of the chunk's text, the end exclusive; lines are the page's.
    Chunks within the limit yield nothing: they need no cut.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for id_, path, line, text in zip(f["id"], f["path"], f["start_line"], f["text"]):
                for k, (a, b) in enumerate(cut(text, limit, overlap)):
                    rows.append((id_, path, k + 1, a, b, line + text.count("\n", 0, a), line + text.count("\n", 0, max(a, b - 1)), text[a:b]))
            yield pd.DataFrame(rows, columns=["id", "path", "piece", "start_pos", "end_pos", "start_line", "end_line", "text"])

    over = chunk_texts(refs, pages).where(F.length("text") > limit)
    return over.mapInPandas(run, "id string, path string, piece int, start_pos int, end_pos int, start_line int, end_line int, text string")

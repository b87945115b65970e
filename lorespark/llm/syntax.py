"""Source files that break the grammar of their language.

Every file is lexed and run through the generalised LL recogniser with all
dialects of its language at once; a file that no dialect accepts is flagged with
the line that recognition got to. Files are independent of each other, so this
is one pass over the table, spread evenly because a scan's partitions are small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import grammars, lexers
from lorespark.llm.gll import Grammar, Token

CODE = "SYNTAX_ERROR"
#: language -> (lexer, grammar, start rule of each dialect)
LANGUAGES: dict[str, tuple[Callable[[str], list[list[Token]]], str, tuple[str, ...]]] = {
    "json": (lambda t: [lexers.json_tokens(t)], grammars.JSON, ("File",)),
    "toml": (lambda t: [lexers.toml_tokens(t)], grammars.TOML, ("File",)),
    "yaml": (lambda t: [lexers.yaml_tokens(t)], grammars.YAML, ("File",)),
    "python": (lambda t: [lexers.python_tokens(t)], grammars.PYTHON, ("File",)),
    "javascript": (lambda t: [lexers.script_tokens(t)], grammars.SCRIPT, ("Module",)),
    "typescript": (lambda t: [lexers.script_tokens(t)], grammars.TYPED, ("Module", "Ambients")),
    "go": (lambda t: [lexers.go_tokens(t)], grammars.GO, ("File",)),
    "java": (lambda t: [lexers.java_tokens(t)], grammars.JAVA, ("File", "ModuleFile")),
    "shell": (lexers.shell_parts, grammars.BASH, ("File",)),
}


@lru_cache(maxsize=None)
def grammar_of(language: str) -> Grammar:
    _, text, starts = LANGUAGES[language]
    return Grammar(text, starts)


def error_line(language: str | None, content: str | None) -> int | None:
    """The line at which a file stops being a sentence of its language, or None if it is one or nothing is known of it."""
    if content is None or language not in LANGUAGES:
        return None
    lexer, _, starts = LANGUAGES[language]
    for tokens in lexer(content):
        bad = next((k for k, t in enumerate(tokens) if "ERROR" in t.kinds), None)
        if bad is not None:
            return tokens[bad].line
        accepted, far = grammar_of(language).recognise(tokens, list(starts))
        if not accepted:
            return tokens[min(far, len(tokens) - 1)].line if tokens else 1
    return None


def syntax_diagnostics(files: DataFrame) -> DataFrame:
    """(workspace_id, path, language, code, line) of every file that breaks its grammar.

    Files without content, and languages without a grammar (markdown, text, unknown ones), have none. An empty file is
    judged like any other: valid where the grammar allows an empty text. Repeated rows count once; of a path that has
    several contents each is judged.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            line = [error_line(a, b) for a, b in zip(f["language"], f["content"])]
            out = f[["workspace_id", "path", "language"]].assign(code=CODE, line=pd.array(line, dtype="Int32"))
            yield out[out["line"].notna()]

    spark = files.sparkSession
    # parsing costs far more than moving the texts, so a few large scan partitions are spread over all cores
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    own = files.where(F.col("content").isNotNull() & F.col("language").isin(*LANGUAGES)).select("workspace_id", "path", "language", "content").repartition(parts, "workspace_id", "path")
    return own.mapInPandas(run, "workspace_id string, path string, language string, code string, line int").distinct()


def syntax_rates(files: DataFrame) -> DataFrame:
    """(workspace_id, language, files, broken, rate): over the distinct files with content of languages with a grammar."""
    total = files.where(F.col("content").isNotNull() & F.col("language").isin(*LANGUAGES)).select("workspace_id", "path", "language").distinct().groupBy("workspace_id", "language").agg(F.count(F.lit(1)).alias("files"))
    broken = syntax_diagnostics(files).select("workspace_id", "path", "language").distinct().groupBy("workspace_id", "language").agg(F.count(F.lit(1)).alias("broken"))
    n = F.coalesce("broken", F.lit(0))
    return total.join(broken, ["workspace_id", "language"], "left").select("workspace_id", "language", "files", n.alias("broken"), F.round(n / F.col("files"), 6).alias("rate"))

"""From files to a graph: symbols, imports and calls, resolved to nodes and edges.

Each file is scanned on its own, in Arrow batches; imports and symbols are then resolved by joins over the whole
workspace.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lorespark.functions.ids import edge_id, node_id

SYMBOLS = {
    "python": re.compile(r"^(?P<i>[ \t]*)(?:async[ \t]+)?(?P<k>def|class)[ \t]+(?P<n>\w+)", re.M),
    "javascript": re.compile(r"^(?P<i>[ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:(?:async[ \t]+)?(?P<k>function|class)\*?[ \t]+(?P<n>[\w$]+)|(?:const|let|var)[ \t]+(?P<v>[\w$]+)[^=\n]*=[ \t]*(?:async[ \t]*)?\([^)\n]*\)[^=\n]*=>)", re.M),
    "typescript": re.compile(r"^(?P<i>[ \t]*)(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:(?:async[ \t]+)?(?P<k>function|class|interface|type|enum)[ \t]+(?P<n>[\w$]+))", re.M),
    "go": re.compile(r"^(?P<i>)(?P<k>func|type)[ \t]+(?:\([^)]*\)[ \t]*)?(?P<n>\w+)", re.M),
    "java": re.compile(r"^(?P<i>[ \t]*)(?:(?:public|private|protected|static|final|abstract)[ \t]+)*(?P<k>class|interface|enum|record)[ \t]+(?P<n>\w+)", re.M),
    "rust": re.compile(r"^(?P<i>[ \t]*)(?:pub(?:\([^)]*\))?[ \t]+)?(?:async[ \t]+|unsafe[ \t]+)*(?P<k>fn|struct|enum|trait|mod)[ \t]+(?P<n>\w+)", re.M),
    "kotlin": re.compile(r"^(?P<i>[ \t]*)(?:\w+[ \t]+)*?(?P<k>fun|class|interface|object)[ \t]+(?P<n>\w+)", re.M),
    "csharp": re.compile(r"^(?P<i>[ \t]*)(?:\w+[ \t]+)*?(?P<k>class|interface|struct|enum|record)[ \t]+(?P<n>\w+)", re.M),
    "c": re.compile(r"^(?P<i>)(?:(?P<k>struct|enum)[ \t]+(?P<n>\w+)[ \t\n]*\{|[A-Za-z_][\w \t*]*?[ \t*](?P<v>[A-Za-z_]\w*)[ \t]*\([^;{}()]*\)[ \t\n]*\{)", re.M),
    "cpp": re.compile(r"^(?P<i>[ \t]*)(?:(?P<k>class|struct|enum|namespace)[ \t]+(?P<n>\w+)|[A-Za-z_][\w \t*:<>&]*?[ \t*&](?P<v>[A-Za-z_][\w:]*)[ \t]*\([^;{}()]*\)[ \t\n]*(?:const[ \t\n]*)?\{)", re.M),
    "ruby": re.compile(r"^(?P<i>[ \t]*)(?P<k>def|class|module)[ \t]+(?P<n>[\w?!]+)", re.M),
    "php": re.compile(r"^(?P<i>[ \t]*)(?:\w+[ \t]+)*?(?P<k>function|class|interface|trait)[ \t]+(?P<n>\w+)", re.M),
    "shell": re.compile(r"^(?P<i>[ \t]*)(?:(?P<k>function)[ \t]+)?(?P<n>[A-Za-z_]\w*)[ \t]*\(\)", re.M),
}
IMPORTS = {
    "python": re.compile(r"^[ \t]*(?:from[ \t]+([\w.]+)[ \t]+import\b|import[ \t]+([\w.]+))", re.M),
    "javascript": re.compile(r"""(?:\bfrom|\bimport|\brequire\()[ \t]*["']([^"'\n]+)["']"""),
    "typescript": re.compile(r"""(?:\bfrom|\bimport|\brequire\()[ \t]*["']([^"'\n]+)["']"""),
    "java": re.compile(r"^import[ \t]+(?:static[ \t]+)?([\w.]+)", re.M),
}
# Languages of which only the file is noted; and words before a bracket that are no calls.
FILE_ONLY = ("markdown", "json", "yaml", "toml", "text")
NO_CALLS = frozenset("if for while switch catch function def class return new typeof sizeof echo print import from extends implements".split())
CALL = re.compile(r"\b([A-Za-z_$][\w$]*)[ \t]*\(")
# What may follow an import's specifier to make it a path, in order of preference.
ENDINGS = ("", ".ts", ".mts", ".tsx", ".js", ".mjs", ".jsx", ".py", "/index.ts", "/index.js", "/__init__.py")
_QUOTED = r"""'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`"""
_NOISE = {
    "hash": re.compile(rf"(?P<q>{_QUOTED})|#[^\n]*"),
    "slash": re.compile(rf"(?P<q>{_QUOTED})|//[^\n]*|/\*[\s\S]*?\*/"),
}


def without_noise(text: str, language: str, keep_strings: bool = False) -> str:
    """Comments, and strings unless kept, blanked out; line ends and so line numbers stay."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    noise = _NOISE["hash" if language in ("python", "shell", "ruby", "yaml", "toml") else "slash"]
    return noise.sub(lambda m: m.group() if m.group("q") and keep_strings else blank(m.group()), text)


def scan_text(text: str, language: str) -> list[tuple[str, str, str | None, str | None, int]]:
    """(what, name, scope, symbol kind, line): symbols with the names they stand within, imports, and calls of each symbol."""
    if language not in SYMBOLS:
        return []
    bare = without_noise(text, language)
    out: list[tuple] = []
    spans: list[tuple[int, str]] = []  # where each symbol begins, and its full name
    scope: list[tuple[int, str]] = []
    declared: set[int] = set()
    for m in SYMBOLS[language].finditer(bare):
        name = m.group("n") or m.groupdict().get("v")
        indent = len(m.group("i").expandtabs(4))
        while scope and scope[-1][0] >= indent:
            scope.pop()
        within = ".".join(n for _, n in scope) or None
        out.append(("symbol", name, within, m.groupdict().get("k") or "function", bare.count("\n", 0, m.start("n") if m.group("n") else m.start()) + 1))
        declared.add(m.start("n") if m.group("n") else m.start("v"))
        spans.append((m.end(), f"{within}.{name}" if within else name))
        scope.append((indent, name))
    if language in IMPORTS:
        strings = without_noise(text, language, keep_strings=True)
        for m in IMPORTS[language].finditer(strings):
            out.append(("import", next(g for g in m.groups() if g), None, None, strings.count("\n", 0, m.start()) + 1))
    k = -1
    for m in CALL.finditer(bare):
        while k + 1 < len(spans) and spans[k + 1][0] <= m.start():
            k += 1
        if k >= 0 and m.group(1) not in NO_CALLS and m.start() not in declared:
            out.append(("call", m.group(1), spans[k][1], None, bare.count("\n", 0, m.start()) + 1))
    return out


def scan_files(files: DataFrame) -> DataFrame:
    """(workspace_id, path, language, what, name, scope, symbol_kind, line) of files with content, repeated rows once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(w, p, lang, *hit) for w, p, lang, c in zip(f["workspace_id"], f["path"], f["language"], f["content"]) for hit in scan_text(c, lang)]
            yield pd.DataFrame(rows, columns=["workspace_id", "path", "language", "what", "name", "scope", "symbol_kind", "line"])

    own = files.where("content is not null and path is not null").select("workspace_id", "path", "language", "content").distinct()
    return own.mapInPandas(run, "workspace_id string, path string, language string, what string, name string, scope string, symbol_kind string, line int")


@F.pandas_udf(ArrayType(StringType()))
def import_candidates(path: pd.Series, name: pd.Series, language: pd.Series) -> pd.Series:
    """Paths that an import may mean, the preferred first."""

    def one(p: str, n: str, lang: str) -> list[str]:
        if lang in ("python", "java"):
            base = n.replace(".", "/").strip("/")
        elif n.startswith("."):
            base = posixpath.normpath(posixpath.join(posixpath.dirname(p), n))
        else:
            base = n
        stem = re.sub(r"\.[cm]?js$", "", base)
        return list(dict.fromkeys([base] + [stem + e for e in ENDINGS]))

    return pd.Series([one(*r) for r in zip(path, name, language)])


def resolve_imports(scanned: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Imports found (workspace_id, path, name, target) and not found (workspace_id, path, name): the first candidate that is a file wins."""
    wanted = scanned.where("what = 'import'").select("workspace_id", "path", "name", "language").distinct()
    tried = wanted.withColumn("c", import_candidates("path", "name", "language")).select("workspace_id", "path", "name", F.posexplode("c").alias("place", "target"))
    known = files.where("path is not null").select("workspace_id", F.col("path").alias("target")).distinct()
    found = tried.join(known, ["workspace_id", "target"]).groupBy("workspace_id", "path", "name").agg(F.min_by("target", "place").alias("target"))
    return found, wanted.select("workspace_id", "path", "name").distinct().join(found, ["workspace_id", "path", "name"], "left_anti")


def resolve_calls(scanned: DataFrame) -> DataFrame:
    """(workspace_id, path, scope, name, target_path, target_scope, code): a call means the one symbol of its name in the workspace.

    With several symbols of the name the code is AMBIGUOUS_SYMBOL, with none UNRESOLVED_SYMBOL, and the target is null.
    Names are counted before the join, so a name that every file declares joins one row, not all of them.
    """
    symbols = scanned.where("what = 'symbol'").select("workspace_id", "path", "scope", "name", "line").distinct()
    counted = symbols.groupBy("workspace_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "scope")).alias("t"))
    calls = scanned.where("what = 'call'").select("workspace_id", "path", "scope", "name").distinct().join(counted, ["workspace_id", "name"], "left")
    code = F.when(F.col("n").isNull(), "UNRESOLVED_SYMBOL").when(F.col("n") > 1, "AMBIGUOUS_SYMBOL")
    return calls.select("workspace_id", "path", "scope", "name", F.when(F.col("n") == 1, F.col("t.path")).alias("target_path"), F.when(F.col("n") == 1, F.col("t.scope")).alias("target_scope"), code.alias("code"))


def assemble(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (workspace_id, id, kind, path, name, scope, start_line), edges and diagnostics of all workspaces."""
    scanned = scan_files(files)
    own = files.where("path is not null").select("workspace_id", "path").distinct()
    base = F.element_at(F.split("path", "/"), -1)
    file_id = node_id(F.lit("file"), F.col("path"), base)
    none = F.lit(None)
    file_nodes = own.select("workspace_id", file_id.alias("id"), F.lit("file").alias("kind"), "path", base.alias("name"), none.cast("string").alias("scope"), none.cast("int").alias("start_line"))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))
    folders = own.select("workspace_id", folder.alias("path")).distinct()
    folder_id = lambda p: node_id(F.lit("directory"), p, F.element_at(F.split(p, "/"), -1))
    folder_nodes = folders.select("workspace_id", folder_id(F.col("path")).alias("id"), F.lit("directory").alias("kind"), "path", F.element_at(F.split("path", "/"), -1).alias("name"), none.cast("string").alias("scope"), none.cast("int").alias("start_line"))
    symbols = scanned.where("what = 'symbol'").distinct()
    symbol_id = node_id(F.lit("symbol"), F.col("path"), F.col("name"), F.col("symbol_kind"), F.col("scope"), F.col("line"))
    symbol_nodes = symbols.select("workspace_id", symbol_id.alias("id"), F.lit("symbol").alias("kind"), "path", "name", "scope", F.col("line").alias("start_line"))
    edge = lambda df, kind, a, b, label: df.select("workspace_id", edge_id(F.lit(kind), a, b, F.lit(label)).alias("id"), F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), F.lit(label).alias("confidence"))
    found, lost = resolve_imports(scanned, files)
    target_id = node_id(F.lit("file"), F.col("target"), F.element_at(F.split("target", "/"), -1))
    full = F.concat_ws(".", "scope", "name")
    at = symbols.select("workspace_id", "path", full.alias("_full"), symbol_id.alias("_id")).groupBy("workspace_id", "path", "_full").agg(F.min("_id").alias("_id"))
    calls = resolve_calls(scanned)
    hit = calls.where("target_path is not null").select("workspace_id", "path", F.col("scope").alias("_full"), "target_path", F.concat_ws(".", "target_scope", "name").alias("_tfull"))
    hit = hit.join(at, ["workspace_id", "path", "_full"]).withColumnRenamed("_id", "_from")
    hit = hit.join(at.select("workspace_id", F.col("path").alias("target_path"), F.col("_full").alias("_tfull"), F.col("_id").alias("_to")), ["workspace_id", "target_path", "_tfull"])
    edges = (
        edge(own, "contains", folder_id(folder), file_id, "exact")
        .unionByName(edge(symbols, "declares", file_id, symbol_id, "exact"))
        .unionByName(edge(found, "imports", file_id, target_id, "resolved"))
        .unionByName(edge(hit, "calls", F.col("_from"), F.col("_to"), "heuristic"))
        .distinct()
    )
    only = files.where(F.col("path").isNotNull() & F.col("language").isin(*FILE_ONLY)).select("workspace_id", "path", F.lit("LEXICAL_FILE_ONLY").alias("code"), F.col("language").alias("message"))
    diagnostics = only.unionByName(lost.select("workspace_id", "path", F.lit("UNRESOLVED_IMPORT").alias("code"), F.col("name").alias("message"))).unionByName(calls.where("code is not null").select("workspace_id", "path", "code", F.col("name").alias("message"))).distinct()
    return file_nodes.unionByName(folder_nodes).unionByName(symbol_nodes), edges, diagnostics

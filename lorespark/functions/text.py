"""Tokens, estimates, links, path rules and redaction as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores of any script, with repetitions."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def ascii_words(text: Column) -> Column:
    """Distinct lower-case runs of ASCII letters, digits and underscores, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))))


def trigrams(text: Column) -> Column:
    """Distinct groups of three characters inside words."""
    long = F.filter(words(text), lambda w: F.length(w) > 2)
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def estimated_tokens(text: Column) -> Column:
    """1.3 times the words and single symbols, rounded up."""
    return F.ceil(F.lit(1.3) * F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{Z}\t\n\x0b\f\r\p{L}\p{N}]"))).cast("int")


# Languages by extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin", "kts": "kotlin", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp",
    "rb": "ruby", "php": "php", "sh": "shell", "bash": "shell", "zsh": "shell", "md": "markdown", "mdx": "markdown", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
}


def language(path: Column) -> Column:
    """By the last extension; ``text`` where it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))], F.lit("text"))


# Directories that are never scanned.
EXCLUDED = (".git", "node_modules", "vendor", "dist", "build", "coverage")


def excluded(path: Column, at_root: tuple[str, ...] = ()) -> Column:
    """Build output, dependencies, generated and minified files; ``at_root`` names directories that only count at the top."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED))) | F.element_at(parts, -1).rlike(r"(?i)(?:^|[._-])(generated|min)\.") | path.rlike(r"(?i)\.map$")
    return out | F.element_at(parts, 1).isin(*at_root) if at_root else out


def is_relative(path: Column) -> Column:
    """No leading slash, no backslash, no empty, ``.`` or ``..`` segment."""
    return path.isNotNull() & ~path.startswith("/") & ~path.contains("\\") & ~F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))


# Secrets and their placeholders, applied in this order. Borders are ASCII, spelled out because Java's \b isn't.
_B, _E = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
REDACTIONS = (
    (r"(?i)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED]"),
    (rf"(?i){_B}(?:proxy-)?authorization\s*[:=]\s*(?:bearer|basic)?\s*[A-Za-z0-9._~+/=-]{{8,}}", "authorization: [REDACTED]"),
    (rf"(?i){_B}bearer\s+[A-Za-z0-9._~+/=-]{{8,}}", "Bearer [REDACTED]"),
    (rf"(?i){_B}(?:api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|private[_-]?key|secret|token)\s*[:=]\s*[\"']?[A-Za-z0-9._~+/=-]{{8,}}[\"']?", "[REDACTED]"),
    (rf"(?i){_B}xox[baprs]-[A-Za-z0-9-]{{10,}}{_E}", "[REDACTED]"),
    (rf"{_B}sk-(?:proj-)?[A-Za-z0-9_-]{{12,}}{_E}", "[REDACTED]"),
    (rf"{_B}gh[pousr]_[A-Za-z0-9]{{20,}}{_E}", "[REDACTED]"),
    (rf"{_B}eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+{_E}", "[REDACTED]"),
    (rf"(?i){_B}(https?://)[^\s/@:]+:[^\s/@]+@", "$1[REDACTED]@"),
)
# Fixed value: names of fields that hold secrets, in snake case between underscores.
SENSITIVE_KEY = r"(?:^|[_-])(?:authorization|api[_-]?key|access[_-]?token|refresh[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|private[_-]?key|secret|token)(?:$|[_-])"


def redacted(text: Column) -> Column:
    """Secrets replaced by placeholders, NUL characters dropped."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REDACTIONS, F.translate(text, "\x00", ""))


def sensitive(text: Column) -> Column:
    """Whether redaction would change anything."""
    return ~text.eqNullSafe(redacted(text))


def sensitive_key(key: Column) -> Column:
    """Whether a field's name, in snake or camel case, announces a secret."""
    return F.lower(F.regexp_replace(key, "([a-z0-9])([A-Z])", "$1_$2")).rlike(SENSITIVE_KEY)


def redacted_map(values: Column) -> Column:
    """Values of sensitive keys hidden, all others redacted."""
    return F.transform_values(values, lambda k, v: F.when(sensitive_key(k), F.lit("[REDACTED]")).otherwise(redacted(v)))


def markdown_links(text: Column) -> Column:
    """Targets of inline links, in order."""
    return F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\]\(([^()\s]+)\)"), F.lit(1))


def canonical_time(text: Column) -> Column:
    """Whether a text is exactly ``YYYY-MM-DDTHH:MM:SS.mmmZ`` and names a real moment."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$") & F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") == text, F.lit(False))


def citation(path: Column, start_line: Column, end_line: Column) -> Column:
    """``path#L3-9``"""
    return F.format_string("%s#L%d-%d", path, start_line, end_line)

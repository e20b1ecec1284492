"""Column functions on text and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes that are scanned, and the grammar of a suffix.
SUPPORTED = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".cpp", ".c", ".h", ".go", ".rs", ".rb", ".php", ".cs", ".sh", ".yaml", ".yml", ".json"]
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp"}
#: The line separators of str.splitlines.
LINE_BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def tokenize(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores, of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)), lambda t: F.length(t) >= 2)


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines has them: no empty one at the end, none of an empty text."""
    lines = F.split(F.coalesce(text, F.lit("")), LINE_BREAKS)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def suffix(path: Column) -> Column:
    """The last suffix of the last component, case kept; '' for dot files, a dot at the end or none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_supported(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*SUPPORTED)


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, F.lower(suffix(path)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: The name in the first line: what follows "def ", or else "class ", or else "function ", up to the bracket or colon, or the next such word.
SYMBOL = r"^[^\n]*?def ((?:(?!def )[^(\n])*)|^(?![^\n]*def )[^\n]*?class ((?:(?!class )[^:\n])*)|^(?![^\n]*(?:def |class ))[^\n]*?function ((?:(?!function )[^(\n])*)"


def symbol_name(text: Column) -> Column:
    """SYMBOL of a text, trimmed; '' without one."""
    return F.coalesce(F.trim(F.concat(*[F.regexp_extract(text, SYMBOL, i) for i in (1, 2, 3)])), F.lit(""))


def symbol_of(text: str) -> str:
    """The same of one string."""
    m = re.match(SYMBOL, text)
    return (m[1] or m[2] or m[3] or "").strip() if m else ""

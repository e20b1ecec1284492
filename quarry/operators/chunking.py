"""Files to chunks: windows of lines, and symbols."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import content_hash, language, split_lines
from quarry.operators.braces import brace_symbols
from quarry.workers import ship

SIZE, OVERLAP, MOST_BYTES = 50, 5, 500 * 1024
PARSED = ["python", "c", "cpp", "javascript", "typescript"]
COLUMNS = ["project", "path", "chunk_idx", "chunk_id", "text", "type", "name", "line_start", "line_end", "start", "end", "offset_unit", "file_hash"]
_SYMBOLS = "project string, path string, chunk_idx int, text string, type string, name string, line_start int, line_end int, start int, end int, file_hash string"


def line_windows(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """COLUMNS for each window of `size` lines, `size - overlap` apart; a last window inside the one before stays, an empty file has none.

    files: project, path, text."""
    step = max(1, size - overlap)
    lines = files.select("project", "path", content_hash(F.col("text")).alias("file_hash"), split_lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    at = lines.select("*", F.posexplode(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(step))).alias("chunk_idx", "start"))
    end = F.least(F.col("start") + size, F.size("ls"))
    out = at.withColumn("end", end).withColumn("text", F.array_join(F.slice("ls", F.col("start") + 1, F.col("end") - F.col("start")), "\n"))
    return out.select("project", "path", "chunk_idx", F.concat_ws(":", "path", "chunk_idx").alias("chunk_id"), "text", F.lit("block").alias("type"), F.lit("").alias("name"), (F.col("start") + 1).alias("line_start"), F.col("end").alias("line_end"), "start", "end", F.lit("line").alias("offset_unit"), "file_hash")


def python_symbols(source: str) -> list[tuple]:
    """(text, type, name, line_start, line_end, start, end) of functions, classes and decorated definitions, in preorder; offsets in bytes.

    A decorated definition gives a chunk from its first decorator on, of type function, and then its own."""
    tree, raw = ast.parse(source), source.encode()
    starts = [0]
    for line in raw.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    out = []

    def chunk(first: tuple[int, int], node: ast.AST, kind: str) -> None:
        lo, hi = starts[first[0] - 1] + first[1], starts[node.end_lineno - 1] + node.end_col_offset
        out.append((raw[lo:hi].decode(), kind, node.name, first[0], node.end_lineno, lo, hi))

    def visit(node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                if x.decorator_list:
                    d = x.decorator_list[0]
                    chunk((d.lineno, d.col_offset - 1), x, "function")
                chunk((x.lineno, x.col_offset), x, "class" if isinstance(x, ast.ClassDef) else "function")
            visit(x)

    visit(tree)
    return out


def _parsed(files: DataFrame) -> DataFrame:
    """_SYMBOLS of files in the languages of PARSED; a file that doesn't parse, or has no symbols, is one row without a type that has its whole text."""
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, text, digest, tongue in b.itertuples(index=False):
                try:
                    found = python_symbols(text) if tongue == "python" else brace_symbols(text, tongue)
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                rows += [(project, path, i, *x, digest) for i, x in enumerate(found)] or [(project, path, 0, text, None, None, 0, 0, 0, 0, digest)]
            yield pd.DataFrame(rows, columns=["project", "path", "chunk_idx", "text", "type", "name", "line_start", "line_end", "start", "end", "file_hash"])

    return files.select("project", "path", "text", content_hash(F.col("text")).alias("file_hash"), language(F.col("path")).alias("language")).mapInPandas(run, _SYMBOLS)


def _parsable() -> Column:
    return F.coalesce(language(F.col("path")).isin(PARSED) & (F.octet_length("text") <= MOST_BYTES), F.lit(False))


def symbols(files: DataFrame) -> DataFrame:
    """COLUMNS of the symbols of files in the languages of PARSED; files that don't parse and others give no rows."""
    out = _parsed(files.where(_parsable())).where("type is not null")
    return out.withColumn("chunk_id", F.concat_ws(":", "path", "chunk_idx")).withColumn("offset_unit", F.lit("byte")).select(*COLUMNS)


def chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Symbols where a file has any, else windows of lines: other languages, over MOST_BYTES, unparsable, or without symbols.

    Each file is parsed once: what the parser gives back, symbol or text, is one stream, whose texts are cut where they stand."""
    rest = files.where(~_parsable()).select("project", "path", F.lit(0).alias("chunk_idx"), "text", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("name"), *[F.lit(0).alias(c) for c in ("line_start", "line_end", "start", "end")], content_hash(F.col("text")).alias("file_hash"))
    both = _parsed(files.where(_parsable())).unionByName(rest)
    fields = ["chunk_idx", "text", "line_start", "line_end", "start", "end"]
    step = max(1, size - overlap)

    def cut(lines: Column) -> Column:
        n = F.size(lines)
        at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
        end = lambda i: F.least(i + size, n)
        return F.transform(at, lambda i, k: F.struct(k.alias("chunk_idx"), F.array_join(F.slice(lines, i + 1, end(i) - i), "\n").alias("text"), (i + 1).alias("line_start"), end(i).alias("line_end"), i.alias("start"), end(i).alias("end")))

    windows = F.transform(F.array(split_lines(F.col("text"))), cut)[0]  # the one-element array binds the lines to a name
    own = F.when(F.col("type").isNull(), windows).otherwise(F.array(F.struct(*fields)))
    out = both.select("project", "path", "type", "name", "file_hash", F.explode(own).alias("w"))
    block = F.col("type").isNull()
    out = out.select("project", "path", *[F.col(f"w.{c}").alias(c) for c in fields], F.coalesce("type", F.lit("block")).alias("type"), F.coalesce("name", F.lit("")).alias("name"), F.when(block, "line").otherwise("byte").alias("offset_unit"), "file_hash")
    return out.withColumn("chunk_id", F.concat_ws(":", "path", "chunk_idx")).select(*COLUMNS)


def windows_of_lines(lines: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """path, chunk_idx, chunk_id, text, line_start, line_end: what line_windows() gives, from lines (path, line, from 0; text) of files that needn't fit into a row.

    A line goes to each window that it is in; a window is `size` lines."""
    step = max(1, size - overlap)
    first = F.greatest(F.lit(0), F.expr(f"(line - {size} + {step}) div {step}"))
    each = lines.select("path", "line", "text", F.explode(F.sequence(first.cast("long"), F.expr(f"line div {step}"))).alias("chunk_idx")).where(F.col("line") < F.col("chunk_idx") * step + size)
    own = each.groupBy("path", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("w"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    return own.select("path", F.col("chunk_idx").cast("int").alias("chunk_idx"), F.concat_ws(":", "path", "chunk_idx").alias("chunk_id"), F.array_join("w.text", "\n").alias("text"), (F.col("lo") + 1).cast("int").alias("line_start"), (F.col("hi") + 1).cast("int").alias("line_end"))


def chunker(files: DataFrame) -> DataFrame:
    """project, path, chunker: which one a file is offered to first."""
    big = F.octet_length("text") > MOST_BYTES
    return files.select("project", "path", F.when(big, "lines").when(language(F.col("path")).isNull(), "lines").otherwise("symbols").alias("chunker"), language(F.col("path")).alias("language"))

"""Helpers the operators of this subpackage share: scratch tables, size-checked broadcasts, ASCII lower case, word arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a whitespace-separated text, and words of ASCII letters, digits and anything beyond ASCII.
SPACE = r"[\x20\x09-\x0D]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of a batch of texts for Python, about.  The JVM holds a batch twice, in buffers that double as they grow, and the worker once.
BATCH_BYTES = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system for a URI as Spark writes it, and the path in it; Hadoop's names of the S3 connector are S3's."""
    scheme, sep, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if sep and scheme in ("s3a", "s3n") else uri)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Within, texts go to Python in batches of so many rows and some BATCH_BYTES at most, or of one longer row: both sides then hold a few MB of them at a time."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    old = [spark.conf.get(key) for key in keys]
    spark.conf.set(keys[0], str(min(rows, int(old[0])) if int(old[0]) > 0 else rows))
    spark.conf.set(keys[1], str(BATCH_BYTES))
    try:
        yield
    finally:
        for key, value in zip(keys, old, strict=True):
            spark.conf.set(key, value)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: lineage ends there, so a lost executor repeats little."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, most_rows: int) -> tuple[DataFrame, bool]:
    """(df with a broadcast hint, True) if a count finds at most most_rows rows, else (df, False): the planner shuffles it."""
    small = df.limit(most_rows + 1).count() <= most_rows
    return (F.broadcast(df) if small else df), small


def pinned(col: Column) -> Column:
    """col, evaluated where it stands and once a row.  The optimizer copies no nondeterministic expression into filters or
    lambdas; without this it would split a text anew for each word that a higher-order function looks at."""
    return F.when(F.monotonically_increasing_id() >= 0, col)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is.  lower() is right, and fast, where a text has ASCII only."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def letter_words(text: Column) -> Column:
    """Words of lower-cased text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def space_words(text: Column) -> Column:
    """Whitespace-separated words; null has none.  Texts with no white space but blanks and line feeds are split without a regular expression."""
    text = F.coalesce(text, F.lit(""))
    odd = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    return F.array_remove(F.when(odd, F.split(text, SPACE)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted_join(big: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """big joined to few by keys, of which each row of few is there once for each salt, so that a hot key of big is dealt to as many
    tasks.  big must come from a scan, whose rows keep their order when a task is repeated."""
    dealt = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(dealt, [*keys, "__salt"], how).drop("__salt")

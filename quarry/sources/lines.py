"""Lines of files of any size: byte ranges of a file are read by different tasks, and no row holds a file.

Spark's text source deals ranges that begin and end at line feeds.  How many lines stand before a range is a sum over the ranges'
counts, which are few; other line breaks than line feeds are found within what stands between two of these."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import split_lines


#: Tasks to each core that read ranges, and as many as a shuffle has at least.
TASKS = 8


def file_lines(spark: SparkSession, paths: str | list[str], scratch: str) -> DataFrame:
    """path, line (from 0), text of the lines of text files, as str.splitlines has them; bytes that aren't UTF-8 are dropped.

    Ranges are of spark.sql.files.maxPartitionBytes; a task reads as many of them as leave TASKS to each core, so that small ranges of a large input
    are not a task each.  scratch: a folder that all executors share, for the lines of each range: a range
    is read once, and keeps its order, whatever happens to a task.  A file without lines has none; a line must fit into a row."""
    raw = spark.read.option("lineSep", "\n").text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range"), F.col("_metadata.file_size").alias("size"))
    valid = F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit("")))
    raw = raw.coalesce(max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    own = raw.select("path", "range", "size", F.monotonically_increasing_id().alias("at"), (F.octet_length("value") + 1).alias("bytes"), F.posexplode(split_lines(F.concat(valid, F.lit("\n")))).alias("part", "text"))
    place = f"{scratch}/lines-{uuid.uuid4().hex}"
    own.write.parquet(place)
    own = spark.read.schema(own.schema).parquet(place)
    counts = own.groupBy("path", "range").agg(F.count("*").alias("n"), F.sum(F.when(F.col("part") == 0, F.col("bytes")).otherwise(0)).alias("bytes"), F.first("size").alias("size"))
    file, order = W.partitionBy("path"), W.partitionBy("path").orderBy("range")  # a row a range
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("path", "range", before.alias("before"), F.sum("n").over(file).alias("lines"), (F.sum("bytes").over(file) > F.col("size")).alias("open"))
    inner = own.withColumn("i", F.row_number().over(W.partitionBy("path", "range").orderBy("at", "part")) - 1)  # a range is bounded by its bytes
    line = (F.col("before") + F.col("i")).cast("long")
    found = inner.join(counts, ["path", "range"]).withColumn("line", line)
    none = F.col("open") & (line == F.col("lines") - 1) & (F.col("part") > 0) & (F.col("text") == "")  # behind another line break that ends a file without a line feed
    return found.where(~none).select("path", "line", "text")

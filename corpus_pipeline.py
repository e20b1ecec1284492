"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
documents.  run() writes what a stage returns as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, near_dedup, packing, quality_classifier, quality_rules
from quarry.llm._shared import arrow_rows, sized, staged, table

#: Ids of rows to keep or to drop that are broadcast at most; more are joined by shuffle.
MOST_IDS = 500_000
#: Near duplicates of this stage: five-word shingles, 80 per cent.
SHINGLE, PERCENT = 5, 80


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.  References are fitted on those labelled good."""
    refs = quality_rules.references(docs, table(spark, sf_dir, "labels"))
    return quality_rules.with_quality(docs, refs).where("__quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold go.  Learns from labelled documents that are still there.

    Rows are scored, and what is left is written, here: whoever writes the result would send texts to Python in batches of 10,000."""
    with arrow_rows(spark):
        model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
        scored = quality_classifier.with_scores(docs, model)
        return staged(scored.where(F.col("__score") >= quality_classifier.THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns]), "pipeline-scored")


def _rows_of(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """docs joined to keys (__id, __h) by id, nulls alike, and hash of the text."""
    return docs.join(keys, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__h")), how)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays, and of rows that repeat its id and text one.  Rows without words are in no group."""
    found = staged(near_dedup.near_duplicates(docs, SHINGLE, PERCENT), "pipeline-groups")
    keys = [F.col("doc_id").alias("__id"), F.col("text_hash").alias("__h")]
    gone, _ = sized(staged(found.where("not kept").select(*keys).distinct(), "pipeline-gone"), MOST_IDS)
    again = staged(found.where("kept and n_shingles > 0").groupBy(*keys).count().where("count > 1").drop("count"), "pipeline-again")
    kept = _rows_of(docs, gone, "left_anti")
    if again.isEmpty():
        return kept
    again, _ = sized(again, MOST_IDS)
    one = _rows_of(kept, again, "left_semi").withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).drop("__h")
    return _rows_of(kept, again, "left_anti").unionByName(one)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad, _ = sized(staged(found.where("contaminated").select(F.col("doc_id").cast("long").alias("__id"), F.col("text_hash").alias("__h")).distinct(), "pipeline-contaminated"), MOST_IDS)
    return _rows_of(docs, bad, "left_anti")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A classifier, and packing, aren't expressible in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None

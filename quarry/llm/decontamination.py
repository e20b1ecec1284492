"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every document's and item's 6-word grams are hashed; of each run of 8 neighbouring hashes the smallest (of equal ones the
first) is a fingerprint.  Two texts that share 13 words share 8 grams in a row, hence a fingerprint: no such span is missed.
Fingerprints of documents meet those of the items; each hit is then extended word by word, to both sides, as far as the
words themselves agree: 13 or more make all of them hit.  Seven words to each side are enough, for every window that
holds the gram lies within them, and all other windows of a longer span hold another fingerprint.

Items of under 13 words are one window; documents' words meet their longest word, then all their words are compared.

Documents are read once and not shuffled: their fingerprints stream past the items', which are broadcast after a count
(MOST_ITEM_ROWS); more than that are joined by shuffle, and the words of documents with a hit are fetched afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._shared import letter_words, pinned, sized, staged, table

WINDOW, GRAM = 13, 6
RUN = WINDOW - GRAM + 1
SIDE = WINDOW - GRAM
#: Rows of item fingerprints, of some 300 bytes each, that are broadcast at most.
MOST_ITEM_ROWS = 60_000
_LOW = (1 << 32) - 1
#: Key of the marks; those of fingerprints have 32 bits.
MARK = 1 << 40


def fingerprints(words: Column, least: int) -> Column:
    """Long numbers: the gram's hash in the high 32 bits, its start in the low 32.  None for texts of fewer than `least` words."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.shiftleft(F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]), 32).bitwiseOR(i.cast("long")))
    picked = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - RUN), lambda i: F.least(*[F.get(g, i + k) for k in range(RUN)])))
    return F.when(n >= max(least, WINDOW), F.get(F.transform(F.array(grams), picked), F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def _item_words(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("string").alias("item"), pinned(letter_words(F.col("text"))).alias("iw")).where(F.size("iw") > 0)


def _long_items(items: DataFrame) -> DataFrame:
    """key, item, left (words before the gram, nearest first), right (the gram and what follows)."""
    fp = items.where(F.size("iw") >= WINDOW).withColumn("fs", pinned(fingerprints(F.col("iw"), WINDOW))).select("item", "iw", F.explode("fs").alias("f"))
    at = F.col("f").bitwiseAND(F.lit(_LOW)).cast("int")
    fp = fp.select("item", "iw", F.shiftright("f", 32).cast("int").alias("key"), at.alias("q"))
    return fp.select("key", "item", F.reverse(F.slice("iw", F.greatest(F.col("q") - SIDE, F.lit(0)) + 1, F.least("q", F.lit(SIDE)))).alias("left"), F.slice("iw", F.col("q") + 1, GRAM + SIDE).alias("right"))


def _short_items(items: DataFrame) -> DataFrame:
    """anchor (the longest word, the first of equals), a (its place), item, iw."""
    short = items.where(F.size("iw") < WINDOW)
    best = F.array_max(F.transform("iw", lambda w, i: F.struct(F.char_length(w).alias("n"), (-i).alias("i"))))
    return short.withColumn("a", -best["i"]).select(F.get("iw", F.col("a")).alias("anchor"), "a", "item", "iw")


def _reach(one: Column, other: Column) -> Column:
    """How many words agree before the first that doesn't."""
    return (F.array_position(F.concat(F.zip_with(one, other, lambda x, y: F.coalesce(x == y, F.lit(False))), F.array(F.lit(False))), False) - 1).cast("int")


def _extended(met: DataFrame) -> DataFrame:
    """id, h, item, n, lo, hi (inclusive): the marks, and hits whose agreeing words make up a window."""
    back = _reach(F.reverse("before"), F.col("left"))
    ahead = _reach(F.slice("after", GRAM + 1, SIDE), F.slice("right", GRAM + 1, SIDE))
    whole = F.slice("after", 1, GRAM) == F.slice("right", 1, GRAM)
    met = met.select("id", "h", "item", "n", "p", F.when(whole, back).alias("b"), F.when(whole, ahead).alias("a")).where(f"item is null or b + a + {GRAM} >= {WINDOW}")
    return met.select("id", "h", "item", "n", (F.col("p") - F.col("b")).alias("lo"), (F.col("p") + GRAM + F.col("a") - 1).alias("hi"))


def contamination(docs: DataFrame, bench: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_words, n_hit, n_items, items (sorted strings), contaminated.

    Null and empty texts have no words and no hit; null ids count as an id.  Equal rows give equal results, one each.
    Rows of the same id but other texts are told apart by text_hash (xxhash64).  Items without words match nothing; an
    item's id is used as a string, null ids as 'null'.  Other columns of either table are not read."""
    items = _item_words(bench).withColumn("item", F.coalesce("item", F.lit("null")))
    base = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), pinned(letter_words(F.col(text))).alias("words"))
    longs, small = sized(_long_items(items), MOST_ITEM_ROWS)
    # The mark -1 comes first in every row, so that documents without a hit stay, with their number of words.  Fingerprints
    # are a column before they are exploded: then explosion, join and slicing are one generated loop, which copies no words.
    printed = base.withColumn("fs", pinned(F.concat(F.array(F.lit(-1).cast("long")), fingerprints(F.col("words"), WINDOW))))
    mark, w, p = F.col("f") == -1, F.col("words"), F.col("p")
    keyed = printed.select("id", "h", "words", F.explode("fs").alias("f")).select("id", "h", "words", F.when(mark, F.lit(MARK)).otherwise(F.shiftright("f", 32)).alias("key"), F.when(mark, -1).otherwise(F.col("f").bitwiseAND(F.lit(_LOW))).cast("int").alias("p"))
    around = [F.when(p < 0, F.size(w)).alias("n"), F.slice(w, F.greatest(p - SIDE, F.lit(0)) + 1, F.least(F.greatest(p, F.lit(0)), F.lit(SIDE))).alias("before"), F.slice(w, F.greatest(p, F.lit(0)) + 1, GRAM + SIDE).alias("after")]
    if small:
        none = F.array().cast("array<string>")
        one = items.sparkSession.range(1).select(F.lit(MARK).alias("key"), F.lit(None).cast("string").alias("item"), none.alias("left"), none.alias("right"))
        met = keyed.join(F.broadcast(longs.withColumn("key", F.col("key").cast("long")).unionByName(one)), "key").select("id", "h", "item", "p", *around, "left", "right")
    else:
        cand = keyed.drop("words").join(longs.withColumn("key", F.col("key").cast("long")), "key").drop("key").distinct()
        texts = base.dropDuplicates(["id", "h"]).withColumnsRenamed({"id": "i2", "h": "h2"})
        met = cand.join(texts, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2"))).select("id", "h", "item", "p", *around, "left", "right")
        none = F.lit(None).cast("array<string>")
        met = met.unionByName(base.select("id", "h", F.lit(None).cast("string").alias("item"), F.lit(-1).alias("p"), F.size("words").alias("n"), *[none.alias(c) for c in ("before", "after", "left", "right")]))
    met = _extended(staged(met, "op1-met"))
    short = _short_items(items)
    if not short.isEmpty():
        short, _ = sized(short, MOST_ITEM_ROWS)
        each = base.select("id", "h", "words", F.posexplode("words").alias("p", "w")).join(short, F.col("w") == F.col("anchor"))
        first = F.col("p") - F.col("a")
        each = each.where((first >= 0) & (F.slice("words", F.greatest(first, F.lit(0)) + 1, F.size("iw")) == F.col("iw")))
        met = met.unionByName(each.select("id", "h", "item", F.lit(None).cast("int").alias("n"), first.alias("lo"), (first + F.size("iw") - 1).alias("hi")))
    # Words hit, each once: no group is gathered but by counts, and a document's items.
    by = ["id", "h"]
    spots = met.select(*by, F.when(F.col("item").isNull(), F.array(F.lit(-1))).otherwise(F.sequence("lo", "hi")).alias("at"), "n", "item")
    spots = spots.select(*by, F.explode("at").alias("at"), "n")
    words = spots.groupBy(*by, "at").agg(F.max("n").alias("n"), F.count("n").alias("copies"))
    words = words.groupBy(*by).agg(F.max("n").cast("long").alias("n_words"), F.sum((F.col("at") >= 0).cast("long")).alias("n_hit"), F.max("copies").alias("copies"))
    per_item = met.where("item is not null").groupBy(*by, "item").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_item = per_item.withColumnsRenamed({"id": "i2", "h": "h2"})
    out = words.join(per_item, F.col("id").eqNullSafe(F.col("i2")) & (F.col("h") == F.col("h2")), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(F.col("id").alias("doc_id"), F.col("h").alias("text_hash"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (SELECT doc_id, i - 1 AS p, w[i] AS w FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents))),
     iw AS (SELECT item_id, w, least(13, len(w)) AS k FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
     wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM iw)),
     ks AS (SELECT DISTINCT k FROM wins),
     dl AS (SELECT doc_id, list(w ORDER BY p) AS w FROM dw GROUP BY doc_id),
     dg AS (SELECT doc_id, k, i - 1 AS p, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM dl, ks WHERE len(w) >= k)),
     hits AS (SELECT doc_id, item_id, p, k FROM dg JOIN wins USING (k, g)),
     nh AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS spot FROM hits) GROUP BY doc_id),
     ni AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
     n AS (SELECT doc_id, count(*) AS n_words FROM dw GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) AS contaminated
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

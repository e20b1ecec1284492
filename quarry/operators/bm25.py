"""Okapi BM25 as joins and aggregates.

Texts are tokenized once; term frequencies are pre-aggregated before they are shuffled.  A scored plan carries only the
queries' own terms past the tokenizer; document frequencies, which the floor of the idf needs for the whole vocabulary,
are one aggregate by term.

scores() gives every score, as joins.  top_batch() only gives the best of each of many queries: the queries' weights meet each block
of chunks in one matrix product, and k hits a query leave a task, so that no posting is shuffled.  Stored reads postings that an index
keeps in blocks, and skips those that can't change the result; where queries and postings meet in more than PAIRS pairs, it brings a
bucket's blocks together once for all queries, so that what is shuffled are the postings, whatever the number of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import tokenize
from quarry.operators.grid import HITS, grid
from quarry.workers import ship

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Scores are rounded, so that equal texts tie in whatever order their terms were summed.
DIGITS = 9
#: Query terms (query, term, count) that are broadcast at most.
MOST_TERMS = 100_000
#: Terms that stand in a filter at most.
MOST_LITERALS = 2000
#: Queries that are sent to every task at most (more meet the chunks in a grid), and numbers of a block's matrix.
QUERIES, CELLS = 1024, 2_000_000
#: Chunks of a bucket of stored postings, and buckets that a query's first look takes.
BUCKET, FIRST = 128, 8
#: Chunks of an index from which a second look costs less than the blocks that it saves.
SKIPS = 200_000
#: Pairs of a query and a posting of its terms that are joined at most, and chunks whose blocks are scored at once.
PAIRS, AT_ONCE = 2_000_000, 1024
#: Tokens of a task that makes blocks.
PART_TOKENS = 2_000_000
BLOCK = "term string, bucket bigint, max_tf bigint, min_dl int, n int, postings array<struct<id:bigint,tf:bigint,dl:int>>, project string"


def tokens(chunks: DataFrame) -> DataFrame:
    """id, tokens of chunks (id, text) that have a text."""
    return chunks.where("text <> ''").select("id", tokenize(F.col("text")).alias("tokens"))


def postings(toks: DataFrame) -> DataFrame:
    """id, term, tf."""
    return toks.select("id", F.explode("tokens").alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(toks: DataFrame) -> DataFrame:
    """n, avgdl: one row."""
    return toks.agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("avgdl"))


def document_frequencies(toks: DataFrame) -> DataFrame:
    """term, df."""
    return toks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def raw_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf; negative values become EPSILON times the mean of all raw ones."""
    raw = df.crossJoin(F.broadcast(stats.select("n"))).select("term", "df", raw_idf(F.col("n"), F.col("df")).alias("raw"))
    eps = raw.agg((EPSILON * F.avg("raw")).alias("eps"))
    return raw.crossJoin(F.broadcast(eps)).select("term", "df", F.when(F.col("raw") < 0, F.col("eps")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf of queries (query_id, text)."""
    return queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(toks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score for every chunk that has a term of the query.  Repeated query terms count as often."""
    stats = corpus_stats(toks)
    terms = query_terms(queries)
    known = terms.select("term").distinct()
    small = known.limit(MOST_TERMS + 1).count() <= MOST_TERMS
    hint = F.broadcast if small else (lambda df: df)
    weights = idf(document_frequencies(toks), stats)
    asked = hint(terms.join(weights, "term").select("query_id", "term", "qtf", "idf"))
    own = toks.select("id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(hint(known), "term", "left_semi")
    own = own.groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))
    met = own.join(asked, "term").crossJoin(F.broadcast(stats))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, sparse_rank of the k best with a positive score; equal scores by id.  k <= 0 gives nothing."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.where("score > 0").withColumn("sparse_rank", F.row_number().over(order)).where(F.col("sparse_rank") <= k)


def length_class(dl: Column) -> Column:
    """Lengths within a twelfth or so of one another are a class."""
    return F.floor(8 * F.log2(dl)).cast("bigint")


def blocks(toks: DataFrame, length: int = 0) -> DataFrame:
    """BLOCK of toks (project, id, tokens; of `length` tokens together): each term's postings by buckets of some BUCKET chunks of a project.

    Chunks are shuffled, with all their tokens, by bucket, and their postings made there: no posting is shuffled before it is in a block.

    A bucket's chunks are of like length, so that what a block can add to a score, which its largest tf and smallest length bound,
    differs from bucket to bucket: short chunks' buckets are looked at first, long ones' are hardly ever read."""
    own = toks.where(F.size("tokens") > 0).select("project", "id", F.size("tokens").alias("dl"), "tokens").withColumn("c", length_class(F.col("dl")))
    sizes = own.groupBy("project", "c").agg(F.ceil(F.count("*") / BUCKET).cast("bigint").alias("parts"))
    bucket = F.shiftleft(F.col("c"), 40) + F.pmod(F.xxhash64("id"), F.col("parts"))
    n = max(int(toks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-length // PART_TOKENS))
    each = own.join(sizes, ["project", "c"]).select("project", bucket.alias("bucket"), "id", "dl", "tokens").repartition(n, "project", "bucket")
    each = each.select("project", "bucket", "id", "dl", F.explode("tokens").alias("term"))
    each = each.groupBy("project", "term", "bucket", "id", "dl").agg(F.count("*").alias("tf"))
    return each.groupBy("project", "term", "bucket").agg(F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("id", "tf", "dl")).alias("postings"))


class Stored:
    """Postings that are stored in blocks, and term statistics: what scores of queries come from.

    posted: BLOCK; terms: term, df; n, length: chunks and their tokens; raw: the mean of all raw idf values, where it is known.  Only blocks
    of the queries' terms are read, by a filter that reaches the files where the terms are MOST_LITERALS at most."""

    def __init__(self, posted: DataFrame, terms: DataFrame, n: int, length: int, raw: float | None, queries: DataFrame):
        spark, asked = queries.sparkSession, query_terms(queries)
        rows = asked.limit(MOST_TERMS + 1).collect()
        names = sorted({r["term"] for r in rows})
        few = len(rows) <= MOST_TERMS
        known = F.broadcast(spark.createDataFrame([(x,) for x in names], "term string")) if few else asked.select("term").distinct()
        mine = lambda df: df.where(F.col("term").isin(names)) if few and len(names) <= MOST_LITERALS else df.join(known, "term", "left_semi")
        if raw is None:
            merged = terms.groupBy("term").agg(F.sum("df").alias("df"))
            raw = merged.agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0] or 0.0
        own = mine(terms).groupBy("term").agg(F.sum("df").alias("df")).withColumn("raw", raw_idf(F.lit(n), F.col("df")))
        own = own.select("term", "df", F.when(F.col("raw") < 0, EPSILON * raw).otherwise(F.col("raw")).alias("idf"))
        self.asked, self.pairs = None, 0
        if few:  # two numbers for each of the queries' terms
            found = own.collect()
            idf, df = {r["term"]: r["idf"] for r in found}, {r["term"]: r["df"] for r in found}
            self.pairs = sum(df.get(r["term"], 0) for r in rows)
            weights = [(r["query_id"], r["term"], r["qtf"] * idf[r["term"]] * (K1 + 1)) for r in rows if r["term"] in idf]
            self.kind = asked.schema["query_id"].dataType.simpleString()
            if self.kind in ("tinyint", "smallint", "int", "bigint"):
                self.asked = [w for w in weights if w[0] is not None]
            self.weights = F.broadcast(spark.createDataFrame(weights, f"query_id {asked.schema['query_id'].dataType.simpleString()}, term string, w double"))
        else:
            self.weights = asked.join(own, "term").select("query_id", "term", (F.col("qtf") * F.col("idf") * (K1 + 1)).alias("w"))
        self.n = n
        self.posted, self.avgdl = mine(posted), length / n if length else 1.0

    def part(self, tf: Column, dl: Column) -> Column:
        return F.col("w") * tf / (tf + K1 * (1 - B + B * dl / F.lit(self.avgdl)))

    def bounds(self) -> DataFrame:
        """query_id, project, bucket, bound (no score in the bucket is above it), n_blocks, from the blocks' heads only."""
        heads = self.posted.select("project", "term", "bucket", "max_tf", "min_dl").join(self.weights, "term")
        most = F.greatest(F.lit(0.0), self.part(F.col("max_tf"), F.col("min_dl")))
        return heads.groupBy("query_id", "project", "bucket").agg(F.sum(most).alias("bound"), F.count("*").alias("n_blocks"))

    def scores(self, buckets: DataFrame | None = None) -> DataFrame:
        """query_id, id, score of the chunks that have a term of the query, of all or of these buckets (query_id, project, bucket)."""
        met = self.posted.join(self.weights, "term")
        if buckets is not None:
            met = met.join(buckets.select("query_id", "project", "bucket"), ["query_id", "project", "bucket"])
        each = met.select("query_id", "w", F.explode("postings").alias("p"))
        return each.groupBy("query_id", F.col("p.id").alias("id")).agg(F.round(F.sum(self.part(F.col("p.tf"), F.col("p.dl"))), DIGITS).alias("score"))

    def looks(self, k: int, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
        """Buckets that are scored first, those of the highest bounds of each query; and those that can still beat the kth of their scores."""
        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "project", "bucket")
        ranked = self.bounds().where("bound > 0").withColumn("r", F.row_number().over(order))
        head = ranked.where(F.col("r") <= first)
        kth = top(self.scores(head), k).where(F.col("sparse_rank") == k).select("query_id", F.col("score").alias("kth"))
        rest = self.bounds().where("bound > 0").join(head.select("query_id", "project", "bucket"), ["query_id", "project", "bucket"], "left_anti")
        rest = rest.join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 1e-6))
        return head, rest

    def top(self, k: int, first: int = FIRST, least: int = SKIPS) -> DataFrame:
        """What top(scores(toks, queries), k) gives, without scoring buckets that can't have any of it; all of an index under `least` chunks.

        Up to PAIRS pairs, blocks are joined to queries, and those of buckets that can't matter aren't read; more, by together()."""
        if self.asked and self.pairs > PAIRS and k > 0:
            return top(self.together(k), k)
        if self.n < least:
            return top(self.scores(), k)
        head, rest = self.looks(k, max(first, -(-2 * k // BUCKET)))
        return top(self.scores(head).unionByName(self.scores(rest)), k)


    def together(self, k: int) -> DataFrame:
        """query_id, id, score: the k best of each query of each task, to which a bucket's blocks are brought together."""
        spark = self.posted.sparkSession
        ship(spark)
        names = sorted({t for _, t, _ in self.asked})
        ids, place = sorted({q for q, _, _ in self.asked}), {t: i for i, t in enumerate(names)}
        number = {q: i for i, q in enumerate(ids)}
        triples = sorted((place[t], number[q], w) for q, t, w in self.asked)
        term, query, weight = (np.array(x) for x in zip(*triples, strict=True))
        shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.searchsorted(term, np.arange(len(names) + 1)), query, weight))
        avgdl = self.avgdl
        codes = F.broadcast(spark.createDataFrame(list(enumerate(names)), "code int, term string"))
        each = self.posted.join(codes, "term").select(F.xxhash64("project", "bucket").alias("key"), "code", "max_tf", "min_dl", F.col("postings.id").alias("ids"), F.col("postings.tf").alias("tfs"), F.col("postings.dl").alias("dls"))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), self.n // 50_000)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            work = Gathered(*shared.value, avgdl, k)
            for b in batches:
                work.add(b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work.hits()], ["query_id", "id", "value"])

        return each.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, HITS).select(F.col("query_id").cast(self.kind).alias("query_id"), "id", F.col("value").alias("score"))


class Gathered:
    """The k best positive scores of each query over blocks that come bucket by bucket: columns key, code, max_tf, min_dl, ids, tfs, dls.

    Weights are (query, weight) by code: of code c those from first[c] to first[c + 1].  Buckets are put together until they have AT_ONCE
    chunks or so; those whose bound is under what every query holds already are not scored."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, query: np.ndarray, weight: np.ndarray, avgdl: float, k: int):
        self.ids, self.first, self.query, self.weight, self.avgdl, self.k = ids, first, query, weight, avgdl, k
        self.best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]
        self.least = np.zeros(len(ids))
        self.key, self.parts, self.held = None, [], 0
        self.ready: list[list[pa.RecordBatch]] = []

    def add(self, b: pa.RecordBatch) -> None:
        key = b.column(0).to_numpy()
        edges = (np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()
        for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
            if hi == lo:
                continue
            if self.parts and key[lo] != self.key:
                self._whole()
            self.key = key[lo]
            self.parts.append(b.slice(lo, hi - lo))

    def _whole(self) -> None:
        """The bucket at hand is whole: it waits to be scored, unless it can't matter."""
        own, self.parts = self.parts, []
        code, tf, dl = (np.concatenate([p.column(i).to_numpy() for p in own]).astype(np.float64 if i > 1 else np.int64) for i in (1, 2, 3))
        most, (row, query, weight) = self._part(tf, dl), self._weights(code)
        bound = np.bincount(query, np.maximum(0, weight * most[row]), len(self.ids))
        if (bound >= self.least - 1e-6).any() and (bound > 0).any():
            self.ready.append(own)
            self.held += max(pc.max(pc.list_value_length(p.column(4))).as_py() or 0 for p in own)
            if self.held >= AT_ONCE:
                self._score()

    def _part(self, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return tf / (tf + K1 * (1 - B + B * dl / self.avgdl))

    def _weights(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each of the rows of these codes its weights: row, query, weight."""
        n = self.first[code + 1] - self.first[code]
        row = np.repeat(np.arange(len(code)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[code], n)
        return row, self.query[at], self.weight[at]

    def _score(self) -> None:
        own = [p for parts in self.ready for p in parts]
        self.ready, self.held = [], 0
        if not own:
            return
        code = np.concatenate([p.column(1).to_numpy() for p in own]).astype(np.int64)
        size = np.concatenate([pc.list_value_length(p.column(4)).to_numpy(zero_copy_only=False) for p in own]).astype(np.int64)
        ids, tf, dl = (np.concatenate([p.column(i).flatten().to_numpy(zero_copy_only=False) for p in own]) for i in (4, 5, 6))
        chunk, at = np.unique(ids, return_inverse=True)
        term, of = np.unique(code, return_inverse=True)
        of, value = np.repeat(of, size), self._part(tf.astype(np.float64), dl.astype(np.float64))
        row, query, weight = self._weights(term)
        step = max(1, CELLS // len(term))
        for lo in range(0, len(chunk), step):
            hi = min(lo + step, len(chunk))
            mine = (at >= lo) & (at < hi)
            a = np.bincount((at[mine] - lo) * len(term) + of[mine], value[mine], (hi - lo) * len(term)).reshape(hi - lo, len(term))
            wide = max(1, CELLS // max(len(term), hi - lo))
            for q in range(0, len(self.ids), wide):
                some = (query >= q) & (query < q + wide)
                w = np.zeros((len(term), min(wide, len(self.ids) - q)))
                w[row[some], query[some] - q] = weight[some]
                self._keep(chunk[lo:hi], np.round(a @ w, DIGITS), q)

    def _keep(self, chunk: np.ndarray, score: np.ndarray, q: int) -> None:
        full = np.array([len(i) == self.k for i, _ in self.best[q : q + score.shape[1]]])
        good = (score > 0) & (~full | (score >= self.least[q : q + score.shape[1]]))
        for j in np.flatnonzero(good.any(0)).tolist():
            hit = np.flatnonzero(good[:, j])
            i, s = np.concatenate([self.best[q + j][0], chunk[hit]]), np.concatenate([self.best[q + j][1], score[hit, j]])
            order = np.lexsort((i, -s))[: self.k]
            self.best[q + j] = i[order], s[order]
            if len(order) == self.k:
                self.least[q + j] = s[order[-1]]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.parts:
            self._whole()
        self._score()
        return np.repeat(self.ids, np.array([len(i) for i, _ in self.best], np.int64)), np.concatenate([np.zeros(0, np.int64), *[i for i, _ in self.best]]), np.concatenate([np.zeros(0), *[s for _, s in self.best]])


class Weighted:
    """The k best positive scores of each of some queries over blocks of chunks' tokens, by one matrix product a block."""

    def __init__(self, ids: np.ndarray, words: pa.ListArray, weights: pa.ListArray, avgdl: float, k: int):
        self.ids, self.avgdl, self.k = ids, avgdl, k
        flat = words.flatten()
        self.known = pc.unique(flat)
        self.q = np.zeros((len(ids), len(self.known)))
        row = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
        self.q[row, pc.index_in(flat, value_set=self.known).to_numpy(zero_copy_only=False)] = weights.flatten().to_numpy(zero_copy_only=False)
        self.best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def add(self, items: pa.RecordBatch) -> None:
        width = len(self.known)
        step = max(1, CELLS // max(1, width))
        for first in range(0, len(items), step):
            b = items.slice(first, step)
            dl = pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            code = pc.fill_null(pc.index_in(b.column(1).flatten(), value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            spot = (np.repeat(np.arange(len(b)), dl) * width + code)[code >= 0]
            tf = np.bincount(spot, minlength=len(b) * width).reshape(len(b), width).astype(np.float64)
            score = np.round((tf / (tf + (K1 * (1 - B + B * dl / self.avgdl))[:, None])) @ self.q.T, DIGITS)
            own = b.column(0).to_numpy()
            for j in range(len(self.ids)):
                hit = np.flatnonzero(score[:, j] > 0)
                if len(hit) > self.k:
                    hit = hit[score[hit, j] >= np.partition(score[hit, j], len(hit) - self.k)[len(hit) - self.k]]
                if len(hit):
                    i, s = np.concatenate([self.best[j][0], own[hit]]), np.concatenate([self.best[j][1], score[hit, j]])
                    order = np.lexsort((i, -s))[: self.k]
                    self.best[j] = i[order], s[order]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(self.ids, np.array([len(i) for i, _ in self.best], np.int64)), np.concatenate([np.zeros(0, np.int64), *[i for i, _ in self.best]]), np.concatenate([np.zeros(0), *[s for _, s in self.best]])


def top_batch(toks: DataFrame, queries: DataFrame, k: int, few: int = QUERIES) -> DataFrame:
    """What top(scores(toks, queries), k) gives.  Up to `few` queries, of MOST_TERMS terms together, are sent to every task; more meet the chunks in a grid."""
    spark = toks.sparkSession
    ship(spark)
    stats = corpus_stats(toks)
    n, avgdl = stats.first()
    if not n or k <= 0 or not avgdl:
        return top(spark.createDataFrame([], "query_id bigint, id bigint, score double"), k)
    weighted = query_terms(queries).join(idf(document_frequencies(toks), stats), "term").select(F.col("query_id").cast("long").alias("id"), F.struct("term", (F.col("qtf") * F.col("idf") * (K1 + 1)).alias("w")).alias("t"))
    asked = weighted.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("id", F.col("t.term").alias("words"), F.col("t.w").alias("weights"))
    items = toks.select(F.col("id").cast("long").alias("id"), F.col("tokens").alias("words"))
    head = asked.limit(few + 1).toArrow()
    if len(head) > few or sum(map(len, head.column(1))) > MOST_TERMS:
        none = F.lit(None).cast("array<double>").alias("weights")
        found = grid(asked, items.select("*", none), asked.count(), lambda _, q: Weighted(q.column(0).to_numpy(), q.column(1).combine_chunks(), q.column(2).combine_chunks(), avgdl, k))
    else:
        shared = spark.sparkContext.broadcast([c.combine_chunks() for c in head.columns])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, words, weights = shared.value
            work = Weighted(ids.to_numpy(), words, weights, avgdl, k)
            for b in batches:
                work.add(b)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in work.hits()], ["query_id", "id", "value"])

        found = items.mapInArrow(run, HITS)
    return top(found.withColumnRenamed("value", "score"), k)

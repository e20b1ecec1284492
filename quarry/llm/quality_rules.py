"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of its language's common words are held against references of the language,
by Jensen-Shannon distance (base 2, 0 to 1).  References are fitted on trusted documents: all that are labelled good.  A
language with fewer than MIN_TRUSTED of them has no reference, and a
document without a reference is not judged by distance; neither is one in another script than the reference's, whatever its
language column says, nor source code.  Base rules hold for all.  References are a few numbers a language; no document is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._shared import letter_words, pinned, sized, space_words, staged, table

CLASSES = ("lower", "upper", "digit", "space", "punctuation", "symbol", "wide")
N_COMMON, MIN_TRUSTED, MOST_LABELS = 20, 20, 1_000_000
#: Trusted documents that the SQL takes; up to so many it and references() fit on the same ones.
MOST_TRUSTED = 1000
MIN_WORDS_CHARS, MIN_WORDS_WORDS = 20, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.28
#: Share of characters beyond ASCII, among those that aren't white space, above the reference's, from which a text is of another script.
OTHER_SCRIPT = 0.3
#: Lines of source code: indented, with an end or a beginning that prose hasn't; and their share from which a text is code.
CODE_LINE, CODE_SHARE = r"^(\t| {2,})[^ \t]|[;{}()\[\]:=][ \t]*$|^[ \t]*(#|//|/\*|import |from |def |class |return |function )", 0.5


class Reference(NamedTuple):
    """Of a language: shares of CLASSES, its common words, their shares and that of all other words."""

    chars: list[float]
    words: list[str]
    shares: list[float]


References = dict[str, Reference]


def _lang(docs: DataFrame) -> Column:
    return F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")


def _marks(text: Column) -> Column:
    """What is left of the text without a-z and white space: short, so that each class of it is counted in little time."""
    return F.regexp_replace(text, F.lit(r"[a-z\x20\x09-\x0D]+"), F.lit(""))


def _symbols(marks: Column) -> Column:
    return F.regexp_count(marks, F.lit("[#*$%&|<>]"))


def _classes(text: Column, word_chars: Column, marks: Column, symbols: Column) -> Column:
    """Counts of CLASSES; they add up to the number of characters."""
    chars = F.char_length(text)
    upper, digit = F.regexp_count(marks, F.lit("[A-Z]")), F.regexp_count(marks, F.lit("[0-9]"))
    punctuation = F.regexp_count(marks, F.lit(r"[!-/:-@\[-`{-~]")) - symbols
    wide = F.when(F.octet_length(text) == chars, 0).otherwise(F.regexp_count(marks, F.lit(r"[^\x00-\x7F]")))
    space = chars - word_chars
    return F.array(*[c.cast("long") for c in (chars - space - upper - digit - punctuation - symbols - wide, upper, digit, space, punctuation, symbols, wide)])


def _among(known: list[str]):
    return lambda w: w.isin(*known)


def _common(words: Column, lang: Column, refs: References) -> Column:
    """Counts of the language's common words, then of all other words; null without a reference."""
    kept = listed = F.lit(None)
    for code, ref in refs.items():
        kept = F.when(lang == code, F.filter(words, _among(ref.words))).otherwise(kept)
        listed = F.when(lang == code, F.array(*map(F.lit, ref.words))).otherwise(listed)
    if not refs:
        return F.lit(None).cast("array<bigint>")
    found = F.transform(F.array(kept), lambda k: F.transform(listed, lambda w: F.size(k) - F.size(F.array_remove(k, w))))  # the one-element array binds kept to a name
    return F.transform(found, lambda c: F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0), lambda a, b: a + b))))[0].cast("array<bigint>")


def _at(words: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, i + k) for k in range(n)])


def repeated_words(words: Column, hashes: Column) -> Column:
    """Number of words in windows of eight that stand in the text twice or more.

    hashes: of the windows by start.  Where all differ, none repeats.  Else (hash, start) is sorted: equal windows are neighbours."""
    n = F.size(hashes)
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(order: Column) -> Column:
        like = lambda h, j: F.coalesce(F.get(order, j)["h"] == h, F.lit(False))
        return F.sort_array(F.transform(F.filter(order, lambda x, j: like(x["h"], j - 1) | like(x["h"], j + 1)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(8), F.coalesce(F.get(p, i + 1) - x, F.lit(8)))), F.lit(0), lambda a, b: a + b)

    at = F.transform(F.array(order), starts)  # one-element arrays bind a value to a name
    return F.when(n.isNull() | (n == F.size(F.array_distinct(hashes))), 0).otherwise(F.get(F.transform(at, covered), F.lit(0))).cast("long")


def trusted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that are labelled good."""
    good, _ = sized(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct(), MOST_LABELS)
    return docs.join(good, F.col("doc_id").cast("long") == F.col("__id"), "left_semi")


def references(docs: DataFrame, labels: DataFrame) -> References:
    """Fitted on all trusted documents with MIN_WORDS_CHARS words or more; no labels, no references.

    One pass: a document's words, and what its characters and itself add, are counts under names.  Names of the latter begin with a
    blank, which no word has.  What is left is a row for each word of a language."""
    one = trusted(docs.where("lang is not null"), labels).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    one = one.withColumn("words", pinned(space_words(F.col("text")))).where(F.size("words") >= MIN_WORDS_CHARS).withColumn("marks", pinned(_marks(F.col("text"))))
    text, words, marks = F.col("text"), F.col("words"), F.col("marks")
    one = one.select("lang", pinned(_classes(text, F.char_length(F.array_join(words, "")), marks, _symbols(marks))).alias("c"), pinned(letter_words(text)).alias("w"))
    named = lambda name, k: F.struct(F.lit(name).alias("word"), k.cast("long").alias("k"))
    own = F.array(named(" n", F.lit(1)), named(" words", F.size("w")), *[named(f" {i}", F.get("c", F.lit(i))) for i in range(len(CLASSES))])
    each = one.select("lang", F.explode(F.concat(F.transform("w", lambda w: F.struct(w.alias("word"), F.lit(1).cast("long").alias("k"))), own)).alias("x"))
    counts = staged(each.groupBy("lang", F.col("x.word").alias("word")).agg(F.sum("x.k").alias("k")), "op4-references")
    total = lambda name: F.sum(F.when(F.col("word") == name, F.col("k"))).alias(name.strip())
    sums = counts.where("word like ' %'").groupBy("lang").agg(*[total(f" {x}") for x in ("n", "words", *range(len(CLASSES)))]).where(F.col("n") >= MIN_TRUSTED)
    first = counts.where("word not like ' %'").withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("k"), "word"))).where(F.col("r") <= N_COMMON)
    tops: dict[str, list] = {}
    for r in first.join(F.broadcast(sums.select("lang")), "lang", "left_semi").orderBy("lang", "r").collect():  # N_COMMON of each language
        tops.setdefault(r["lang"], []).append((r["word"], r["k"]))
    out = {}
    for r in sums.orderBy("lang").collect():
        cs, top = [r[str(i)] for i in range(len(CLASSES))], tops.get(r["lang"], [])
        total = r["words"] or 1
        out[r["lang"]] = Reference([c / sum(cs) for c in cs], [w for w, _ in top], [k / total for _, k in top] + [(total - sum(k for _, k in top)) / total])
    return out


def distance(counts: Column, total: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of counts / total and ref; null without either."""
    def term(c, q):
        p = c / total
        m = (p + q) / 2
        return F.when(p > 0, p * F.ln(p / m)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / m)).otherwise(0.0)

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(counts, ref, term), F.lit(0.0), lambda a, b: a + b)) / F.lit(2 * 0.6931471805599453))


def _by_language(lang: Column, shares: dict[str, list[float]]) -> Column:
    out = F.lit(None).cast("array<double>")
    for code, own in shares.items():
        out = F.when(lang == code, F.array(*map(F.lit, own))).otherwise(out)
    return out


def with_quality(docs: DataFrame, refs: References | None = None, name: str = "__quality") -> DataFrame:
    """docs and one struct column `name` by references(): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    Null and empty texts have no words and fail the base rules.  A null language, one without a reference, another script and source
    code: not judged, both distances are null.  Texts under MIN_WORDS_CHARS words have no distances, under MIN_WORDS_WORDS none by
    words.  Other columns, rows that repeat and null ids pass unchanged; a column called `name` is replaced.  A text's words, and
    hashes of its windows, are arrays in its row: a text of any length must fit there some ten times over."""
    refs = refs or {}
    keep = [c for c in docs.columns if c != name]
    text, words, lang = F.coalesce(F.col("text"), F.lit("")), F.col("__words"), F.col("__language")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], _lang(docs).alias("__language")).withColumns({"__words": pinned(space_words(F.col("text"))), "__marks": pinned(_marks(text))})
    df = df.withColumn("__wh", pinned(F.transform("__words", lambda w: F.xxhash64(w))))
    n = F.size("__words")
    df = df.withColumn("__h", pinned(F.when(n >= 8, F.transform(F.sequence(F.lit(0), F.greatest(n - 8, F.lit(0))), lambda i: _at(F.col("__wh"), i, 8)))))
    df = df.withColumn("__letters", pinned(F.when(lang.isin(*refs) & (n >= MIN_WORDS_WORDS), letter_words(text)) if refs else F.lit(None).cast("array<string>")))
    symbols = _symbols(F.col("__marks"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(
        *[F.col(f"`{c}`") for c in keep], "__language", n.cast("long").alias("__n"), F.char_length(F.array_join("__words", "")).cast("long").alias("__wc"), pinned(F.char_length(text)).alias("__chars"), symbols.cast("long").alias("__sy"), pinned(lines).alias("__lines"), "__marks",
        pinned(repeated_words(words, F.col("__h"))).alias("__rep"), pinned(_common(F.col("__letters"), lang, refs)).alias("__cw"), F.size("__letters").alias("__ln"),
    )
    df = df.withColumn("__cc", pinned(_classes(text, F.col("__wc"), F.col("__marks"), F.col("__sy"))))
    rc, rw = _by_language(lang, {k: r.chars for k, r in refs.items()}), _by_language(lang, {k: r.shares for k, r in refs.items()})
    other = F.get("__cc", F.lit(6)) > (OTHER_SCRIPT + F.get(rc, F.lit(6))) * F.col("__wc")
    df = df.withColumns({
        "__dup": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__cd": pinned(F.when((F.col("__n") >= MIN_WORDS_CHARS) & ~other, distance(F.col("__cc"), F.col("__chars"), rc))),
        "__wd": pinned(F.when((F.col("__n") >= MIN_WORDS_WORDS) & (F.col("__ln") > 0) & ~other, distance(F.col("__cw"), F.col("__ln"), rw))),
        "__failed": (F.col("__n") < 20) | (100 * F.col("__rep") > 30 * F.col("__n")),
    })
    far = F.coalesce(F.col("__cd") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("__wd") > MAX_WORD_DISTANCE, F.lit(False))
    code = F.size(F.filter("__lines", lambda x: x.rlike(CODE_LINE))) >= CODE_SHARE * F.size("__lines")
    df = df.withColumn("__code", pinned(F.when(far, code).otherwise(False)))
    judged = lambda c: F.when(~F.col("__code"), F.col(c))
    parts = {"n_words": "__n", "word_chars": "__wc", "n_symbols": "__sy", "n_dup_lines": "__dup", "n_repeat_words": "__rep", "base_failed": "__failed"}
    return df.select(*[F.col(f"`{c}`") for c in keep], F.struct(*[F.col(v).alias(k) for k, v in parts.items()], judged("__cd").alias("char_distance"), judged("__wd").alias("word_distance"), (~F.col("__failed") & (~far | F.col("__code"))).alias("kept")).alias(name))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return with_quality(docs, references(docs, table(spark, sf_dir, "labels"))).select("doc_id", *[F.col(f"__quality.{c}").alias(c) for c in out])


def _oracle() -> str:
    words = r"regexp_extract_all(x, '[^\x20\x09-\x0D]+')"
    number = lambda pattern: f"length(regexp_replace(x, '[^{pattern}]', '', 'g'))"
    term = lambda p, q: f"CASE WHEN {p} > 0 THEN {p} * ln({p} / (({p} + {q}) / 2)) ELSE 0 END"
    both = lambda counts, total, ref: f"sqrt(greatest(0, list_sum(list_transform(list_zip({counts}, {ref}), lambda z: {term(f'(z[1] / {total})', 'z[2]')} + {term('z[2]', f'(z[1] / {total})')}))) / (2 * ln(2)))"
    code = CODE_LINE.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, lang AS g FROM documents),
     a AS (SELECT *, {words} AS w, regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS lw, length(x) AS chars, {number("A-Z")} AS up, {number("0-9")} AS dg, {number(r"!-/:-@\[-`{-~")} AS mk, {number("#*$%&|<>")} AS sy, {number(r"^\x00-\x7F").replace("[^^", "[")} AS wide,
              list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
     b AS (SELECT *, len(w) AS n, len(lw) AS ln, length(array_to_string(w, '')) AS wc FROM a),
     c AS (SELECT *, [wc - up - dg - mk - wide, up, dg, chars - wc, mk - sy, sy, wide] AS cc FROM b),
     ids AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {MOST_TRUSTED}),
     tr AS (SELECT * FROM c WHERE g IS NOT NULL AND n >= {MIN_WORDS_CHARS} AND doc_id IN (FROM ids)),
     rf AS (SELECT g, sum(ln) AS total, [{', '.join(f'sum(cc[{i + 1}])' for i in range(len(CLASSES)))}] AS cs FROM tr GROUP BY g HAVING count(*) >= {MIN_TRUSTED}),
     wd AS (SELECT g, word, count(*) AS k FROM (SELECT g, unnest(lw) AS word FROM tr) GROUP BY g, word QUALIFY row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, word) <= {N_COMMON}),
     tp AS (SELECT g, list(word ORDER BY k DESC, word) AS known, list(k ORDER BY k DESC, word) AS ks FROM wd GROUP BY g),
     r AS (SELECT g, list_transform(cs, lambda v: v / list_sum(cs)) AS rc, known, list_transform(list_append(ks, total::BIGINT - list_sum(ks)::BIGINT), lambda k: k / total) AS rw FROM rf JOIN tp USING (g)),
     e0 AS (SELECT c.*, rc, rw, list_transform(known, lambda v: len(list_filter(lw, lambda t: t = v))) AS cw0, coalesce(cc[7] > ({OTHER_SCRIPT} + rc[7]) * wc, true) AS other FROM c LEFT JOIN r USING (g)),
     e AS (SELECT *, list_append(cw0, ln - list_sum(cw0)::BIGINT) AS cw FROM e0),
     wi AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, n - 7)) AS i FROM e WHERE n >= 8)),
     rep AS (SELECT doc_id, count(DISTINCT spot) AS reps FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS spot FROM wi JOIN (SELECT doc_id, win FROM wi GROUP BY ALL HAVING count(*) > 1) USING (doc_id, win)) GROUP BY doc_id),
     f AS (SELECT *, coalesce(reps, 0) AS rp, n < 20 OR 100 * coalesce(reps, 0) > 30 * n AS failed, len(list_filter(ls, lambda l: regexp_matches(l, '{code}'))) >= {CODE_SHARE} * len(ls) AS code,
              coalesce(CASE WHEN n >= {MIN_WORDS_CHARS} AND NOT other THEN {both('cc', 'chars', 'rc')} END > {MAX_CHAR_DISTANCE}, false) OR coalesce(CASE WHEN n >= {MIN_WORDS_WORDS} AND ln > 0 AND NOT other THEN {both('cw', 'ln', 'rw')} END > {MAX_WORD_DISTANCE}, false) AS far
           FROM e LEFT JOIN rep USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, wc::BIGINT AS word_chars, sy::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, rp::BIGINT AS n_repeat_words, failed AS base_failed,
       NOT failed AND (NOT far OR code) AS kept
FROM f
"""


ORACLE = _oracle()

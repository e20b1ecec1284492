"""URL filters by path templates, in DataFrame functions only.

Rules decide what they fit.  The URLs that they decide are labels for the rest: the paths of each host make a tree of templates,
whose branches are literal segments or wildcards; branches that labels can't tell apart are merged; a template is rejected, and
with it what no rule decides, where the smoothed share of blocked URLs among its labelled ones is high.

A segment's digits, and long hexadecimal runs, are '#'.  What is left is literal where it has MIN_SUPPORT URLs of the host at its
level and 1 in MOST_BRANCHES of them, else '*'; so a level of a host has MOST_BRANCHES literals at most.  Segments after the
first LEVELS are '**' together.  Siblings are templates that differ in their last literal only.  In the order of their shares of
blocked URLs, neighbours are merged unless a test of two proportions tells them apart; those without labels stay by themselves,
so that nothing is rejected for its neighbours' sake.

Counts are reduced before a shuffle.  What meets a host's rows again is dealt to SALTS parts of the host, so that a hot host is
many tasks.  html is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.llm._shared import ascii_lower, pinned, salted_join, staged, table

#: Verdict and rule; host and path of a rule part at its first slash.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9A-Fa-f]{16,}|[0-9]+"
LEVELS, MOST_BRANCHES, MIN_SUPPORT = 8, 64, 3
#: Neighbours are told apart beyond so many standard errors, squared (1.96).
Z2 = 3.8416
#: Labels' weight and share in smoothing; labelled URLs and purity that reject a template.
WEIGHT, PRIOR, MIN_LABELLED, MAX_PURITY = 2, 0.1, 5, 0.75
SALTS = 64


def host_of(url: Column) -> Column:
    """What stands between the first :// and / ? # or the end, A-Z lower-cased; '' of null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]], kind: int = 1) -> Column:
    """The longest rule (kind 0: its verdict) whose host is this one or above it and whose path the path starts with; null without one."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule[1].partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        out = F.when(fits, rule[kind]) if out is None else out.when(fits, rule[kind])
    return F.lit(None).cast("string") if out is None else out


def segments(path: Column) -> Column:
    """Segments with '#' for what varies by its looks; '**' for all after the first LEVELS."""
    all_ = F.transform(F.split(F.substr(path, F.lit(2)), "/"), lambda s: F.regexp_replace(s, VARIABLE, "#"))
    cut = F.when(F.size(all_) > LEVELS, F.concat(F.slice(all_, 1, LEVELS), F.array(F.lit("**")))).otherwise(all_)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(cut)


def literals(urls: DataFrame) -> DataFrame:
    """host, literals: 'level/segment' of the segments that stay as they are; LEVELS x MOST_BRANCHES of a host at most.  urls: host, segments."""
    each = urls.select("host", F.posexplode("segments").alias("level", "segment")).groupBy("host", "level", "segment").agg(F.count("*").alias("n"))
    each = each.withColumn("__salt", F.pmod(F.xxhash64("segment"), F.lit(SALTS)).cast("int"))
    totals = each.groupBy("host", "level").agg(F.sum("n").alias("total")).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = each.where(F.col("n") >= MIN_SUPPORT).join(totals, ["host", "level", "__salt"]).where(F.col("n") * MOST_BRANCHES >= F.col("total"))
    return kept.groupBy("host").agg(F.collect_list(F.concat_ws("/", F.col("level").cast("string"), "segment")).alias("literals"))


def with_templates(urls: DataFrame) -> DataFrame:
    """urls (host, segments, ...) and template, an array of literals and wildcards."""
    met = salted_join(urls, literals(urls), ["host"], "left", SALTS)
    known = F.coalesce("literals", F.array().cast("array<string>"))
    token = lambda s, i: F.when((s == "**") | F.array_contains(known, F.concat_ws("/", i.cast("string"), s)), s).otherwise("*")
    return met.withColumn("template", F.transform("segments", token)).drop("literals")


def purities(templates: DataFrame) -> DataFrame:
    """host, template, labelled, blocked (of the merged branch), purity, for each template that has labels.  templates: host, template, blocked (null: no label)."""
    own = templates.where("blocked is not null").groupBy("host", "template").agg(F.count("*").alias("n"), F.sum(F.col("blocked").cast("long")).alias("b"))
    literal = F.transform(F.reverse("template"), lambda t: ~t.contains("#") & ~t.isin("*", "**"))
    last = F.size("template") - F.array_position(literal, F.lit(True)) + 1
    key = F.transform("template", lambda t, i: F.when((i + 1 == last) & F.array_contains(literal, F.lit(True)), "+").otherwise(t))
    own = own.withColumns({"key": key, "rate": F.col("b") / F.col("n")})
    siblings, order = W.partitionBy("host", "key"), ["rate", "template"]  # a key has MOST_BRANCHES templates at most
    n0, b0 = F.lag("n").over(siblings.orderBy(*order)), F.lag("b").over(siblings.orderBy(*order))
    n, b = F.col("n"), F.col("b")
    share = (b + b0) / (n + n0)
    apart = (b / n - b0 / n0) * (b / n - b0 / n0) > F.lit(Z2) * share * (1 - share) * (1 / n + 1 / n0)
    own = own.withColumn("__apart", F.when(apart, 1).otherwise(0)).withColumn("branch", F.sum("__apart").over(siblings.orderBy(*order)))
    whole = W.partitionBy("host", "key", "branch")
    own = own.withColumns({"labelled": F.sum("n").over(whole), "blocked": F.sum("b").over(whole), "__ln": F.sum("n").over(siblings), "__lb": F.sum("b").over(siblings)})
    above = (F.col("__lb") + WEIGHT * PRIOR) / (F.col("__ln") + WEIGHT)
    return own.select("host", "template", "labelled", "blocked", ((F.col("blocked") + WEIGHT * above) / (F.col("labelled") + WEIGHT)).alias("purity"))


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", label: Column | None = None) -> DataFrame:
    """`key`, host, path, rule (null: none fits), template, purity (null: not rejected), verdict of each row.

    label: blocked, or null, of a row where no rule fits; rules' verdicts are labels in any case.  Null URLs and those without :// have
    an empty host and path and are allowed.  Rows that repeat, and null keys, are judged each by itself; other columns are not
    looked at, whatever they are called.  No rows, no result.  Very long URLs: a path of any length has LEVELS + 1 tokens at most."""
    label = F.lit(None).cast("boolean") if label is None else label
    rows = pages.select(F.col(key).alias("__key"), pinned(host_of(F.col(url))).alias("host"), pinned(path_of(F.col(url))).alias("path"), label.alias("__label"))
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumns({"rule": rule_of(host, path, rules), "__verdict": rule_of(host, path, rules, 0), "segments": segments(path)})
    rows = rows.withColumn("blocked", F.coalesce(F.col("__verdict") == "block", F.col("__label")))
    rows = staged(with_templates(rows.drop("__label")).drop("segments"), "url-templates")
    bad = purities(rows).where((F.col("labelled") >= MIN_LABELLED) & (F.col("purity") >= MAX_PURITY)).select("host", "template", "purity")
    met = salted_join(rows, bad, ["host", "template"], "left", SALTS)
    verdict = F.coalesce("__verdict", F.when(F.col("purity").isNotNull(), "block").otherwise("allow"))
    return met.select(F.col("__key").alias(key), "host", "path", "rule", F.concat(F.when(F.size("template") > 0, "/").otherwise(""), F.array_join("template", "/")).alias("template"), "purity", verdict.alias("verdict"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "template", "verdict")


def _oracle() -> str:
    def case(kind: int) -> str:
        out = []
        for rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
            name, _, rest = rule[1].partition("/")
            out.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{rule[kind]}'")
        return f"CASE {' '.join(out)} END"

    literal = "list_transform(list_reverse(template), lambda t: NOT contains(t, '#') AND t NOT IN ('*', '**'))"
    return rf"""
WITH a AS (SELECT row_number() OVER () AS r, page_id, translate(coalesce(regexp_extract(url, '{ADDRESS}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '{ADDRESS}', 2), '') AS path FROM pages),
     b AS (SELECT *, {case(1)} AS rule, {case(0)} AS ruled, CASE WHEN path = '' THEN []::VARCHAR[] ELSE list_transform(string_split(path[2:], '/'), lambda s: regexp_replace(s, '{VARIABLE}', '#', 'g')) END AS parts FROM a),
     c AS (SELECT * EXCLUDE parts, CASE WHEN len(parts) > {LEVELS} THEN list_append(parts[1:{LEVELS}], '**') ELSE parts END AS seg FROM b),
     e AS (SELECT r, host, unnest(seg) AS s, unnest(range(len(seg))) AS lv FROM c),
     n AS (SELECT host, lv, s, count(*) AS n FROM e GROUP BY ALL),
     lit AS (SELECT host, lv, s FROM n QUALIFY n >= {MIN_SUPPORT} AND n * {MOST_BRANCHES} >= sum(n) OVER (PARTITION BY host, lv)),
     tok AS (SELECT e.r, list(CASE WHEN e.s = '**' OR lit.s IS NOT NULL THEN e.s ELSE '*' END ORDER BY e.lv) AS template FROM e LEFT JOIN lit ON e.host = lit.host AND e.lv = lit.lv AND e.s = lit.s GROUP BY e.r),
     t AS (SELECT c.*, coalesce(template, []) AS template FROM c LEFT JOIN tok USING (r)),
     o AS (SELECT host, template, count(*) AS n, count(*) FILTER (ruled = 'block') AS b FROM t WHERE ruled IS NOT NULL GROUP BY ALL),
     k AS (SELECT *, {literal} AS lt, b / n AS rate FROM o),
     k2 AS (SELECT *, list_transform(template, lambda x, i: CASE WHEN list_contains(lt, true) AND i = len(template) - list_position(lt, true) + 1 THEN '+' ELSE x END) AS key FROM k),
     g AS (SELECT *, lag(n) OVER w AS n0, lag(b) OVER w AS b0 FROM k2 WINDOW w AS (PARTITION BY host, key ORDER BY rate, template)),
     h AS (SELECT *, sum(CASE WHEN (b / n - b0 / n0) * (b / n - b0 / n0) > {Z2} * ((b + b0) / (n + n0)) * (1 - (b + b0) / (n + n0)) * (1 / n + 1 / n0) THEN 1 ELSE 0 END) OVER (PARTITION BY host, key ORDER BY rate, template) AS branch FROM g),
     p AS (SELECT host, template, sum(n) OVER v AS ln, sum(b) OVER v AS lb, sum(n) OVER u AS kn, sum(b) OVER u AS kb FROM h WINDOW v AS (PARTITION BY host, key, branch), u AS (PARTITION BY host, key)),
     bad AS (SELECT host, template FROM p WHERE ln >= {MIN_LABELLED} AND (lb + {WEIGHT} * (kb + {WEIGHT * PRIOR}) / (kn + {WEIGHT})) / (ln + {WEIGHT}) >= {MAX_PURITY})
SELECT page_id, t.host, path, rule, CASE WHEN len(t.template) > 0 THEN '/' ELSE '' END || array_to_string(t.template, '/') AS template, coalesce(ruled, CASE WHEN bad.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN bad ON t.host = bad.host AND t.template = bad.template
"""


ORACLE = _oracle()

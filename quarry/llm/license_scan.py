"""License scans by an exact set-similarity join, in DataFrame functions only.

Blocks are lines; a block's set are its words.  Templates are short license statements.  A block meets a template if it
holds THRESHOLD of the template's words: alpha = ceil(THRESHOLD * size) of them.  Tokens are ordered by their frequency in
all documents, rare first.  Two sets with alpha common tokens share one within the first size - alpha + 1 of each (prefix
filter; a block's tokens outside all templates count for nothing and are left out); the block must have alpha tokens at all
(length filter), and what follows the first common token on both sides must still give alpha (positional filter).
Survivors are compared whole, so that the join is exact.

Statements that are wrapped over several lines, and whole license texts (NOTICES), are met by a second kind of blocks: all runs of
consecutive words, whatever line they stand in, 1 / THRESHOLD times as long as the template.  Every word starts one, so each
statement lies whole in a block.  Only texts of several lines that hold enough of a template's words somewhere are looked at
this way.

Four passes over documents, none of which shuffles a text: token frequencies (of the templates' words only, summed before
the shuffle), base phrases, lines, and runs of words.  The templates' tables are of a fixed size and broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm._shared import BREAKS, ascii_lower, letter_words, pinned, table

THRESHOLD = 0.8
#: Phrases and labels of the base rule.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license statements and the labels they stand for.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("gpl-2.0", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("eupl", "Licensed under the European Union Public Licence EUPL"),
    ("artistic", "distributed under the terms of the Artistic License"),
]
#: Licenses by their identifiers in the tag that source files have on one line; the label is the identifier.
TAGGED = ["MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "EUPL-1.2", "Artistic-2.0", "Unlicense"]
TAGS = [(x.lower(), f"SPDX-License-Identifier: {x}") for x in TAGGED]
#: Whole license texts, or the whole notice that a license asks for, which stand on several lines.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Words that tell a license from its siblings, by label; a template that has them isn't met without.
DISTINGUISHING = {"mit": ["mit"], "apache-2.0": ["apache", "2"], "gpl-3.0": ["3"], "lgpl": ["lesser"], "cc-by-nc-4.0": ["nc", "4"], "cc-by-sa-4.0": ["sharealike", "4"], "mpl-2.0": ["mozilla", "2"], "isc": ["fee"], "gpl-2.0": ["2"], "agpl": ["affero"], "cc0-1.0": ["waived"], "cc-4.0": ["attribution", "4"], "eupl": ["eupl"], "artistic": ["artistic"]}


def template_sets(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    return [(label, sorted({w for w in re.split(BREAKS, text.lower()) if w})) for label, text in templates]


def _needed(label: str, words: list[str], strict: bool) -> list[str]:
    if strict and "spdx" in words:  # all that the identifier says
        return sorted(set(words) - {"license", "identifier"})
    return [w for w in DISTINGUISHING.get(label, []) if w in words] if strict else []


def token_order(docs: DataFrame, tokens: list[str]) -> list[str]:
    """tokens, by their number of occurrences in all documents.  Gathers one row a template word."""
    known = F.broadcast(docs.sparkSession.createDataFrame([(t,) for t in tokens], "w string"))
    words = docs.select(pinned(letter_words(F.col("text"))).alias("ws")).select(F.explode("ws").alias("w"))
    counts = dict(words.join(known, "w").groupBy("w").count().collect())
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def matching_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """id, h (text hash), line, label, containment: every line that meets a template, exactly.  strict: and has its DISTINGUISHING words."""
    sets = template_sets(templates)
    order = token_order(docs, sorted({t for _, s in sets for t in s}))
    rank = {t: i for i, t in enumerate(order)}
    rows = []
    for label, s in sets:
        ts = sorted(s, key=rank.get)
        alpha = math.ceil(threshold * len(ts) - 1e-9)
        rows += [(t, label, i, len(ts), alpha, ts, _needed(label, ts, strict)) for i, t in enumerate(ts[: len(ts) - alpha + 1])]
    prefixes = F.broadcast(docs.sparkSession.createDataFrame(rows, "token string, label string, i int, n int, alpha int, whole array<string>, needed array<string>"))
    least = min(r[4] for r in rows)
    lines = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.posexplode(F.split(ascii_lower(F.coalesce("text", F.lit(""))), "\n")).alias("line", "block"))
    known = F.split(F.lit(" ".join(order)), " ")
    sets = lines.select("id", "h", "line", pinned(F.array_intersect(known, F.split("block", BREAKS))).alias("b")).where(F.size("b") >= least)
    each = sets.select("id", "h", "line", "b", F.posexplode("b").alias("j", "token")).join(prefixes, "token")
    m = F.size("b")
    each = each.where((m >= F.col("alpha")) & (F.col("j") <= m - F.col("alpha")) & (1 + F.least(F.col("n") - F.col("i") - 1, m - F.col("j") - 1) >= F.col("alpha")))
    each = each.where(F.size(F.array_except("needed", "b")) == 0)
    met = each.select("id", "h", "line", "label", "alpha", "n", F.size(F.array_intersect("b", "whole")).alias("common")).where("common >= alpha")
    return met.select("id", "h", "line", "label", (F.col("common") / F.col("n")).alias("containment"))


def wrapped_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, strict: bool = False) -> DataFrame:
    """id, h (text hash), label, containment: the best run of words for each template that one meets, in texts of several lines."""
    rows = []
    for (label, text), (_, s) in zip(templates, template_sets(templates), strict=True):
        n_words = len([w for w in re.split(BREAKS, text.lower()) if w])
        rows.append((label, len(s), math.ceil(threshold * len(s) - 1e-9), math.ceil(n_words / threshold - 1e-9), s))
    known = F.split(F.lit(" ".join(sorted({t for r in rows for t in r[4]}))), " ")
    each = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(n).alias("n"), F.lit(alpha).alias("alpha"), F.lit(span).alias("span"), F.split(F.lit(" ".join(s)), " ").alias("whole"), F.array(*[F.lit(w) for w in _needed(label, s, strict)]).cast("array<string>").alias("needed")) for label, n, alpha, span, s in rows])
    texts = docs.where(F.col("text").contains("\n")).select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), pinned(letter_words(F.col("text"))).alias("words"))
    bags = texts.select("id", "h", "words", pinned(F.array_intersect(known, F.col("words"))).alias("bag")).where(F.size("bag") >= min(r[2] for r in rows))
    may = bags.select("id", "h", "words", pinned(F.filter(each, lambda t: F.size(F.array_intersect(F.col("bag"), t["whole"])) >= t["alpha"])).alias("ts")).where(F.size("ts") > 0)
    may = may.select("id", "h", "words", F.explode("ts").alias("t")).select("id", "h", "words", "t.*")
    starts = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("whole", w), i + 1)), lambda i: i.isNotNull())
    runs = F.transform(starts, lambda i: F.array_intersect(F.slice("words", i, F.col("span")), F.col("whole")))
    common = F.array_max(F.transform(runs, lambda b: F.when(F.size(F.array_except("needed", b)) == 0, F.size(b))))
    return may.select("id", "h", "label", "alpha", "n", pinned(common).alias("common")).where("common >= alpha").select("id", "h", "label", (F.col("common") / F.col("n")).alias("containment"))


def _base_places(words: Column) -> Column:
    """(start, label) of every base phrase; the words are looked at one by one only where the phrase's first word occurs."""
    def place(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<i:int,label:string>")
        for phrase, label in PHRASES.items():
            first, *rest = phrase.split()
            hit = w == first
            for k, x in enumerate(rest, 1):
                hit = hit & F.coalesce(F.get(words, i + k) == x, F.lit(False))
            out = F.when(hit, F.struct(i.alias("i"), F.lit(label).alias("label"))).otherwise(out)
        return out

    some = F.lit(False)
    for phrase in PHRASES:
        some = some | F.array_contains(words, max(phrase.split(), key=len)) & F.array_contains(words, phrase.split()[0])
    return F.when(some, F.filter(F.transform(words, place), lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<i:int,label:string>>"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, wrapped: bool = False, strict: bool = False, tags: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a base phrase, else the best containment that meets the threshold, else 0.  Null and empty texts have
    no words and no labels ('').  Equal rows give equal results, one each; rows of one id and other texts are kept apart.
    Null ids count as an id.  wrapped: statements that line breaks cut, and NOTICES, count too.  strict: only
    with the words that tell a license from its siblings.  tags: lines with an SPDX identifier count.  Other columns are not read."""
    base = docs.select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), pinned(letter_words(F.col("text"))).alias("words"))
    base = base.select("id", "h", F.size("words").cast("long").alias("n"), pinned(_base_places(F.col("words"))).alias("at"))
    base = base.select("id", "h", "n", F.size("at").cast("long").alias("n_base"), F.array_min("at.i").cast("long").alias("first_word"), F.array_max("at.i").cast("long").alias("last_word"), F.array_distinct("at.label").alias("bl"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("c"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("n", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("bl", "array<string>"))]
    met = matching_blocks(docs, templates + TAGS if tags else templates, threshold, strict).select("id", "h", "label", "containment")
    if wrapped:
        met = met.unionByName(wrapped_blocks(docs, templates + NOTICES, threshold, strict))
    found = met.groupBy("id", "h", "label").agg(F.max("containment").alias("c")).select("id", "h", *none, "label", "c")
    # labels are as many as templates at most, so each group is small
    out = base.unionByName(found).groupBy("id", "h").agg(
        *[F.max(c).alias(c) for c in ("n", "n_base", "first_word", "last_word", "bl", "c")], F.count("n").alias("copies"), F.collect_set("label").alias("own"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    text = lambda labels: F.array_join(F.array_sort(labels), ",")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_base", "first_word", "last_word", text(F.col("bl")).alias("base_labels"), text(F.array_union("bl", "own")).alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("c", F.lit(0.0))).alias("score"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), wrapped=True, strict=True, tags=True)


def _oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(f"({p.split()!r}, {label!r})" for p, label in PHRASES.items())
    def sets(templates: list[tuple[str, str]]) -> str:
        rows = []
        for (label, text), (_, own) in zip(templates, template_sets(templates), strict=True):
            span = math.ceil(len([w for w in re.split(BREAKS, text.lower()) if w]) / THRESHOLD - 1e-9)
            rows.append(f"({label!r}, {own!r}, {math.ceil(THRESHOLD * len(own) - 1e-9)}, {span}, {_needed(label, own, True)!r}::VARCHAR[])")
        return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS v(label, ts, alpha, span, needed))"

    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({lower}, {word}) AS w FROM documents),
     p AS (SELECT * FROM (VALUES {phrases}) AS v(ws, label)),
     places AS (SELECT doc_id, i - 1 AS i, label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w), p WHERE w[i:i + len(ws) - 1] = ws),
     pb AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM places GROUP BY doc_id),
     t AS {sets(TEMPLATES + TAGS)},
     t2 AS {sets(TEMPLATES + NOTICES)},
     blocks AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split({lower}, chr(10))), {word})) AS b FROM documents),
     lined AS (SELECT doc_id, label, len(list_intersect(b, ts)) / len(ts) AS c FROM blocks, t WHERE len(list_intersect(b, ts)) >= alpha AND list_has_all(b, needed)),
     wide AS (SELECT doc_id, ws AS w, t2.* FROM (SELECT doc_id, regexp_extract_all({lower}, {word}) AS ws FROM documents WHERE contains(text, chr(10))), t2 WHERE len(list_intersect(ws, ts)) >= alpha),
     runs AS (SELECT doc_id, label, ts, alpha, needed, list_intersect(w[i:i + span - 1], ts) AS b FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM wide) WHERE list_contains(ts, w[i])),
     wrapped AS (SELECT doc_id, label, len(b) / len(ts) AS c FROM runs WHERE len(b) >= alpha AND list_has_all(b, needed)),
     met AS (SELECT doc_id, label, max(c) AS c FROM (SELECT * FROM lined UNION ALL SELECT * FROM wrapped) GROUP BY ALL),
     labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM met UNION SELECT doc_id, label FROM places) GROUP BY doc_id),
     bl AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
     best AS (SELECT doc_id, max(c) AS c FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0)::DOUBLE END AS score
FROM w LEFT JOIN pb USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)
"""


ORACLE = _oracle()

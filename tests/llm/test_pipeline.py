"""The corpus pipeline, stage by stage, on rows whose fate is known."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import packing, quality_classifier, quality_rules, tokens
from tests.llm.test_operators import FOLD, LETTER, SPACE, brute_components, brute_contamination, docs, prose, sets_of


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=str)


def corpus():
    rng = random.Random(21)
    clean = [(i, prose(rng, 120, 3000), "en") for i in range(80)]
    near = [(100 + i, clean[i][1] + " tail", "en") for i in range(10)]
    return clean, near, [(200, clean[0][1], "en"), (7, clean[7][1], "en"), (None, clean[8][1], "en"), (None, prose(rng, 120, 3000), "en"), (None, None, None), (201, "", "en"), (202, "few words", "en")]


def divergence(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    return math.sqrt((kl(p) + kl(q)) / 2)


def brute_rules(rows, trusted):
    """Rows that the rules keep; all of one language, in Latin script."""
    def histograms(text):
        marks = [len(re.findall(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"[!-/:-@\[-`{-~]", "[#*$%&|<>]", r"[^\x00-\x7F]")]
        marks[4] -= marks[5]
        return [len(text) - sum(marks[1:]), *marks[1:]], re.findall(LETTER, text.translate(FOLD))

    share = lambda xs: [x / sum(xs) for x in xs]
    own = [histograms(text) for i, text, _ in rows if i in trusted and len(re.findall(SPACE, text or "")) >= 20]
    words = Counter(w for _, ws in own for w in ws)
    top = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:20]]
    counted = lambda c, n: [c[w] for w in top] + [n - sum(c[w] for w in top)]
    chars, shares = share([sum(h[k] for h, _ in own) for k in range(7)]), share(counted(words, sum(words.values())))
    out = []
    for row in rows:
        w = re.findall(SPACE, row[1] or "")
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        spots = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        if len(w) < 20 or 100 * len(spots) > 30 * len(w):
            continue
        h, ws = histograms(row[1])
        if row[2] == "en" and (divergence(share(h), chars) > 0.25 or len(w) >= 100 and divergence(share(counted(Counter(ws), len(ws))), shares) > 0.28):
            continue
        out.append(row)
    return out


def brute_pipeline(spark, rows, labels, items):
    """(doc_id, text) that reach packing, stage by stage in memory; the classifier's model is its own."""
    left = brute_rules(rows, {i for i, q, _ in labels if q == 1})
    model = quality_classifier.fit(docs(spark, left), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    scores = [s for _, _, t in quality_classifier.terms(pa.array([r[1] for r in left])) for s in model.score(t)]
    left = [r for r, s in zip(left, scores, strict=True) if s >= quality_classifier.THRESHOLD]
    sets = sets_of([(k, r[1]) for k, r in enumerate(sorted(left, key=lambda r: (r[0] is None, r[0] or 0)))], 5)
    order = sorted(left, key=lambda r: (r[0] is None, r[0] or 0))
    left = [order[k] for k, c in brute_components(sets, 80).items() if k == c or order[k][0] is None and not [x for x in range(k) if sets[x] == sets[k]]]
    bad = lambda r: (b := brute_contamination(r[1], items))[1] and 20 * b[1] >= b[0]
    return [r[:2] for r in left if not bad(r)]


def test_stages(spark, tmp_path):
    clean, near, odd = corpus()
    junk = [(300 + i, "BUY NOW!! " * 8 + f"$$$ {i} " * 30, "en") for i in range(8)]
    item = " ".join(f"q{i}" for i in range(30))
    dirty = [(400, clean[20][1] + " " + item + " " + item, "en"), (401, clean[21][1] + " q1 q2 q3", "en")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in clean] + [(r[0], 0, 0) for r in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = clean + near + odd + junk + dirty
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "packing"]
    df = docs(spark, rows)
    first = stages["quality_rules"](spark, df, str(tmp_path))
    want = brute_rules(rows, {r[0] for r in clean})
    assert first.columns == df.columns and ids(first) == sorted([r[0] for r in want], key=str) and set(ids(first)) >= {r[0] for r in clean} and not set(ids(first)) & {r[0] for r in junk} | {201, 202} & set(ids(first))
    second = stages["quality_classifier"](spark, df, str(tmp_path))
    assert second.columns == df.columns and set(ids(second)) >= {r[0] for r in clean} and not set(ids(second)) & {r[0] for r in junk}
    third = stages["near_dedup"](spark, df, str(tmp_path))
    groups = brute_components(sets_of([r for r in rows if r[0] is not None], 5), 80)
    assert third.columns == df.columns and ids(third) == sorted([i for i, c in groups.items() if i == c] + [None, None], key=str)  # of null ids: the lone text, and the empty one
    fourth = stages["decontamination"](spark, df, str(tmp_path))
    bad = [r[0] for r in rows if (b := brute_contamination(r[1], [(1, item)]))[1] and 20 * b[1] >= b[0]]
    assert bad == [400] and ids(fourth) == sorted([r[0] for r in rows if r[0] not in bad], key=str)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    end = corpus_pipeline.run(spark, str(tmp_path)).collect()
    labels = [(r[0], 1, 0) for r in clean] + [(r[0], 0, 0) for r in junk]
    encode = Tokenizer.from_file(tokens.vocabulary()).encode
    sizes = Counter()
    for r in end:
        sizes[r["doc_id"]] += r["length"]
    assert sizes == Counter({i: len(encode(text, add_special_tokens=False).ids) + 1 for i, text in brute_pipeline(spark, rows, labels, [(1, item)])})
    filled = Counter()
    for r in end:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= packing.CAPACITY
    left = {r["doc_id"] for r in end}
    assert left >= {r[0] for r in clean[:20]} and not left & ({r[0] for r in near + junk} | {200, 400, 201, 202}) and sum(r["piece"] == 0 for r in end if r["doc_id"] == 7) == 1


def test_empty(spark, tmp_path):
    for name, schema in (("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""Trigram scores against brute force, with hot words and repeated contexts."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lm_scoring


def ngrams(w, k):
    return list(zip(*[w[i:] for i in range(k)], strict=False))


@pytest.mark.parametrize(("hot", "held"), [(2048, 4_000_000), (40, 50), (1, 4_000_000)])
def test_trigrams(spark, tmp_path, monkeypatch, hot, held):
    for name, value in (("BATCH", 300), ("HOT", hot), ("HELD", held)):
        monkeypatch.setattr(lm_scoring, name, value)
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice("a b c d e".split()) if rng.random() < 0.5 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 90)))) for i in range(120)]
    rows += [(200, rows[5][1]), (201, None), (202, "one"), (203, "new words only here"), (None, "a b c"), (204, "A b C a b c a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = lm_scoring.op9_lm_scoring(spark, str(tmp_path)).collect()
    words = [(i, (t or "").lower().split()) for i, t in rows]
    c = [None, *[Counter(g for _, w in words for g in ngrams(w, k)) for k in (1, 2, 3)]]
    n, want = sum(c[1].values()), []
    for i, w in words:
        own, total = [None, None, Counter(ngrams(w, 2)), Counter(ngrams(w, 3))], 0.0
        for j in range(1, len(w)):
            factor = 1.0
            for k in (3, 2):
                g = tuple(w[j - k + 1 : j + 1])
                if k <= j + 1 and c[k][g] - own[k][g]:
                    total += math.log10(factor * (c[k][g] - own[k][g]) / c[k - 1][g[:-1]])
                    break
                factor *= 0.4 if k <= j + 1 else 1
            else:
                total += math.log10(factor * c[1][w[j],] / n)
        want.append((i, len(w), total / (len(w) - 1) if len(w) > 1 else None))
    key = lambda x: (str(x[0]), x[1], x[2] or 0)
    if hot == 1:  # the plain joins agree
        by_rows = lm_scoring.lm_scores_by_rows(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()
        for g, x in zip(sorted([tuple(r) for r in by_rows], key=key), sorted(want, key=key), strict=True):
            assert g[:2] == x[:2] and g[2] == (None if x[2] is None else pytest.approx(x[2], abs=1e-9))
    for g, x in zip(sorted([tuple(r) for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[:2] == x[:2] and g[2] == (None if x[2] is None else pytest.approx(x[2], abs=2e-6))


def test_sums_travel_whole():
    for v in ([], [0.0], [1.5], [0.0] * 300 + [2.25], [0.0, 1.0, 0.0, 0.0, 0.0, -3.5], [1.0, 2.0, 0.0], [0.0] * 70_000 + [1.0]):
        got = lm_scoring.unpack_sums(lm_scoring.pack_sums(np.array(v)))
        assert got.tolist() == v or (not any(v) and not got.any())

"""Near duplicates where rows of one id have different texts."""

import random

from quarry.llm import near_dedup


def test_rows_of_one_id_and_different_texts(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(31)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(150)]
    near = lambda w: w[:75] + ["other"] + w[76:]
    rows, want = [], {}
    for i in range(40):
        a, b = text(), text()
        for doc_id, w, component in ((i, a, i), (i, b, i), (100 + i, near(a), i), (200 + i, near(b), i)):
            rows.append((doc_id, " ".join(w)))
            want[rows[-1]] = (component, component == doc_id)
    for i in range(40):  # both ids have several texts, so that either hub stands for more than one
        a, b, c = text(), text(), text()
        for doc_id, w, component in ((400 + i, a, 400 + i), (400 + i, b, 400 + i), (500 + i, near(a), 400 + i), (500 + i, c, 500 + i)):
            rows.append((doc_id, " ".join(w)))
            want[rows[-1]] = (component, component == doc_id)
    w = text()
    rows += [(300, " ".join(w)), (300, " ".join(near(w)))]  # one group, so one row of it is kept
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df)
    named = got.join(df.selectExpr("doc_id", "text", "xxhash64(text) AS text_hash"), ["doc_id", "text_hash"]).collect()
    assert {(r["doc_id"], r["text"]): (r["component_id"], r["kept"]) for r in named if r["doc_id"] != 300} == want
    assert sorted((r["component_id"], r["kept"]) for r in named if r["doc_id"] == 300) == [(300, False), (300, True)]
    out = corpus_pipeline.near_dedup_stage(spark, df, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted([*range(40), *range(40), 300, *range(400, 440), *range(400, 440), *range(500, 540)])

"""What a batch of texts and a worker hold."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import _shared, packing, tokens
from quarry.llm._bytes import spelled_words
from tests.llm.test_operators import docs


def test_batches(spark):
    """Rows of 100 kB: some 1 MB of them at a time, and the settings are as before afterwards."""
    texts = spark.range(60, numPartitions=1).selectExpr("id", "repeat(cast(id % 10 as string), 100000) AS text")
    keys = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]
    old = [spark.conf.get(key) for key in keys]
    with _shared.arrow_rows(spark):
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 60 and max(r["n"] for r in sizes) <= _shared.BATCH_BYTES // 100_000 + 1
    assert [spark.conf.get(key) for key in keys] == old


def test_scored_once(spark, tmp_path):
    """The classifier's stage has sent its texts to Python when it returns."""
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(i, f"some words of text {i}", "en") for i in range(9)] + [(None, None, None)]
    out = corpus_pipeline.quality_classifier_stage(spark, docs(spark, rows), str(tmp_path))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == docs(spark, rows).columns


def test_distinct_words():
    """Words beyond the bound are forgotten, and encoded again when met again."""
    pool, encode = packing.IdPool(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary()).encode
    common = "the same words, again! and Again "
    for k in range(9):
        column = pa.array([common + " ".join(f"w{k}x{j}" for j in range(i * 20_000, i * 20_000 + 20_000)) for i in range(4)])
        for i, j, *words in spelled_words(column, fold=False, block=packing.BLOCK):
            ids, ends = pool.tokens(*words)
            for row in range(i, j):
                own = ids[ends[row - i] : ends[row - i + 1]]
                first = encode(column[row].as_py()[:200].rpartition(" ")[0], add_special_tokens=False).ids
                assert own[: len(first)].tolist() == first
            assert len(pool.keys) <= 300_000 + packing.BLOCK // 2
    held = sum(x.nbytes for x in vars(pool).values() if isinstance(x, np.ndarray))
    assert held < 40 << 20

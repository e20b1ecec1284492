"""No hash decides a result: words that collide under weak hashes are told apart."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import _bytes, near_dedup, packing, tokens


def thue_morse(n, one, zero):
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


WORDS = [thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")]


def test_words_that_collide_modulo_powers_of_two_do_not(spark):
    texts = pa.array([*WORDS, thue_morse(1 << 17, "x", "y"), thue_morse(1 << 17, "y", "x")])
    found = [h for _, _, words, _ in _bytes.hashed_words(texts) for h in words.tolist()]
    assert len(set(found)) == 4
    df = spark.createDataFrame(list(enumerate(WORDS, 1)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, 3, 85).collect()} == {1: 1, 2: 2}


def test_equal_hashes_are_compared(monkeypatch):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokens.vocabulary()).encode
    pool = packing.IdPool(tokens.vocabulary())
    texts = ["ab cd ef gh", "ef, gh ab. zz", *WORDS, ""]
    for _ in range(2):
        for _i, _j, words, offs, first, lens, data in _bytes.spelled_words(pa.array(texts), fold=False):
            ids, ends = pool.tokens(np.zeros_like(words) + lens.astype(np.uint64), offs, first, lens, data)
            for k, text in enumerate(texts):
                own = ids[ends[k] : ends[k + 1]]
                assert zlib.crc32(own.astype("<u4").tobytes()) == zlib.crc32(np.array(encode(text, add_special_tokens=False).ids, "<u4").tobytes())


@pytest.mark.parametrize("size", [3, 5])
def test_exact_sets_under_any_hash(monkeypatch, size):
    rng = np.random.default_rng(3)
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 4, n)) for n in (0, 1, 2, 5, 200, 200)] + [None, b"ONE  Two", b"one two"]
    grams = lambda t: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w := (t or b"").lower().split()) >= size else {tuple(w)} - {()}
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(_bytes, "mix", lambda x: x * np.uint64(0))
        rows, ends = _bytes.exact_sets(texts, size, {})
        assert np.diff(ends).tolist() == [len(grams(t)) for t in texts]
        number, first = _bytes.distinct(rows)
        assert len(first) == len(set().union(*map(grams, texts))) and (rows[first][number] == rows).all()

"""State maps: chunks whose entries aren't known, texts without white space."""

import base64
import random
import time

import pytest
from tokenizers import Tokenizer

from quarry.llm import tokens


@pytest.fixture(scope="module")
def library():
    encode = Tokenizer.from_file(tokens.vocabulary()).encode
    return lambda text: len(encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def fst():
    return tokens.Transducer(tokens.vocabulary())


def test_chunks_of_any_length_count_alike(library, fst):
    rng = random.Random(1)
    bits = ["a", "b", "A", "é", "漢", "字", "1", "12", " ", "\n", "'", "'s", "'ll", "!", "..", "<|endoftext|>", "ß", "0", "ing", "the"]
    for _ in range(1500):
        text = "".join(rng.choice(bits[: rng.randrange(2, len(bits))]) for _ in range(rng.randrange(200)))
        assert int(tokens.count_tokens([text], fst, rng.choice([1, 2, 3, 7, 16, 50, 256]))[0]) == library(text), text


def test_texts_without_white_space(library, fst):
    """A megabyte each; states that are new are compiled, so that base64 is timed when it is read again."""
    rng = random.Random(2)
    chinese = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(333_000))
    for text, again in ((chinese, False), ("a" * 1_000_000, False), ("ab" * 500_000, False), (base64.b64encode(rng.randbytes(150_000)).decode(), True)):
        began = time.time()
        want = library(text)
        least = time.time() - began
        assert not again or int(tokens.count_tokens([text], fst)[0]) == want
        began = time.time()
        assert int(tokens.count_tokens([text], fst)[0]) == want
        assert time.time() - began < 2 * least + 1

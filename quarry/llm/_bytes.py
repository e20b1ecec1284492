"""Words of Arrow text columns as 64-bit hashes, computed on the bytes with numpy, block by block, and exact sets of shingles.

Hashes find candidates; what decides a result compares the words themselves (exact_sets)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text at a time; numpy takes some 50 times as much for the words.
BLOCK = 1 << 19
#: Longer words, in bytes, are hashed by blake2b.
LONG = 1 << 16
_rng = np.random.default_rng(20240229)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _FOLDED[97:123]  # A-Z as a-z
FOLD = bytes([*range(65), *range(97, 123), *range(91, 256)])

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random number for each place in a word: two words agree in the sum of (number of the place) * (number of the byte) with
#: probability 2^-56 at most, whatever they are.  Powers of one number would not do: Thue-Morse words agree modulo 2^64.
with np.errstate(over="ignore"):
    _PLACE = mix(np.arange(1, LONG + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _words(data: np.ndarray, offs: np.ndarray, breaks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, by row the first and the end of its words, and the words' first bytes and lengths."""
    inside = ~breaks[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offs[:-1][offs[:-1] < len(data)]
    before[edges], before[:1] = False, False
    ends = offs[1:][offs[1:] > 0] - 1
    after[ends], after[-1:] = False, False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    lens = last - first + 1
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64), first, lens
    at = np.cumsum(lens) - lens
    spot = np.arange(int(lens.sum())) - np.repeat(at, lens)
    most = int(lens.max())
    terms = values[data[inside]] * _PLACE[spot if most <= LONG else np.minimum(spot, LONG - 1)]
    hashes = mix(np.add.reduceat(terms, at) + lens.astype(np.uint64))
    for i in np.flatnonzero(lens > LONG) if most > LONG else ():
        raw = data[first[i] : first[i] + lens[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(raw.translate(FOLD) if values is _FOLDED else raw, digest_size=8).digest(), "little")
    return hashes, np.searchsorted(first, offs), first, lens


def spelled_words(column: pa.Array, breaks: np.ndarray = SPACES, fold: bool = True, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, end row, hashes, offsets, first bytes, lengths, bytes) for blocks of rows of some `block` bytes; nulls have no words.

    fold: A-Z count as a-z.  A text of more than two blocks is hashed in parts, cut between words."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    values, i = (_FOLDED if fold else _BYTE), 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + block, "right")) - 1)
        part = data[offs[i] : offs[j]]
        if len(part) <= 2 * block:
            yield i, j, *_words(part, offs[i : j + 1] - offs[i], breaks, values), part
        else:  # one row
            cut, found = 0, []
            while cut < len(part):
                end = cut + block
                while end < len(part) and not (b := breaks[part[end : end + 4096]]).any():
                    end += 4096
                end = min(len(part), end + int(b.argmax())) if end < len(part) else len(part)
                h, _, first, lens = _words(part[cut:end], np.array([0, end - cut]), breaks, values)
                found.append((h, first + cut, lens))
                cut = end
            h, first, lens = (np.concatenate(x) for x in zip(*found, strict=True))
            yield i, j, h, np.array([0, len(h)]), first, lens, part
        i = j


def hashed_words(column: pa.Array, breaks: np.ndarray = SPACES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, end row, hashes, offsets) of spelled_words."""
    for i, j, words, at, *_ in spelled_words(column, breaks):
        yield i, j, words, at


def shingles(words: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted; a row of fewer words, but not none, has its whole sequence as one."""
    n = np.diff(offs)
    joint = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        joint += words[k : len(words) - size + 1 + k] * _ODD[1 + k] if len(joint) else 0
    joint = mix(joint)
    sets = []
    for i, k in enumerate(n):
        if k >= size:
            sets.append(np.unique(joint[offs[i] : offs[i + 1] - size + 1]))
        elif k:
            sets.append(mix(np.array([sum(int(w) * int(_ODD[20 + j]) for j, w in enumerate(words[offs[i] : offs[i + 1]])) + int(k) & (1 << 64) - 1], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def exact_sets(texts: list[bytes | None], size: int, names: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the texts' words (A-Z folded): one row of word numbers each, and where each text's rows begin and end.

    names numbers the words, and gets new ones; no hash stands for a word.  A text of fewer words than size has one row, filled with -1."""
    rows, ends = [], [0]
    for text in texts:
        words = (text or b"").translate(FOLD).split()  # bytes are split at the six ASCII white spaces
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words))
        if len(ids) >= size:
            grams = np.lib.stride_tricks.sliding_window_view(ids, size)
            grams = grams[distinct(grams)[1]]
        else:
            grams = np.full((min(1, len(ids)), size), -1, np.int32)
            grams[:, : len(ids)] = ids
        rows.append(grams)
        ends.append(ends[-1] + len(grams))
    return (np.concatenate(rows) if rows else np.zeros((0, size), np.int32)), np.array(ends)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row, equal rows alike, and the first place of each number.  Sorted by hash; compared in full."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        joint = np.zeros(len(rows), np.uint64)
        for k in range(rows.shape[1]):
            joint += mix(rows[:, k].astype(np.uint64) + np.uint64(k << 40)) * _ODD[1 + k]
    order = np.argsort(joint, kind="stable")
    new = np.concatenate([[True], np.diff(joint[order]) != 0])
    if not (rows[order[1:]] == rows[order[:-1]])[~new[1:]].all():  # different rows of one hash
        _, first, number = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        return number.ravel(), first
    number = np.empty(len(rows), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]

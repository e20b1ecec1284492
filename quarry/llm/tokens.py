"""Token counts by a compiled finite-state transducer.

The transducer reads normalized text byte by byte and is deterministic.  A state says what can still matter of the piece that
is open: its kind (letters, digit or marks), the last symbol, which is not yet known to end the piece, the longest suffix of
what stands before it from which a token may go on, and for each place in that suffix the token that ends there with the number
of tokens since.  That is finite, for tokens are, and it is enough: the last token of every prefix is the one token that may
follow the token before it, so places further back are never asked for again.  Each transition carries the number of tokens
that it emits (or takes back, where a merge joins tokens), so that the sum along a path is always the number of tokens of what
has been read.  White space leads to the start.  States are compiled from the vocabulary and the merges when a transition first
leads to them, and held in a hash table of numbers; beyond MOST_STATES they are forgotten and compiled again.

Texts are joined, with white space between them, and cut into chunks of equal length.  A chunk's state map takes an entry state
to its exit state and the tokens emitted.  All chunks run at once, first from the start, then, together again, those whose entry
isn't the exit of the chunk before, each until its path meets the one it had: white space brings all paths together, and so do a few
symbols of most other texts, so that a map is one exit state for nearly all entries.  Where a chunk's exit has changed the next one
runs again.  Maps of chunks that are alike are kept, and composed from chunk to chunk without running: runs of one
letter, whose paths never meet, have few entry states.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm._shared import table
from quarry.workers import ship

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: Bytes of texts that are counted at once, in chunks of CHUNK bytes, or as many more as MOST_CHUNKS leave; bounds of what a worker holds.
BLOCK, CHUNK, MOST_CHUNKS = 1 << 20, 256, 4096
MOST_STATES, MOST_PAIRS = 400_000, 100_000
#: Characters that the normal form changes by lower case alone, as str.lower() has it; other texts are left to the library.
PLAIN = re.compile("[^\x00-įı-ȳ]")
#: Contractions are pieces of their own where a piece may begin; by first letter, what completes them.
CONTRACTIONS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}
#: Kinds of bytes: of letters and marks, the first and the other bytes of a digit, white space.  A symbol is kind << 8 | byte.
LETTERS, MARKS, DIGIT, DIGIT_GOES_ON, SPACE = range(5)
UNKNOWN, BLANK, NEVER = 255, (None, 0), 1 << 60
#: Bytes that byte-level vocabularies write as other characters: those that aren't printable, from 256 on.
BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
START = 0


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """Which tokens may follow each other.  Symbols are bytes, written as the vocabulary does; a piece's last one has END."""

    def __init__(self, spec: dict):
        self.end = spec["end_of_word_suffix"] or ""
        self.vocabulary = spec["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["merges"])}
        self.begins = {"".join(s[:k]) for s in map(self.symbols, self.vocabulary) for k in range(1, len(s))}
        whole = {t[: -len(self.end)] for t in self.vocabulary if self.end and t.endswith(self.end)}
        self.useful = {x: x for x in self.begins | self.vocabulary.keys() | whole}  # each text is held once
        self.ends: dict[str, tuple] = {}
        self.spines: dict[str, tuple | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and token != self.end:
            core = token[: -len(self.end)]
            return [*core[:-1], core[-1] + self.end]
        return list(token)

    def spine(self, token: str) -> tuple[list, list] | None:
        """What stands at the token's left edge and at its right edge while it is merged: (rank of the merge, symbol) from its first
        or last symbol to all of it.  None: its symbols don't merge to it."""
        if token not in self.spines:
            parts = self.symbols(token)
            left, right = [(-1, parts[0])], [(-1, parts[-1])]
            while len(parts) > 1:
                r, i = min((self.rank.get((a, b), NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if r == NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append((r, parts[0]))
                if i == len(parts) - 1:
                    right.append((r, parts[-1]))
            self.spines[token] = (left, right) if len(parts) == 1 and token in self.vocabulary else None
        return self.spines[token]

    def may_follow(self, one: str | None, two: str) -> bool:
        """Whether the symbols of both merge to just these two tokens: no merge across comes before those inside."""
        if one is None:
            return self.spine(two) is not None
        if (one, two) not in self.pairs:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            self.pairs[one, two] = self.spine(two) is not None and self._apart(self.spine(one)[1], self.spine(two)[0])
        return self.pairs[one, two]

    def _apart(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            across = self.rank.get((left[i][1], right[j][1]), NEVER)
            a, b = left[i + 1][0] if i + 1 < len(left) else NEVER, right[j + 1][0] if j + 1 < len(right) else NEVER
            if across < a and across <= b:  # of equal ranks the leftmost pair merges first
                return False
            if a == b == NEVER:
                return True
            i, j = i + (a <= b), j + (b <= a)

    def last_token(self, suffix: str, history: tuple, symbol: str) -> tuple[str, int]:
        """The token that ends with symbol, and how many tokens more (or fewer) the text then has."""
        text = suffix + symbol
        if text not in self.ends:  # tokens that end it, and how many symbols of the suffix each takes
            self.ends[text] = tuple((m, self.useful[text[len(suffix) - m :]]) for m in range(len(suffix) + 1) if text[len(suffix) - m :] in self.vocabulary)
        for m, token in self.ends[text]:
            if self.may_follow(history[m][0], token):
                return token, 1 - history[m][1]
        raise ValueError(f"no token ends in {symbol!r}")


class Open(NamedTuple):
    """A piece: suffix and history of what stands before its last symbol.  history[k]: the token that ends k symbols before, and the tokens since."""

    suffix: str
    history: tuple
    last: str


def grow(merges: Merges, piece: Open | None, symbol: str) -> tuple[Open, int]:
    """The piece with one more symbol, and the tokens that its symbols but the last have more than before.

    Kept are the places from which a token may go to the last symbol or beyond it; of others the history is blank."""
    if piece is None:
        return Open("", (BLANK,), symbol), 0
    token, more = merges.last_token(piece.suffix, piece.history, piece.last)
    suffix, history = piece.suffix + piece.last, ((token, 0), *((t, n + more) for t, n in piece.history))
    while suffix and suffix + symbol not in merges.useful:
        suffix = suffix[1:]
    n, suffix = len(suffix), merges.useful.get(suffix, suffix)
    return Open(suffix, tuple(history[k] if not k or suffix[n - k :] + symbol in merges.useful else BLANK for k in range(n + 1)), symbol), more


class Table:
    """(state, symbol) -> (state, tokens emitted), as arrays with open addressing; many keys are looked up at once."""

    def __init__(self, bits: int = 12):
        self.bits, self.held = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slots of the keys, or of nothing (-1) where they would go."""
        at = self._slots(keys)
        there = self.keys[at]
        lost = np.flatnonzero((there != keys) & (there >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[lost]]
            lost = lost[(there != keys[lost]) & (there >= 0)]
        return at

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if 3 * (self.held + len(keys)) > 2 << self.bits:
            full = self.keys >= 0
            old = self.keys[full], self.values[full]
            self.__init__(max(self.bits + 1, int(3 * (self.held + len(keys))).bit_length()))
            self.put(*old)
        self.held += len(keys)
        while len(keys):  # of keys that go to one slot the last gets it
            at = self.find(keys)
            self.keys[at] = keys
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values = keys[~own], values[~own]


class Transducer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec["model"])
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def forget(self) -> None:
        self.table = Table()
        self.numbers: dict = {}
        self.pieces: list[tuple[int, Open | None, int]] = [(SPACE, None, 0)]  # by state: kind, piece, tokens that the last symbol adds when the piece ends here
        self.special_steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._contractions()

    def state(self, kind: int, piece: Open, name: str = "") -> int:
        key = (kind, piece, name)
        if key not in self.numbers:
            self.numbers[key] = len(self.pieces)
            self.pieces.append((kind, piece, self.merges.last_token(piece.suffix, piece.history, piece.last + self.merges.end)[1]))
        return self.numbers[key]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """A transition: the next state and the tokens emitted."""
        kind, byte = divmod(symbol, 256)
        if kind == SPACE:
            return START, 0
        if (state, symbol) in self.special_steps:
            return self.special_steps[state, symbol]
        open_kind, piece, ends = self.pieces[state]
        goes_on = kind == DIGIT_GOES_ON or kind == open_kind != DIGIT
        more = -ends if goes_on else 0
        piece, n = grow(self.merges, piece if goes_on else None, chr(BYTE_LEVEL.get(byte, byte)))
        new = self.state(min(kind, DIGIT), piece, "'" if byte == 39 and not goes_on else "")
        return new, more + n + self.pieces[new][2]

    def _contractions(self) -> None:
        """An apostrophe that may begin a contraction has a state of its own, and so have the letters after it that may complete one."""
        of = lambda c: (MARKS if c == "'" else LETTERS) << 8 | ord(c)
        apostrophe, one = self.step(START, of("'"))
        for first, rest in CONTRACTIONS.items():
            piece, tokens = None, 0
            for c in "'" + first + rest:
                piece, n = grow(self.merges, piece, c)
                tokens += n
            tokens += self.merges.last_token(piece.suffix, piece.history, piece.last + self.merges.end)[1]
            if not rest:
                self.special_steps[apostrophe, of(first)] = START, tokens - one
                continue
            letter, n = self.step(START, of(first))
            half = self.state(LETTERS, self.pieces[letter][1], "'")
            self.special_steps[apostrophe, of(first)] = half, n
            self.special_steps[half, of(rest)] = START, tokens - one - n

    def symbols(self, text: str) -> np.ndarray:
        """A symbol for each byte of the text's UTF-8."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kinds = self.kinds[codes]
        if (kinds == UNKNOWN).any():
            for code in np.unique(codes[kinds == UNKNOWN]).tolist():  # as the library splits
                n = len(self.split(f"a{chr(code)}a"))
                self.kinds[code] = LETTERS if n == 1 else SPACE if n == 2 else MARKS if len(self.split(f"!{chr(code)}!")) == 1 else DIGIT
            kinds = self.kinds[codes]
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > len(codes):
            size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
            goes_on = (raw & 0xC0) == 0x80
            kinds = np.repeat(kinds, size)
            kinds[goes_on & (kinds == DIGIT)] = DIGIT_GOES_ON
        return np.where(kinds == SPACE, SPACE << 8, kinds.astype(np.int64) << 8 | raw)

    def run(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All states after one symbol each, and the tokens emitted."""
        keys = np.where(symbols == SPACE << 8, START, states) << 11 | symbols
        at = self.table.find(keys)
        lost = self.table.keys[at] < 0
        if lost.any():
            new = np.unique(keys[lost])
            found = [self.step(k >> 11, k & 2047) for k in new.tolist()]
            self.table.put(new, np.array([s << 8 | n + 128 for s, n in found]))
            at = self.table.find(keys)
        values = self.table.values[at]
        return values >> 8, (values & 255) - 128


def emitted(symbols: np.ndarray, fst: Transducer, chunk: int = CHUNK) -> np.ndarray:
    """The tokens emitted at each of the symbols, from the start."""
    chunk = max(min(chunk, len(symbols)), -(-len(symbols) // MOST_CHUNKS))
    n = -(-len(symbols) // chunk)
    padded = np.full(n * chunk, SPACE << 8)
    padded[: len(symbols)] = symbols
    by_chunk = padded.reshape(n, chunk)
    by_step = np.ascontiguousarray(by_chunk.T)
    out, path = np.zeros((chunk, n), np.int8), np.full((chunk + 1, n), START, np.int32)
    for t in range(chunk):
        path[t + 1], out[t] = fst.run(path[t].astype(np.int64), by_step[t])
    exits, entered, known, alike = path[chunk], path[0], {}, None  # rows of path: exits and entries as they are changed
    while len(wrong := np.flatnonzero(entered[1:] != exits[:-1]) + 1):
        if alike is None:
            alike = np.unique(by_chunk.astype(np.int16).view(np.dtype((np.void, 2 * chunk))).ravel(), return_inverse=True, return_counts=True)[1:]
        todo = {}
        for i in wrong.tolist():  # maps that are known are followed from chunk to chunk
            while i < n and entered[i] != exits[i - 1]:
                key = int(alike[0][i]), int(exits[i - 1])
                if key not in known:
                    todo.setdefault(key, i)
                    break
                path[:, i], out[:, i] = known[key]
                i += 1
        own, t = np.array(sorted(todo.values()), np.int64), 0
        entered[own] = exits[own - 1]
        states = entered[own].astype(np.int64)
        while len(own) and t < chunk:
            states, out[t, own] = fst.run(states, by_step[t, own])
            differ = path[t + 1, own] != states
            path[t + 1, own] = states
            t, own, states = t + 1, own[differ], states[differ]  # where the paths meet, the rest is as it was
        for (like, state), i in todo.items():
            if alike[1][like] > 1:
                known[like, state] = path[:, i].copy(), out[:, i].copy()
    return out.T.ravel()[: len(symbols)]


def count_tokens(texts: list[str | None], fst: Transducer, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of each text; strings of special tokens count one each, and cut it."""
    total = np.zeros(len(texts), np.int64)
    parts, owner, size = [], [], 0

    def count() -> None:
        lengths = np.array([1 + (len(p) if p.isascii() else len(p.encode())) for p in parts])
        if len(fst.pieces) > MOST_STATES:
            fst.forget()
        emits = emitted(fst.symbols("\n".join(parts) + "\n"), fst, chunk)
        np.add.at(total, owner, np.add.reduceat(emits.astype(np.int64), np.cumsum(lengths) - lengths))

    for i, text in enumerate(texts):
        for k, part in enumerate(fst.special.split(text) if text and "<|" in text else [text or ""]):
            total[i] += k > 0
            if part:
                parts.append(fst.normal(part) if PLAIN.search(part) else part.lower())
                owner.append(i)
                size += len(parts[-1])
                if size >= BLOCK:
                    count()
                    parts, owner, size = [], [], 0
    if parts:
        count()
    return total


_own: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One for each Python worker."""
    if path not in _own:
        _own[path] = Transducer(path)
    return _own[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, as the tokenizer counts without begin, end or other added tokens.

    Null texts count as empty: no bytes, no tokens.  Strings of special tokens inside a text count as the tokenizer's
    default has it, one token each.  Rows may repeat, ids may be null or of any type; other columns are not read.  path: a tokenizer file
    of the kind of VOCABULARY (byte-level pairs with an end-of-word suffix, its patterns, lower case)."""
    path = path or vocabulary()
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for b in batches:
            n = count_tokens(b.column(1).to_pylist(), fst)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.selectExpr("doc_id", "text", "cast(coalesce(octet_length(text), 0) as bigint) as n_bytes").mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))

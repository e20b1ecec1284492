"""The training-data operators against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat_format, decontamination, license_scan, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, tokens, warc
from quarry.llm._shared import LOWER, UPPER

FOLD = str.maketrans(UPPER, LOWER)
SPACE = r"[^\x20\x09-\x0D]+"
LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The columns of documents, and some whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, id string, h int, score string, kept string, label string, key string, n int, __score string"


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang)."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, "w", "i", 3, "s", "k", "l", "y", 4, "z") for r in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Texts that every operator must take."""
    rng = random.Random(1)
    same = prose(rng, 60)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, same), (6, same), (6, same), (None, "null id " + same), (None, None), (7, "É́ ß 漢字　x\x1cy <|endoftext|> don't " * 20, None), (8, prose(rng, 60_000)), (9, "a" * 300_000, "xx"), (10, "\n".join(["same line of words here"] * 40))]


def words_of(text, pattern=SPACE):
    return re.findall(pattern, (text or "").translate(FOLD))


# --- 1 -----------------------------------------------------------------------------------------------------------------


def brute_contamination(text, items):
    w, hit, found = words_of(text, LETTER), set(), set()
    for item, body in items:
        iw = words_of(body, LETTER)
        k = min(13, len(iw))
        for own in {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if iw else ():
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) == own:
                    hit |= set(range(p, p + k))
                    found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("most", [60_000, -1])
def test_contamination(spark, odd, monkeypatch, most):
    monkeypatch.setattr(decontamination, "MOST_ITEM_ROWS", most)  # -1: nothing is small enough to broadcast
    rng = random.Random(2)
    items = [(i, prose(rng, rng.randrange(13, 50))) for i in range(6)] + [(10, "short ITEM here"), (11, "solo"), (12, ""), (13, None), (None, "nul item " + prose(rng, 20)), (15, "x x x x x x x x x x x x x x x x x x")]
    part = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    rows = [r for r in odd if r[0] not in (8, 9)] + [
        (20, prose(rng, 30) + " " + part(0, 0, 13) + ", " + prose(rng, 20)), (21, part(1, 0, 12) + " zz"), (22, prose(rng, 400) + " " + part(2, 0, 13).upper()), (23, "a Short, item HERE b solo"),
        (24, part(3, 0, 13) + " " + part(4, 0, 13)), (25, "x " * 40), (25, "other text of that id " + part(0, 0, 13)), (26, items[10][1])]
    got = decontamination.contamination(docs(spark, rows), spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, words int")).collect()
    want = [(r[0], *brute_contamination(r[1], items)) for r in rows]
    key = lambda x: str(x)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=key) == sorted(want, key=key)
    assert all(r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in got)


def test_contamination_of_long_texts_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "p q r s t u v w x y z aa bb cc")], "item_id long, text string")
    long = docs(spark, [odd[10], (11, odd[10][1] + " p q r s t u v w x y z aa bb")])
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontamination.contamination(long, items).collect()} == {8: (60_000, 0), 11: (60_013, 13)}
    assert decontamination.contamination(docs(spark, []), items).count() == 0
    assert [r["n_hit"] for r in decontamination.contamination(docs(spark, odd[:3]), items.limit(0)).collect()] == [0, 0, 0]


# --- 2 -----------------------------------------------------------------------------------------------------------------


def test_classifier(spark, odd):
    rng = random.Random(4)
    ids = range(1000, 1200)
    rows = [(i, prose(rng, 80)) if i % 3 else (i, " ".join(["Buy"] * 30 + ["$$$ NOW!!"] * 30)) for i in ids]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in ids] + [(None, 1, 0), (1003, None, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows + odd)
    model = quality_classifier.fit(df, labels)
    assert len(model.votes) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in ids)
    got = quality_classifier.with_scores(df, model)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and got.count() == len(rows) + len(odd)
    score = {r["doc_id"]: r["__score"] for r in got.where("doc_id >= 1000 and n = 4").collect()}
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in score.values()) and sum((score[i] >= 0.3) == bool(i % 3) for i in held) == len(held)
    x = np.concatenate([t for _, _, t in quality_classifier.terms(__import__("pyarrow").array([r[1] for r in rows]))])
    v, vt = model.project(x), model.vectors
    cos = v @ vt.T
    for i in held[:5]:  # exact neighbours
        near = np.argsort(-cos[i - 1000], kind="stable")[: quality_classifier.NEIGHBOURS]
        w = np.maximum(cos[i - 1000][near], 1e-3) ** quality_classifier.POWER
        share = (w * model.votes[near]).sum() / w.sum()
        assert score[i] == pytest.approx(1 / (1 + math.exp(-np.clip(model.curve[0] * math.log((share + 0.01) / (1.01 - share)) + model.curve[1], -30, 30))), abs=2e-3)
    none = quality_classifier.fit(df, labels.limit(0))
    assert {r["__score"] for r in quality_classifier.with_scores(df, none).collect()} == {0.5}
    assert quality_classifier.with_scores(docs(spark, []), model).count() == 0
    assert quality_classifier.fit(df, labels, sample=7).votes.shape == (7,)
    many = df.unionByName(docs(spark, [(1001, f"other text {k}") for k in range(20)]))  # ids that repeat
    assert quality_classifier.fit(many, labels, sample=7).votes.shape == (7,)


def test_labels_without_documents(spark):
    """The sample is taken of labels whose documents are there, however many others there are."""
    df = docs(spark, [(i, f"text number {i}") for i in range(300)])
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert len(quality_classifier.fit(df, labels, sample=400).votes) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(300))


def test_terms_of_blocks():
    rng = random.Random(14)
    texts = [None, "", "one", "a a a a", "é漢 b", *[prose(rng, rng.randrange(60)) for _ in range(600)], "w " * 300_000]
    whole = {}
    for i, j, x in quality_classifier.terms(__import__("pyarrow").array(texts)):
        whole.update(zip(range(i, j), x, strict=True))
    assert sorted(whole) == list(range(len(texts)))
    for k, t in enumerate(texts):
        size, n = len((t or "").encode()), len((t or "").split())
        assert whole[k].sum() == size + max(0, size - 1) + max(0, size - 2) + n + max(0, n - 3)
        if k < 50:
            assert (whole[k] == next(quality_classifier.terms(__import__("pyarrow").array([t], "string")))[2]).all()


def test_held_out_accuracy(spark):
    """On the smallest labelled tables, with and without the patterns of recurrence."""
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    df, labels = read("documents").select("doc_id", "text"), read("labels")
    for patterns, least in ((True, 0.95), (False, 0.9)):
        model = quality_classifier.fit(df, labels, patterns=patterns)
        held = df.join(labels, "doc_id").where(quality_classifier.held_out(F.col("doc_id"))).dropDuplicates(["doc_id"]).collect()
        x = np.concatenate([t for _, _, t in quality_classifier.terms(__import__("pyarrow").array([r["text"] for r in held]), patterns)])
        assert np.mean((model.score(x) >= quality_classifier.THRESHOLD) == np.array([r["quality"] == 1 for r in held])) >= least


# --- 3, 10 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokens.vocabulary()).encode
    return lambda text: encode(text or "", add_special_tokens=False).ids


def test_token_counts(spark, odd, library):
    got = tokens.token_counts(docs(spark, odd)).collect()
    want = [(r[0], len((r[1] or "").encode()), len(library(r[1]))) for r in odd]
    assert sorted([(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got], key=str) == sorted(want, key=str)
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got) and tokens.token_counts(docs(spark, [])).count() == 0


def odd_texts(rng, n):
    bits = ["a", "b", "e", "s", "t", "th", "in", "É", ".", "'s", "'re", "'", " ", "\n", "\u3000", "<|endoftext|>", "12", "\x1c", "\u0301", "漢字", "İ", "Σ", "ß", "ς", "'ll", "l", "r", "v", "!!", "😀", "aaaa", "--", "½", "٣", "ǅ", "Å"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, 16, 256])
def test_transducer_agrees_with_the_library(library, chunk):
    fst, rng = tokens.transducer(tokens.vocabulary()), random.Random(chunk)
    texts = [*odd_texts(rng, 150), "a" * 700, "ab" * 300 + "'re", "".join(rng.choice("etaoinshrdlu") for _ in range(2000)), None, "", " \n"]
    texts += ["".join(rng.choices("etaoinshrdlu'. ", k=rng.randrange(60))) for _ in range(150)]
    assert tokens.count_tokens(texts, fst, chunk).tolist() == [len(library(t)) for t in texts]
    assert tokens.count_tokens(texts[:40], fst, chunk).tolist() == [tokens.count_tokens([t], fst, chunk)[0] for t in texts[:40]]


def test_transducer_forgets(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_STATES", 50)
    monkeypatch.setattr(tokens, "MOST_PAIRS", 20)
    monkeypatch.setattr(tokens, "BLOCK", 100)
    fst, texts = tokens.Transducer(tokens.vocabulary()), odd_texts(random.Random(9), 200)
    assert tokens.count_tokens(texts, fst).tolist() == [len(library(t)) for t in texts]


def test_transducer_spells_the_vocabulary():
    fst = tokens.transducer(tokens.vocabulary())
    words = [w for t in list(fst.merges.vocabulary)[512::97] if (w := t.removesuffix("</w>")).isascii() and w.isalpha()]
    assert len(words) > 300
    got = tokens.count_tokens(words, fst)
    assert [int(n) for n, w in zip(got, words, strict=True) if w + "</w>" in fst.merges.vocabulary] == [1] * sum(w + "</w>" in fst.merges.vocabulary for w in words)


def test_token_counts_of_other_ids(spark):
    df = spark.createDataFrame([("x", "a b"), ("x", None), (None, "c")], "doc_id string, text string")
    assert sorted([tuple(r) for r in tokens.token_counts(df).collect()], key=str) == sorted([("x", 3, 2, False), ("x", 0, 0, False), (None, 1, 1, False)], key=str)


def packed(spark, rows, library, capacity):
    got = packing.pack(docs(spark, rows), capacity).collect()
    want = Counter()
    for r in rows:
        ids = np.array([*library(r[1]), 0], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            own = ids[s : s + capacity]
            want[r[0], k, s, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len({r["sequence_id"] for r in got}), sum(r["length"] for r in got)


@pytest.mark.parametrize(("capacity", "salted"), [(2048, 50_000), (16, 3)])
def test_packing(spark, odd, library, monkeypatch, capacity, salted):
    monkeypatch.setattr(packing, "SALTED", salted)
    n, total = packed(spark, [*odd, *[(100 + i, "ab " * (i % 9)) for i in range(200)]], library, capacity)
    assert n <= math.ceil(total / capacity * 1.05) + 1
    assert packing.pack(docs(spark, [])).count() == 0


def test_plan_is_as_good_as_best_fit():
    rng = random.Random(6)
    for _ in range(50):
        counts = {rng.randrange(1, 101): rng.randrange(1, 60) for _ in range(rng.randrange(1, 12))}
        rows = packing.plan(counts, 100)
        place, used = Counter(), Counter()
        for length, rank, n, first, offset in rows:
            for i in range(n):
                place[length, rank + i] += 1
                used[first + i] += length
                assert offset + length <= 100
        assert place == Counter({(x, i): 1 for x, n in counts.items() for i in range(n)}) and max(used.values()) <= 100
        bins = []
        for x in sorted(counts, reverse=True):
            for _ in range(counts[x]):
                fit = [b for b in range(len(bins)) if bins[b] >= x]
                if fit:
                    bins[min(fit, key=lambda b: bins[b])] -= x
                else:
                    bins.append(100 - x)
        assert len(used) <= len(bins) * 1.05 + 1


# --- 4 -----------------------------------------------------------------------------------------------------------------


def test_quality_base(spark, odd):
    rng = random.Random(7)
    rows = [*odd, (30, "a b c d e f g h i " * 3), (31, "x " * 30), (32, "x y\nx y\n \n\nx y\nz"), (33, prose(rng, 40) + " #$%"), (34, prose(rng, 25) + " " + prose(random.Random(8), 9) + " mid " + prose(random.Random(8), 9))]
    for r, row in zip(sorted(quality_rules.with_quality(docs(spark, rows)).select("doc_id", "text", "__quality.*").collect(), key=str), sorted(rows, key=lambda x: str((x[0], x[1]))), strict=False):
        w = re.findall(SPACE, r["text"] or "")
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        spots = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in (r["text"] or "").split("\n") if re.search(SPACE, x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"] or "")), len(lines) - len(set(lines)), len(spots)), row[0]
        assert r["base_failed"] == (len(w) < 20 or 100 * len(spots) > 30 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.with_quality(docs(spark, [])).count() == 0


def test_quality_divergence(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 150), "en") for i in range(60)] + [(100, "BUY NOW!! " * 3 + prose(rng, 100).upper().replace(" ", "!! "), "en"), (101, prose(rng, 150).replace(" ", "$$$ "), "en"), (102, prose(rng, 150), None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0), (None, 1, 0), (500, 1, 0)], "doc_id long, quality int, toxic int")
    refs = quality_rules.references(docs(spark, rows), labels)
    assert set(refs) == {"en"} and refs["en"].words[:4] == [w for w, _ in sorted(Counter(w for r in rows[:60] for w in words_of(r[1], LETTER)).items(), key=lambda x: (-x[1], x[0]))[:4]]
    df = quality_rules.with_quality(docs(spark, rows), refs)
    assert df.columns == [*docs(spark, []).columns, "__quality"]
    got = {r["doc_id"]: r["__quality"] for r in df.collect()}
    assert all(got[i]["kept"] for i in range(60)) and got[102]["kept"] and got[102]["word_distance"] is None and not got[100]["kept"] and not got[101]["kept"]
    assert quality_rules.references(docs(spark, rows), labels.limit(0)) == {} and quality_rules.references(docs(spark, rows), labels.where("doc_id < 19")) == {}
    p, q = np.array([1, 2, 0, 5]) / 8, np.array([0.1, 0.2, 0.3, 0.4])
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = (p + q) / 2
    d = spark.createDataFrame([([1, 2, 0, 5], 8, q.tolist())], "c array<long>, n long, q array<double>").select(quality_rules.distance(F.col("c"), F.col("n"), F.col("q")).alias("d")).first()["d"]
    assert d == pytest.approx(math.sqrt(kl(p, m) / 2 + kl(q, m) / 2))


def test_quality_references_of_all_trusted(spark):
    """Also of more than a thousand, and of documents whose id repeats."""
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(("alpha", "beta", "Gamma1", "delta;", f"w{i}x"), (5, 4, 3, 2, 1), k=30)), "en") for i in range(1500)]
    rows += [rows[3], (2000, "too few", "en"), (2001, "omega " * 40, None), (2002, "omega " * 40, "en")]
    labels = spark.createDataFrame([(r[0], int(r[0] != 2002), 0) for r in rows], "doc_id long, quality int, toxic int")
    ref = quality_rules.references(docs(spark, rows), labels)["en"]
    words = Counter(w for _, text, _ in rows[:1501] for w in words_of(text, LETTER))
    top = sorted(words.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.N_COMMON]
    assert ref.words == [w for w, _ in top] and ref.shares == pytest.approx([k / words.total() for _, k in top] + [1 - sum(k for _, k in top) / words.total()])
    whole = "".join(text for _, text, _ in rows[:1501])
    assert ref.chars == pytest.approx([len(re.findall(p, whole)) / len(whole) for p in ("[a-z]", "[A-Z]", "[0-9]", " ", ";", "#", "[^\x00-\x7F]")])


RUSSIAN = "Дом стоял на холме и был старым, а в саду играли дети из деревни. Каждый вечер они возвращались домой по длинной дороге. "
GREEK = "Το σπίτι ήταν στον λόφο και ήταν παλιό, στον κήπο έπαιζαν τα παιδιά του χωριού. Κάθε βράδυ γύριζαν στο σπίτι από τον μακρύ δρόμο. "
CHINESE = "房子 在 山上， 很 旧。 村里 的 孩子们 在 花园 里 玩耍。 每天 晚上 他们 沿着 长长的 路 回家。 "
CODE = "import os\n\ndef walk(root, names):\n    out = []\n    for name in names:\n        path = os.path.join(root, name)\n        if os.path.isdir(path):\n            out.append(path)\n    return out\n\nclass Tree:\n    def __init__(self, root):\n        self.root = root\n"
LATIN = "The house stood on a hill and it was old, with a garden in which the children of that village came to play for hours. It is said that in the summer, when the days were long, they would go to the river and to the old mill. "


def test_other_scripts_and_code_are_not_dropped(spark, tmp_path):
    """Whatever the language column says; and the SQL has the same verdicts."""
    rng = random.Random(30)
    mixed = lambda text, sep: sep.join(rng.sample(text.split(sep), len(text.split(sep))))
    good = [(i, mixed(LATIN * 3, " "), "en") for i in range(40)]
    odd = [(100 + 10 * k + j, mixed(text * 3, " "), lang) for k, text in enumerate((RUSSIAN, GREEK, CHINESE)) for j, lang in enumerate(("en", "ru", None))] + [(200, CODE, "en"), (201, LATIN.replace("the", "The,"), "en"), (202, "# Heading\n" + mixed(LATIN * 2, " "), "en")]
    junk = [(300, "BUY NOW!! " * 2 + mixed(LATIN, " ").upper().replace(" ", "!! "), "en"), (301, mixed(LATIN * 3, " ").replace(" ", " $$$ "), "en"), (302, " ".join(f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(150)), "en")]
    rows = good + odd + junk
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: tuple(r) for r in quality_rules.op4_quality_rules(spark, str(tmp_path)).collect()}
    kept = {i for i, r in got.items() if r[-1]}
    assert kept == {r[0] for r in good + odd}, (sorted(kept ^ {r[0] for r in good + odd}))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert {r[0]: r for r in con.sql(quality_rules.ORACLE).fetchall()} == got


# --- 5 -----------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(10)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "[\\\\INST]", "\\", "\n", " ", "a", "É", "<", "[/", "s>"]
    text = lambda: rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole</s>", ""]), text(), 9) for c in [*range(30), None] for t in range(rng.randrange(1, 6))] + [(5, 0, "user", "tie", 9)] * 3 + [(40, i, "assistant", "x" * 50, 9) for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1], r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest())
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_format.format_conversations(df.limit(0)).count() == 0
    for bad in ("x", "<s>user\nx</s>", "<s>a\n[INST]</s>"):
        with pytest.raises(ValueError, match="turn|instruction"):
            chat_format.parse(bad)


# --- 6 -----------------------------------------------------------------------------------------------------------------


def sets_of(rows, size):
    out = {}
    for i, text, *_ in rows:
        w = words_of(text)
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("size", "percent", "part"), [(3, 85, 2048), (5, 80, 7)])
def test_near_duplicates(spark, monkeypatch, size, percent, part):
    monkeypatch.setattr(near_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "SPLIT", 5)
    rng = random.Random(11)
    rows, base = [], [prose(rng, 120, 3000).split() for _ in range(3)]
    for i in range(120):  # copies with more and more changes, links just above and below the threshold, chains
        w = list(base[i % 3])
        for _ in range(rng.randrange(0, 14)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[5][1].upper()) for i in range(20)] + [(300, None), (301, ""), (302, "one"), (303, "ONE"), (304, "one two"), (305, prose(rng, 50_000, 10**6)), (306, "   ")]
    got = near_dedup.near_duplicates(docs(spark, rows + [(None, rows[5][1]), (None, "alone here all day"), (7, rows[7][1])]), size, percent).collect()
    sets = sets_of(rows, size)
    want = brute_components(sets, percent)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert len(got) == len(rows) + 3 and sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == sorted([want[5], None], key=str)
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_sketch_is_mergeable_and_estimates():
    rng = np.random.default_rng(12)
    a, b = (np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)) for _ in range(2))
    common = a[:600]
    b = np.unique(np.concatenate([common, b[:300]]))
    one = lambda *xs: near_dedup.sketch(np.concatenate(xs), np.cumsum([0, *map(len, xs)]))
    ra, rb, rab = one(a)[0], one(b)[0], one(np.unique(np.concatenate([a, b])))[0]
    assert (np.maximum(ra, rb) == rab).all()
    got = near_dedup.estimate(*[np.array([x]) for x in ((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum(), len(a), len(b))])[0]
    assert abs(got - len(common) / (len(a) + len(b) - len(common))) < 0.25
    sets = [np.unique(rng.integers(0, 500, 300, dtype=np.uint64)) for _ in range(9)]
    inter = near_dedup.intersections(np.concatenate(sets), np.array([len(s) for s in sets]), 64)
    assert all(inter[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(9) for j in range(9) if i != j)


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_license_scan(spark, odd):
    rows = [*odd, (40, "All rights reserved. CC BY, cc-by 4.0\nGeneral Public License"), (41, "x\nReleased under the MIT License.\ny"), (42, "released under MIT the license of"), (43, "Released\nunder the\nMIT License"), (44, "License MIT the under"), (45, "cc by " * 5), (46, "general public")]
    got = license_scan.license_scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        w = words_of(text[r["doc_id"]], LETTER)
        at = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        own, best = {label for _, label in at}, 0.0
        for line in (text[r["doc_id"]] or "").split("\n"):
            b = set(words_of(line, LETTER))
            for label, s in license_scan.template_sets():
                if len(b & set(s)) >= math.ceil(0.8 * len(s) - 1e-9):
                    own.add(label)
                    best = max(best, len(b & set(s)) / len(s))
        starts = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None))
        assert (r["base_labels"], r["labels"]) == (",".join(sorted({x for _, x in at})), ",".join(sorted(own))) and r["score"] == pytest.approx(1 if at else best)
    assert license_scan.license_scan(docs(spark, [])).count() == 0


# --- 8 -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [200_000, -1])
def test_warc(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "MOST_COPIED", most)
    monkeypatch.setattr(warc, "BLOCK", 7)
    big = "<p>é</p>" * 40
    rows = [(i, f"http://h{i % 5}.example.org/{i}", f"<html>{i} {'x' * i}</html>", "d", 1) for i in range(60)] + [(70 + i, "http://hot.example.org/", big, "d", 1) for i in range(30)] + [(200, None, None, "d", 1), (201, "http://a b/\r\nX: y\t", "", "d", 1), (None, "u", big, "d", 1), (202, "http://s.org", "s", "d", 1), (203, "http://s.org", "s", "d", 1), (70, "http://hot.example.org/", big, "d", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, size int")
    directory, folder = warc.archive(pages)
    got = warc.read_all(directory, folder).collect()
    want = Counter()
    for p, _, html, *_ in rows:
        raw = (html or "").encode()
        copy = html == big and p != 70
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if copy else "response", 70 if copy else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {r["page_id"]: r["payload"].decode() for r in got if r["page_id"] is not None and r["page_id"] < 60} == {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 60}
    for url in ("http://h3.example.org/13", "http://hot.example.org/", "http://s.org", "http://a b/\r\nX: y\t"):
        assert len(warc.look_up(directory, folder, url)) == sum(r[1] == url for r in rows)
    assert warc.look_up(directory, folder, "http://none.org/") == []
    assert warc.url_key("https://User@WWW.a.Example.org:80/x?y#z") == "org,example,a,www:80)/x?y#z"
    empty, folder = warc.archive(pages.limit(0))
    assert warc.read_all(empty, folder).count() == 0


# --- 9 -----------------------------------------------------------------------------------------------------------------


def test_lm_scores(spark, odd, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH", 500)
    rng = random.Random(13)
    rows = [(100 + i, prose(rng, rng.randrange(0, 80), 50)) for i in range(150)] + odd
    got = lm_scoring.lm_scores(docs(spark, rows).repartition(3)).collect()
    w = [(i, words_of(t)) for i, t, *_ in rows]
    uni, bi = Counter(x for _, ws in w for x in ws), Counter(p for _, ws in w for p in zip(ws, ws[1:], strict=False))
    n, want = sum(uni.values()), []
    for i, ws in w:
        own, total = Counter(zip(ws, ws[1:], strict=False)), 0.0
        for p in zip(ws, ws[1:], strict=False):
            c = bi[p] - own[p]
            total += math.log10(c / uni[p[0]] if c else 0.4 * uni[p[1]] / n)
        want.append((i, len(ws), total / (len(ws) - 1) if len(ws) > 1 else None))
    key = lambda x: str((x[0], x[1]))
    for g, x in zip(sorted([tuple(r) for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[:2] == x[:2] and g[2] == (None if x[2] is None else pytest.approx(x[2], abs=1e-4))
    assert lm_scoring.lm_scores(docs(spark, [])).count() == 0

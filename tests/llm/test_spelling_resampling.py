"""Spelling variants and importance resampling against brute force."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, same

from lumenlog.llm import resampling as R
from lumenlog.llm import spelling as W


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts, ratio=10):
    form, out = {}, []
    by = {w: [v for v in counts if near(w, v)] if len(w) >= W.LEAST else [] for w in counts}
    by = {w: [v for v in vs if len(v) >= W.LEAST] for w, vs in by.items()}
    for w, vs in by.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(by[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def found(spark, counts, **how):
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in W.spelling_variants(df, **how).collect()), key=repr)


@pytest.mark.parametrize("alphabet", ["ab", "abcdé", "aé漢"])
def test_variants_equal_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(120)}
    for w in list(words)[:60]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice(alphabet) + w[i:], w[:i] + rng.choice(alphabet) + w[i + 1 :]} - {""}
    counts = {w: rng.choice([1, 2, 20, 200, 4000]) for w in sorted(words)}
    assert found(spark, counts) == variants(counts)
    assert found(spark, counts, ratio=2) == variants(counts, 2)


def test_any_order_of_bigrams_gives_the_same_rows(spark, monkeypatch):
    counts = {w: n for n, w in enumerate("because becuase becaus becausee beecause bicause precause banana banan bananas aaaaaaa aaaaaa aaaaaaaa".split(), 1)}
    expected = variants(counts)
    assert found(spark, counts) == expected
    monkeypatch.setattr(W, "ORDERED", 3)
    assert found(spark, counts) == expected


def test_chains_ties_and_repeated_words(spark):
    counts = {"abcdefg": 1, "abcdefgh": 10, "abcdefghi": 100, "abcdefghij": 1000, "xbcdefg": 10, "zzzzzzz": 5}
    got = {r[0]: r for r in found(spark, counts)}
    assert got["abcdefg"][1:3] == ("abcdefgh", "abcdefghij") and got["zzzzzzz"] == ("zzzzzzz", None, "zzzzzzz", 5, 0, None)
    df = spark.createDataFrame([("word1", 1), ("word1", 2), (None, 3)], "word string, n long")
    assert [tuple(r) for r in W.spelling_variants(df).select("word", "n", "root").collect()] == [("word1", 3, "word1")]
    assert W.spelling_variants(df.where("n > 9")).collect() == []


def test_vocabulary_equals_a_plain_one(spark):
    rng = random.Random(9)
    letters = "abcXYZéÉ×÷"
    rows = [(i, " ".join("".join(rng.choice(letters[: rng.randint(1, 10)]) for _ in range(rng.randint(1, 10))) for _ in range(200))) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "漢字abcdefgh漢" * 3), (None, "abcdefgh abcdefgh")]
    counts = {}
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= 7:
                counts[word] = counts.get(word, 0) + 1
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    assert {r["word"]: r["n"] for r in W.vocabulary(df).collect()} == {w: n for w, n in counts.items() if n > 1}


def features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[j : j + k]) for k in range(1, most + 1) for j in range(len(words) - k + 1)]


@pytest.mark.parametrize("most", [1, 2, 4])
def test_ngram_crcs_equal_those_of_the_strings(most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("abc XYZ09é漢-,\n") for _ in range(rng.randint(0, 300))) for _ in range(30)] + ["", "x" * 500 + " " + "y" * 49 + " " + "z" * 48 + " é" * 3]
    got = R.Grams(pa.array(texts), most, 10_000)
    expected = sorted((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features(t, most)[1])
    assert sorted(zip(got.text.tolist(), got.bucket.tolist(), strict=True)) == expected
    assert got.words.tolist() == [len(features(t, 1)[0]) for t in texts]


def test_combination_appends():
    a, b = b"some words", b" and more of them, of another length"
    crc = lambda x: np.array([zlib.crc32(x)], np.uint32)
    assert R.combined(crc(a), crc(b), np.array([len(b)])) == crc(a + b)
    assert R.combined(crc(a), crc(b""), np.array([0])) == crc(a)


def draw(docs, target, percent, most, buckets, least, seed=2024):
    import hashlib
    import math

    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in features(x, most)[1]:
                counts[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (s.sum() + buckets) / ((x + 1) * (t.sum() + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for doc, text in docs:
        words, fs = features(text, most)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs) // max(len(fs), 1)
        h = int(hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i for i, r in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize(("most", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_draw_equals_a_plain_one(spark, docs, words, most, percent):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [words(30), None, "", words(80), rows[7][1]]
    got = R.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, most, 500, 20)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == draw(rows, target, percent, most, 500, 20)


def test_empty_tables_and_rows_without_id(spark, docs, empty):
    target = spark.createDataFrame([("one two",)], "text string")
    assert R.resample(empty, target).collect() == []
    assert R.resample(docs, target.where("1 = 0")).count() == docs.count()
    odd = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert sorted((r["doc_id"] is None, r["score"] is None, r["rank"]) for r in R.resample(odd, target, 100, least_words=2).collect()) == [(False, False, 1), (True, True, None)]


def test_queries_equal_sql(spark, sf):
    assert same(W.op11(spark, sf), connect(sf), W.SQL["op11_spelling"]) > 0
    assert same(R.op13(spark, sf), connect(sf), R.SQL["op13_resampling"]) > 0

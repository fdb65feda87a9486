"""Suffix-array dedup against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect

from lumenlog.llm import suffix_dedup as S


def slices(rng, alphabet):
    got = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))]
    return got + got[:2] if rng.random() < 0.4 else got


def table(texts, twice=False):
    rows = [(5, i, copy, S._digest(t) if copy else t) for i, t in enumerate(texts) for copy in range(1 + twice)]
    kinds = {"key": pa.int64(), "context": pa.int64(), "copy": pa.int32(), "text": pa.binary()}
    return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(kinds.items())})


def repeated(texts, width):
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    return [i + width <= len(t) and seen[t[i : i + width]] > 1 for t in texts for i in range(len(t))]


@pytest.mark.parametrize("alphabet", [b"ab", b"\x00ab", bytes(range(256))])
def test_array_and_merging_equal_brute_force(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(80):
        texts, width = slices(rng, alphabet), rng.choice([7, 9, 14, 20])
        data, first = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
        suffixes = sorted((tuple(x + 1 for x in t[j:]) + (0,), int(first[i]) + j) for i, t in enumerate(texts) for j in range(len(t)))
        assert S.suffix_array(data, first)[0].tolist() == [p for _, p in suffixes]
        assert S.Shard(table(texts), width).again.tolist() == repeated(texts, width)
        doubled = S.Shard(table(texts, twice=True), width)
        assert doubled.again.tolist() == [i + width <= len(t) for t in texts for i in range(len(t))]
        cut = rng.randint(1, len(texts))
        a, b = S.Shard(table(texts[:cut]), width), S.Shard(table(texts[cut:]), width)
        a.merge(b, 5)
        assert a.again.tolist() + b.again.tolist() == repeated(texts, width)


def plain(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        gone[-1] = False
        kept = bytes(x for x, g in zip(t, gone, strict=False) if not g)
        spans = int((gone[:-1] & ~np.append(False, gone[:-2])).sum()) if len(t) else 0
        out.append((doc, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **how):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in S.suffix_dedup(docs, **how).collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"width": 40, "grams": (12, 32, 40), "contexts": 2, "shard": 3000}, {"width": 40, "grams": (7, 20, 40), "contexts": 10_000, "shard": 500}])
def test_equals_brute_force(docs, how):
    """Nulls, empty texts, repeated rows, ties, odd bytes; lengthened keys, and shards that cut a key."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs, **how) == plain(rows, how.get("width", 200))


def test_rows_of_one_id_rows_without_id_and_cuts_within_a_character(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, accents = text(500), "é" * 260
    rows = [(1, long), (1, text(400)), (None, long[:300]), (None, None), (2, text(150) + long[100:350]), (3, "x" + accents), (4, accents), (5, "y" * 900), (6, long), (6, long)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string")
    assert found(df) == plain(rows, 200)


def test_a_long_text_comes_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text.encode()])], ["id", "text"])
    whole = {(x, y) for b in S._anchored(200, 64, True)(iter([batch])) for x, y in zip(b.column("key").to_pylist(), b.column("lo").to_pylist(), strict=True)}
    monkeypatch.setattr(S, "PIECE", 7000)
    parts = [b for b in S._anchored(200, 64, True)(iter([batch]))]
    assert whole <= {(x, y) for b in parts for x, y in zip(b.column("key").to_pylist(), b.column("lo").to_pylist(), strict=True)}
    covered = [i for b in parts for lo, more in zip(b.column("lo").to_pylist(), b.column("more").to_pylist(), strict=True) for i in range(lo, lo + more + 1)]
    assert sorted(covered) == list(range(len(text) - 199))  # each window once


def test_many_surroundings_of_one_passage(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = text(36), text(48)
    rows = [(i, text(60) + line + text(50) + (passage if i % 3 else "") + text(30)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, width=40, grams=(12, 32, 40), contexts=10, shard=2000) == plain(rows, 40)


def test_empty(empty):
    assert S.suffix_dedup(empty).collect() == []


def test_query_equals_sql(spark, sf):
    from oracle import same

    assert same(S.op12(spark, sf), connect(sf), S.SQL["op12_suffix_dedup"]) > 0

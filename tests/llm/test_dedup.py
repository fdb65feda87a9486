"""Substring dedup, exact dedup and the Jaccard join against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, same

from lumenlog.llm import common, exact_dedup, jaccard_join, substring_dedup


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def brute_substrings(rows, width):
    seen = Counter()
    split = [(i, t.encode().split()) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                keep[k : k + width] = [False] * width
        out.append((i, len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()))
    return sorted(out)


@pytest.mark.parametrize("width", [35, 20])
def test_substrings(docs, width):
    got = sorted(tuple(r) for r in substring_dedup.substring_dedup(docs, width).collect())
    assert got == brute_substrings(texts(docs), width)
    assert any(r[2] for r in got)


def test_substrings_of_an_empty_table(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_hot_and_lengthened_prefixes_give_the_same(docs, monkeypatch):
    cuts = lambda df: sorted({(r["doc_id"], k) for r in df.collect() for k in range(r["lo"], r["hi"])})
    want = cuts(substring_dedup.repeats(docs, 20))
    assert want and cuts(substring_dedup.repeats(docs, 20, most=1)) == want
    real = common.hot_keys
    monkeypatch.setattr(substring_dedup, "hot_keys", lambda df, col, least, tracked=20_000: real(df, col, 2))
    assert cuts(substring_dedup.repeats(docs, 20)) == cuts(substring_dedup.repeats(docs, 20, most=1)) == want


def test_a_long_repeat_comes_from_one_deep_node():
    w = [b"%d" % i for i in range(90)]
    slices = [w[:50], [b"x", *w[:45], b"y"], w[60:], [b"z"] * 40]
    place, own, depth = substring_dedup.subtree(np.array([0, 0, 0, 1]), np.array([False] * 4), slices, 35)
    got = {(int(o), int(p)): int(d) for p, o, d in zip(place, own, depth, strict=True)}
    assert got[0, 0] == 45 and got[1, 51] == 45 and got[1, 50] == 0  # one node for the repeat of 45 words
    assert got[0, 15] == 0 or got[0, 15] < 35
    assert all(o != 2 for o, _ in got) and got[3, 127] == 39  # a text that repeats itself
    assert substring_dedup.subtree(np.array([0]), np.array([True]), [w[:36]], 35)[2].tolist() in ([36, 35], [35, 36])


def test_subtrees_against_all_pairs():
    rng = random.Random(8)
    slices = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(3, 20))] for _ in range(40)]
    group = np.sort(np.array([rng.randrange(4) for _ in slices]))
    place, own, depth = substring_dedup.subtree(group, np.zeros(40, bool), slices, 3)
    begin = np.append(0, np.cumsum([len(x) for x in slices]))
    rest = [(int(o), slices[o][p - begin[o] :]) for p, o in zip(place, own, strict=True)]
    assert len(rest) == sum(len(x) - 2 for x in slices)
    common_ = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    for i, (o, s) in enumerate(rest):
        assert depth[i] == max((common_(s, t) for j, (q, t) in enumerate(rest) if j != i and group[q] == group[o]), default=0)


def test_substrings_equal_their_sql(spark, sf):
    assert same(substring_dedup.op1(spark, sf), connect(sf), substring_dedup.SQL["op1_substring_dedup"])


def test_exact(docs):
    rows = [(i, re.sub(r"[ \t\n\x0b\f\r]+", " ", t)) for i, t in texts(docs)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(docs).collect()) == want
    assert sorted(tuple(r) for r in exact_dedup.exact_dedup(docs, large=1).collect()) == want  # all digests salted


def test_exact_of_an_empty_table(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_exact_equals_its_sql(spark, sf):
    same(exact_dedup.op3(spark, sf), connect(sf), exact_dedup.SQL["op3_exact_dedup"])


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard(docs, k, percent):
    got = {tuple(r) for r in jaccard_join.jaccard_join(docs, k, percent).collect()}
    assert got == brute_components(texts(docs), k, percent)


def test_jaccard_with_common_shingles(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LEAST", 2)
    assert len(jaccard_join.common_shingles(docs, 4)) > 100
    assert {tuple(r) for r in jaccard_join.jaccard_join(docs, 4, 85).collect()} == brute_components(texts(docs), 4, 85)


def test_jaccard_of_an_empty_table(empty):
    assert jaccard_join.jaccard_join(empty).count() == 0


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (2, 60)])
def test_jaccard_with_blocks_of_several_chunks(docs, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    monkeypatch.setattr(jaccard_join, "GROUP", 2)
    assert {tuple(r) for r in jaccard_join.jaccard_join(docs, k, percent).collect()} == brute_components(texts(docs), k, percent)


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    """Random pairs at the edge of the threshold, of all sizes, never miss."""
    rng = random.Random(percent)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 5, 6, 7, 12, 16, 17, 18, 25, 60, 200, 700])
        pool = rng.sample(range(1 << 40), 2 * n + 2)
        best = next((x for x in range(n, -1, -1) if 100 * (n - x) >= percent * (n + x)), n)  # change x shingles each way
        a = pool[:n]
        b = a[: n - best] + pool[n : n + best] if rng.random() < 0.5 else a[: max(1, -(-percent * n // 100))]
        both = len(set(a) & set(b))
        if 100 * both < percent * (len(set(a) | set(b))):
            continue
        t = np.repeat([0, 1], [len(a), len(b)])
        s = np.concatenate([np.sort(np.array(x, np.uint64)) for x in (a, b)])
        common = np.sort(np.array(rng.sample(pool, rng.choice([0, 1, n // 3, n, 2 * n])), np.uint64))
        ti, cls, sig = jaccard_join.signatures(t, s, np.array([len(a), len(b)]), percent, common)
        at = [set(zip(cls[ti == i].tolist(), sig[ti == i].tolist(), strict=True)) for i in (0, 1)]
        assert at[0] & at[1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (20, 21), (21, 22), (22, 20)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(31)}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES", 40)  # the driver's share: how many tasks contract what is left
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i % 7, 1000 + i) for i in range(200)]
    edges = spark.createDataFrame(chain, "a long, b long").repartition(16, "b")
    got = dict(map(tuple, common.components(edges).collect()))
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 + i % 7 for i in range(200)}

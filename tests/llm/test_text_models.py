"""Learned operators: held-out accuracy on the tables, and their parts against plain versions."""

import itertools
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import language_id, pii, quality, toxicity

SF = "/root/testdata/sf0.01"


def scored(spark, op, column, table):
    t = spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id", column).where(F.col(column).isNotNull())
    return op(spark, SF).join(t, "doc_id").toPandas()


def test_language_held_out(spark):
    r = scored(spark, language_id.op8, "lang", "documents")
    out = r[r.held_out]
    assert len(out) > 100 and (out.lang == out.lang_pred).mean() > 0.97 and r.score.between(0, 1).all()


def test_texts_of_uneven_length_share_their_steps(monkeypatch):
    """A slice takes as many steps as its longest text has words: a few long texts are not one slice each."""
    model, steps, real = language_id.Model(["a", "b"]).fit(["uno due tre", "one two three"], ["a", "b"], rounds=1), [], language_id.sums

    def sums(first, *rest):
        steps.append(int(np.diff(first).max()))
        return real(first, *rest)

    monkeypatch.setattr(language_id, "sums", sums)
    texts = [f"uno due {'tre ' * 40_000}", *["one two three"] * 50] * 9  # 1.4 MB, nine long ones
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = list(language_id._predict(model, lambda b: b.column("text"))(iter([batch])))
    assert sum(b.num_rows for b in got) == len(texts) and sum(steps) == 40_002


def test_a_slice_is_held_as_numbers():
    """A text's words go once they are numbered, and no array of all words and languages is held more often than it takes."""
    model = language_id.Model(["a", "b", "c", "d"]).fit(["uno due tre", "one two three", "eins zwei drei", "un deux trois"], ["a", "b", "c", "d"], rounds=1)
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i:04}" for i in range(2000)])
    texts = [" ".join(rng.choice(vocabulary, 600)) for _ in range(500)]  # 1.8 MB, 300,000 words
    run, batch = language_id._predict(model, lambda b: b.column("text")), pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    try:
        got = list(run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(b.num_rows for b in got) == 500 and peak < 18 << 20


def test_language_edges(spark, docs, empty):
    model = language_id.train(docs)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[6] == "en"
    assert language_id.train(empty).languages == []
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.train(empty)).collect()} == {"und"}
    assert language_id.identify(empty, model).count() == 0


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(1)
    first, k = np.array([0, 4, 4, 5, 7]), 3
    e, t, s = rng.normal(size=(7, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got, pairs = language_id.sums(first, e, t, s)
    expected = np.zeros((k, k))
    for a, b in zip(first[:-1], first[1:], strict=True):
        want, both = np.zeros((b - a, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(b - a)):
            w = np.exp(sum(e[a + i, x] for i, x in enumerate(path)) + sum(t[x, y] for x, y in zip(path, path[1:], strict=False)) + (s[path[0]] if path else 0))
            for i, x in enumerate(path):
                want[i, x] += w
            for x, y in zip(path, path[1:], strict=False):
                both[x, y] += w
        if b > a:
            assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))
            expected += both / want[0].sum()
    assert np.allclose(pairs, expected)


def test_language_gradient_by_finite_differences():
    rng = np.random.default_rng(4)
    first, k = np.array([0, 5, 6, 6, 9]), 3
    e, t, s, gold = rng.normal(size=(9, k)), rng.normal(size=(k, k)), rng.normal(size=k), rng.integers(0, k, 9)

    def like(e, t, s):
        total = 0.0
        for a, b in zip(first[:-1], first[1:], strict=True):
            score = lambda p: s[p[0]] + sum(e[a + i, x] for i, x in enumerate(p)) + sum(t[x, y] for x, y in zip(p, p[1:], strict=False))  # noqa: B023, E731
            if b > a:
                total += score(gold[a:b].tolist()) - np.logaddexp.reduce([score(p) for p in itertools.product(range(k), repeat=int(b - a))])
        return total

    for n, got in enumerate(language_id.gradient(first, e, gold, t, s)):
        for at in np.ndindex(got.shape):
            moved = [x.copy() for x in (e, t, s)]
            moved[n][at] += 1e-5
            up = like(*moved)
            moved[n][at] -= 2e-5
            assert got[at] == pytest.approx((up - like(*moved)) / 2e-5, abs=1e-5)


def test_word_features_read_whole_words():
    def of(*words):
        first, f = language_id.word_features(list(words))
        return [sorted(f[i:j].tolist()) for i, j in zip(first[:-1], first[1:], strict=True)]

    a, b = of("x" * 40 + "a", "x" * 40 + "b")
    assert a != b and len(a) == 1 + 6 + 40 + 39 and of("ab", "é", "x" * 40 + "a")[2] == a
    assert language_id.tokens("Hello 世界你好吗 x") == ["hello", "世界你好", "吗", "x"]


def test_every_language_is_learned(spark, words):
    rows = [(i, f"w{i % 70}x{chr(97 + i % 26)} " * 30, f"l{i % 70:02}") for i in range(420)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 70


def test_code_switching_follows_words():
    rng = np.random.default_rng(2)
    a, b = ["der", "und", "nicht", "schön", "keit"], ["the", "and", "not", "thing", "with"]
    m = language_id.Model(["de", "en"]).fit([" ".join(rng.choice(a, 60)) for _ in range(20)] + [" ".join(rng.choice(b, 60)) for _ in range(20)], ["de"] * 20 + ["en"] * 20)
    words = ["der", "und", "nicht", "keit", "the", "and", "with", "not"]
    p = language_id.sums(np.array([0, 8]), language_id.emissions(m.w, *language_id.word_features(words)), m.trans, m.start)[0]
    assert p[:4, 0].min() > 0.8 and p[4:, 1].min() > 0.8


def test_quality_held_out(spark):
    r = scored(spark, quality.op9, "quality", "labels")
    out = r[r.held_out]
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.9


def test_quality_edges(spark, docs, empty):
    s = quality.statistics(pa.array([None, "", "a", "x " * 50_000, "Ab, cd.\nAb, cd."]))
    assert s.shape == (5, quality.N_STATS) and np.isfinite(s).all() and (s[0] == s[1]).all()
    none = quality.Trees().fit(np.zeros((0, quality.N_STATS)), np.zeros(0))
    assert {r["score"] for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(empty, none).count() == 0


def test_trees_walk_as_a_plain_version():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    m = quality.Trees().fit(x, y)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    for row in range(20):
        out = m.base
        for stat, cut, value in zip(m.stat, m.cut, m.value, strict=True):
            node = 0
            while node < 2**quality.DEPTH - 1:
                node = 2 * node + (2 if x[row, stat[node]] > cut[node] else 1)
            out += value[node]
        assert m.margin(x[row : row + 1])[0] == pytest.approx(out)


def test_toxicity_held_out(spark):
    r = scored(spark, toxicity.op6, "toxic", "labels")
    out = r[r.held_out]
    assert len(out) > 50 and (out.predicted == out.toxic).mean() > 0.93


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_edit_distance():
    rng = np.random.default_rng(5)
    terms = ["idiot", "moron", "idiots", "abc", "clown", "klown"]
    a = toxicity.Automaton(terms)
    words = terms + ["".join(rng.choice(list("idotmrnclwk"), rng.integers(1, 8))) for _ in range(2000)] + [t[:i] + c + t[j:] for t in terms for i in range(len(t) + 1) for j in (i, i + 1) for c in ("", "x", "o")]
    for w in words:
        exact, near = a.match(w)
        assert exact == (w if w in terms else None)
        assert set(near) == {t for t in terms if len(t) >= toxicity.NEAR_LETTERS and distance(w, t) == 1}, w


def test_toxicity_edges(docs, empty):
    assert {r["score"] for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    texts = [f"you are an idiot and a moron {i}" for i in range(30)] + [f"a fine day to walk {i}" for i in range(60)]
    model = toxicity.learn(texts, [1] * 30 + [0] * 60)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.score_toxicity(empty, model).count() == 0
    lex, w = model
    p = lambda t: 1 / (1 + np.exp(-(np.array(lex.features(t)) @ w[:-1] + w[-1])))
    assert p("such an idiot you are") > 0.5 > p("a fine day to walk")
    assert lex.features("such an idi0t you moron")[3] == 1  # a near hit
    assert lex.features('they said "idiot" to him')[6] > 0 and lex.features("you idiot go away")[6] == 0


def plain_base(text):
    import re

    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


def test_base_spans_against_the_plain_patterns(spark):
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(list("ab1239.@+- ()_%25,"), rng.integers(0, 60))) for _ in range(4000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("text rlike '[0-9@]'").collect()]
    texts += ["a@b.com_x@c.d x@@y.z 1.2.3.4.5.6.7.8 999.1.2.3.4 0000001.2.3.4 4111 1111-1111 1111 0 +1 (017) 555-7713"]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


def test_pii_adds_written_around_spans(spark, docs, empty):
    texts = [f"und so.{i}@mail{i % 9}.example.com mehr, ruf +1 (0{i % 90 + 10}) 555-{1000 + i} an, server 10.{i}.3.{i % 7} karte 4111 1111 1111 1111" for i in range(60)]
    w = pii.train(texts)
    for t, kind in (("card 4111.1111.1111.1111 ok", 2), ("host 10 . 0 . 0 . 12 up", 1), ("tel +1.212.555.0199 now", 3)):
        assert kind in {k for _, k, _ in pii.all_spans(t, w)[1]}
    clean = "a plain text with 3 numbers, 12 and 2024, and no person in it"
    assert pii.all_spans(clean, w) == ([], [])
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert got[0]["spans"] == got[1]["spans"] == "" and got[0]["n_email"] == 0
    assert pii.find_pii(empty).count() == 0


def test_segment_dynamic_program_against_all_segmentations():
    rng = np.random.default_rng(3)
    w = rng.normal(size=pii.BUCKETS) * 0.3
    text = "x 10.0.0.1 +1 212 555 0199 4111 1111 1111 1111"
    s = pii.Segments(text, 0, len(text))
    n = len(s.words)

    def paths(j):
        if j == 0:
            yield 0.0, []
            return
        for score, p in paths(j - 1):
            yield score, p
        for i, kind, f in s.into[j]:
            for score, p in paths(i):
                yield score + float(w[f].sum()), [*p, (s.span[i][0], kind, s.span[j - 1][1])]

    every = list(paths(n))
    assert max(x for x, _ in every) == pytest.approx(next(x for x, p in every if p == s.best(w)))
    gold = set(max(every, key=lambda x: x[0])[1])
    like = s.gradient(w, gold)[1]
    assert like == pytest.approx(max(x for x, _ in every) - np.logaddexp.reduce([x for x, _ in every]))


def test_sites_hold_whole_words_and_spelt_out_addresses():
    for whole in ("jonathan dot alexander dot montgomery at mail dot example dot org", "jo.doe [at] mail [dot] example [dot] org", "ana arroba correo punto es"):
        text = f"write to {whole} today, ok"
        assert any(text[a:b].startswith(("write", whole)) or whole in text[a:b] for a, b in pii.sites(text)), whole
    assert list(pii.sites("no such thing here")) == []

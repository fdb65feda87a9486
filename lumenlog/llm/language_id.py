"""Operator 8, language ID: a linear-chain conditional random field over the words of a text.

A word's features are itself (a lexicon of hashed forms), its prefixes and suffixes of up to three
characters and all its character bi- and trigrams; transitions between neighbouring words' languages
are learned as well. Scripts written without spaces are cut into words of up to four characters.
Forward-backward gives each word's language distribution; a text's language is the one with the
largest share of its words, the share being the score.

Training reads a bounded sample of the fold that isn't held out: at most 2 x `PER_LANGUAGE` texts of
each language (fewer where there are more than `TEXTS` / `PER_LANGUAGE` languages, so that the
sample stays bounded), of at most `sampling.LONGEST` characters each, chosen by a hash of the text.
All languages are learned. Texts are joined into code-switched sequences so that transitions have
both cases. Null texts and those without letters get `und` with score 0, as do all texts when there
is nothing to learn from. Ties go to the first language by name. Repeated rows are treated alike.
Other columns, whatever their names, are ignored or passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlog.llm.common import in_arrow, load, mix, slices
from lumenlog.llm.sampling import by_group, fold

#: Texts of a language that training is to read, and texts of all languages at which each gets fewer.
PER_LANGUAGE, TEXTS = 250, 16_000
#: Buckets of hashed features; distinct words whose weights a task remembers; bytes of text it holds at once
#: (a slice takes as many steps as its longest text has words, so small ones cost more: 610 CPU seconds a GB of text at 1 MB, 484 at 2).
BUCKETS, MEMO, SLICE = 1 << 15, 200_000, 1 << 21
_STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»„“”‚‘’…¿¡–—"


#: Thai, Lao, Myanmar, Khmer, kana and Han, which are written without spaces.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_PIECES = re.compile(f"[{_UNSPACED}]{{1,4}}|[^{_UNSPACED}\\s]+")


def tokens(text: str) -> list[str]:
    """The lower-case words of a text, and pieces of what is written without spaces."""
    text = text.lower()
    return _PIECES.findall(text) if _HAS_UNSPACED.search(text) else text.split()


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature indices of lower-case words as flat arrays: those of word i are feature[first[i]:first[i + 1]]."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(size)
    begin = end - size
    owner = np.repeat(np.arange(len(words)), size)
    owners, found = [], []

    def add(kind: int, who: np.ndarray, *codes: np.ndarray) -> None:
        h = np.full(len(who), kind, np.uint64)
        for c in codes:
            h = mix(h * np.uint64(0x100000001B3) ^ c)
        owners.append(who)
        found.append((h % np.uint64(BUCKETS)).astype(np.int64))

    place = (np.arange(len(code)) - begin[owner]).astype(np.uint64)
    whole = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(mix(mix(code, 41) ^ place, 42), out=whole[1:])
    add(1, np.arange(len(words)), whole[end] - whole[begin])
    for k in (1, 2, 3):
        i = np.flatnonzero(size >= k)
        add(10 + k, i, *(code[begin[i] + x] for x in range(k)))
        add(20 + k, i, *(code[end[i] - 1 - x] for x in range(k)))
    for kind, k in ((30, 2), (40, 3)):
        at = np.flatnonzero(owner[: len(code) - k + 1] == owner[k - 1 :]) if len(code) >= k else np.zeros(0, np.int64)
        add(kind, owner[at], *(code[at + x] for x in range(k)))
    who, feature = np.concatenate(owners), np.concatenate(found)
    order = np.argsort(who, kind="stable")
    return np.append(0, np.cumsum(np.bincount(who, minlength=len(words)))), feature[order]


def emissions(w: np.ndarray, first: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """The summed weights of each word's features; every word has some."""
    return np.add.reduceat(w[feature], first[:-1], axis=0) if len(feature) else np.zeros((0, w.shape[1]), w.dtype)


def _bare(token: str) -> str:
    """The letters of a token, lower-case, or an empty string."""
    w = token.strip(_STRIP)
    return w if any(map(str.isalpha, w)) else ""


def sums(first: np.ndarray, emission: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word (rows of emission, in log space), and the expected count of each pair of neighbours' languages.

    Forward-backward over all sequences first[i]:first[i + 1] at once.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    active = np.searchsorted(-length[order], -np.arange(1, (length.max() if len(length) else 0) + 1), "right")
    e = emission - emission.max(axis=1, keepdims=True)
    np.exp(e, out=e)
    del emission  # a caller that keeps no name for it gives it up here
    t = np.exp(trans - trans.max())
    alpha = np.empty_like(e)
    head = first[:-1][order]
    a = None
    for step, n in enumerate(active):
        at = head[:n] + step
        a = e[at] * (np.exp(start) if a is None else a[:n] @ t)
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.ones((len(order), e.shape[1]), e.dtype)
    pairs = np.zeros_like(t)
    for step in range(len(active) - 1, 0, -1):
        n = active[step]
        at = head[:n] + step
        after = e[at] * b[:n]
        x = after @ t.T
        before = alpha[at - 1]
        pairs += t * ((before / (before * x).sum(axis=1, keepdims=True)).T @ after)
        alpha[at] *= b[:n]
        b[:n] = x / x.sum(axis=1, keepdims=True)
    if len(active):
        at = head[: active[0]]
        alpha[at] *= b[: active[0]]
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha, pairs


def gradient(first: np.ndarray, emission: np.ndarray, gold: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log likelihood of gold, by emissions, transitions and starts: what is observed less what is expected."""
    p, pairs = sums(first, emission, trans, start)
    d, heads = -p, first[:-1][np.diff(first) > 0]
    d_start = d[heads].sum(axis=0)
    np.add.at(d_start, gold[heads], 1)
    d[np.arange(len(gold)), gold] += 1
    inner = np.ones(len(gold), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    i = np.flatnonzero(inner)
    d_trans = -pairs
    np.add.at(d_trans, (gold[i], gold[i + 1]), 1)
    return d, d_trans, d_start


class Model:
    """Weights of the field: emissions by feature, transitions, start."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        k = len(languages)
        self.w, self.trans, self.start = np.zeros((BUCKETS, k), np.float32), np.zeros((k, k), np.float32), np.zeros(k, np.float32)

    def fit(self, texts: list[str], langs: list[str], rounds: int = 5, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        index: dict[str, int] = {}
        docs = []
        for text, lang in zip(texts, langs, strict=True):
            words = [b for x in tokens(text) if (b := _bare(x))]
            if words:
                docs.append((np.array([index.setdefault(w, len(index)) for w in words]), self.languages.index(lang)))
        if not docs:
            return self
        at_word, feats = word_features(list(index))
        seqs = []
        for _ in range(4 * len(docs)):  # stretches of up to three texts in a row
            parts = [docs[i] for i in rng.integers(0, len(docs), rng.integers(1, 4))]
            cut = []
            for w, lang in parts:
                at, n = rng.integers(0, len(w)), rng.integers(3, 25)
                cut.append((w[at : at + n], np.full(len(w[at : at + n]), lang)))
            seqs.append((np.concatenate([c[0] for c in cut]), np.concatenate([c[1] for c in cut])))
        gw, gt, gs = (np.full_like(x, 1e-6) for x in (self.w, self.trans, self.start))
        k = len(self.languages)
        for _ in range(rounds):
            rng.shuffle(seqs)
            for lo in range(0, len(seqs), 64):
                part = seqs[lo : lo + 64]
                first = np.cumsum([0, *(len(s[0]) for s in part)])
                words, gold = np.concatenate([s[0] for s in part]), np.concatenate([s[1] for s in part])
                used, word = np.unique(words, return_inverse=True)
                n = at_word[used + 1] - at_word[used]
                begin = np.append(0, np.cumsum(n))
                f = feats[np.repeat(at_word[used] - begin[:-1], n) + np.arange(begin[-1])]
                d, d_trans, d_start = gradient(first, emissions(self.w, begin, f)[word], gold, self.trans, self.start)
                g = np.zeros_like(self.w)
                for c in range(k):
                    g[:, c] = np.bincount(f, np.repeat(np.bincount(word, d[:, c], len(used)), n), BUCKETS)
                for w, grad, square in ((self.w, g, gw), (self.trans, d_trans, gt), (self.start, d_start, gs)):
                    square += grad * grad
                    w += 0.1 * grad / np.sqrt(square)
        return self


def _predict(model: Model, of):
    """The columns of a batch with lang_pred and score after them; of(batch) is its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)), np.float32)
        for b in batches:
            b = b.append_column("\0text", of(b))
            for x in slices(b, "\0text", SLICE):
                if len(memo) > MEMO:
                    memo, table = {}, table[:0]
                index, bare = [], []
                for t in x.column("\0text"):  # a text's words go as soon as they are numbered
                    words = tokens(t.as_py() or "")
                    for w in set(words).difference(memo):
                        if y := _bare(w):
                            bare.append(y)
                        memo[w] = len(table) + len(bare) - 1 if y else -1
                    i = np.fromiter(map(memo.__getitem__, words), np.int32, len(words))
                    index.append(i[i >= 0])
                if bare:
                    rows = np.zeros((len(bare), table.shape[1]), np.float32)
                    for lo in range(0, len(bare), 4096):
                        rows[lo : lo + 4096] = emissions(model.w, *word_features(bare[lo : lo + 4096]))
                    table = np.concatenate([table, rows])
                first = np.cumsum([0, *map(len, index)])
                index = np.concatenate(index)
                p = sums(first, table[index], model.trans, model.start)[0] if first[-1] else np.zeros((0, table.shape[1]), table.dtype)
                total = np.empty((len(first) - 1, table.shape[1]))
                c = np.zeros(len(p) + 1)
                for k in range(table.shape[1]):
                    np.cumsum(p[:, k], dtype=float, out=c[1:])
                    total[:, k] = c[first[1:]] - c[first[:-1]]
                n = np.diff(first)
                best = total.argmax(axis=1)
                lang = [model.languages[k] if m else "und" for k, m in zip(best.tolist(), n.tolist(), strict=True)]
                score = np.where(n > 0, total[np.arange(len(n)), best] / np.maximum(n, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(lang), pa.array(np.clip(score, 0, 1))], [*x.schema.names[:-1], "lang_pred", "score"])

    return run


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages in docs (doc_id, text, lang), outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(4) != 2)).select("lang", "text")
    texts = sorted((r["lang"], r["text"]) for r in by_group(rows, "lang", per_language, TEXTS).collect())
    return Model(sorted({lang for lang, _ in texts})).fit([t for _, t in texts], [lang for lang, _ in texts])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    if not model.languages:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return in_arrow(docs, _predict(model, lambda b: b.column("text")), "doc_id long, text string, lang_pred string, score double").drop("text")


def identify_rows(docs: DataFrame, model: Model) -> DataFrame:
    """doc (each row of docs, whole, as a struct), lang_pred and score: no join is needed to keep or drop rows."""
    rows = docs.select(F.struct("*").alias("doc"))
    if not model.languages:
        return rows.select("doc", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    out = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return in_arrow(rows, _predict(model, lambda b: b.column("doc").field("text")), out)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return identify(docs, train(docs)).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")

"""Operator 9, quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted in numpy over a batch's bytes and words. Trees are grown level by level on
histograms of binned statistics and kept as flat arrays (statistic, threshold, value) of complete
trees, node i with children 2 i + 1 and 2 i + 2, which all rows of a batch walk together.

Training takes at most 2 x `SAMPLE` labelled texts outside the held-out fold, chosen by hashes, and
moves only their statistics to the driver. Null and empty texts have zero statistics and get a
score like any other. Without labels every score is 0.5. Repeated rows are scored alike; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import Words, filled, in_arrow, load, slices
from lumenlog.llm.sampling import fold, labelled

SAMPLE, TREES, DEPTH, BINS, RATE = 8000, 60, 4, 64, 0.15
_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence mark, 7 other mark, 8 high byte
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[33:48], _KIND[58:65], _KIND[91:97], _KIND[123:127], _KIND[128:] = 1, 2, 3, 7, 7, 7, 7, 8
_KIND[[32, 9, 11, 12, 13]], _KIND[10], _KIND[[46, 44, 59, 58]] = 4, 5, 6
_MARKS = [ord(c) for c in "|#$%&*!?{}<>=_@/\\"]
N_STATS = 9 + len(_MARKS) + 9


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of document statistics for each text."""
    w = Words(filled(texts))
    n = len(texts)
    size = np.diff(w.text_at)
    owner = np.repeat(np.arange(n), size)
    raw = w.raw
    kinds = np.bincount(owner * 9 + _KIND[raw], minlength=9 * n).reshape(n, 9)
    out = np.zeros((n, N_STATS), np.float32)
    div = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    out[:, 1:9] = kinds[:, 1:] / div[:, None]
    for k, c in enumerate(_MARKS):
        out[:, 9 + k] = np.bincount(owner[raw == c], minlength=n) / div
    count = np.diff(w.first)
    words = np.maximum(count, 1)
    wo = np.repeat(np.arange(n), count)
    length = (w.end - w.start).astype(np.float64)
    at = 9 + len(_MARKS)
    out[:, at] = np.log1p(count)
    out[:, at + 1] = np.bincount(wo, length, n) / words
    out[:, at + 2] = np.sqrt(np.maximum(np.bincount(wo, length**2, n) / words - out[:, at + 1] ** 2, 0))
    out[:, at + 3] = np.bincount(wo, length > 12, n) / words
    order = np.lexsort((w.hash, wo))
    h, o = w.hash[order], wo[order]
    new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.zeros(0, bool)
    out[:, at + 4] = np.bincount(o[new], minlength=n) / words
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[new], runs)
    out[:, at + 5] = top / words
    same = w.hash[1:] == w.hash[:-1] if len(w.hash) else np.zeros(0, bool)
    same &= wo[1:] == wo[:-1] if len(wo) else same
    out[:, at + 6] = np.bincount(wo[1:][same], minlength=n) / words
    g = w.grams(3)
    ok = wo[: len(g)] == wo[2 : len(g) + 2]
    gh, go = g[ok], wo[: len(g)][ok]
    order = np.lexsort((gh, go))
    gh, go = gh[order], go[order]
    new = np.append(True, (gh[1:] != gh[:-1]) | (go[1:] != go[:-1])) if len(gh) else np.zeros(0, bool)
    grams = np.bincount(go, minlength=n)
    out[:, at + 7] = np.where(grams > 0, np.bincount(go[new], minlength=n) / np.maximum(grams, 1), 1)
    head = raw[w.start] if len(w.start) else np.zeros(0, np.uint8)
    out[:, at + 8] = np.bincount(wo, (head >= 65) & (head <= 90), n) / words
    return out


class Trees:
    """Boosted trees as flat arrays; a leaf is its own child."""

    def __init__(self) -> None:
        self.base = 0.0
        self.stat = np.zeros((0, 2 ** (DEPTH + 1) - 1), np.int64)
        self.cut = np.zeros((0, 2 ** (DEPTH + 1) - 1), np.float32)
        self.value = np.zeros((0, 2 ** (DEPTH + 1) - 1), np.float32)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for stat, cut, value in zip(self.stat, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):  # complete trees: a node that wasn't split sends all rows left
                node = 2 * node + 1 + (x[rows, stat[node]] > cut[node])
            out += value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        if not len(y) or y.min() == y.max():
            self.base = 0.0 if not len(y) else float(np.log((y.mean() * len(y) + 1) / ((1 - y.mean()) * len(y) + 1)))
            return self
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)).astype(np.float32) for j in range(x.shape[1])]
        bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        f = np.full(len(y), self.base)
        stats, limits, values = [], [], []
        cols = np.arange(x.shape[1])
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            stat, cut, value = np.zeros(2 ** (DEPTH + 1) - 1, np.int64), np.full(2 ** (DEPTH + 1) - 1, np.inf, np.float32), np.zeros(2 ** (DEPTH + 1) - 1, np.float32)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, n = 2**level - 1, 2**level
                key = ((node - first)[:, None] * len(cols) + cols) * BINS + bins
                hg = np.bincount(key.ravel(), np.repeat(g, len(cols)), n * len(cols) * BINS).reshape(n, len(cols), BINS)
                hh = np.bincount(key.ravel(), np.repeat(h, len(cols)), n * len(cols) * BINS).reshape(n, len(cols), BINS)
                lg, lh = hg.cumsum(axis=2), hh.cumsum(axis=2)
                tg, th = lg[:, :, -1:], lh[:, :, -1:]
                gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
                gain[(lh < 2) | (th - lh < 2)] = 0
                best = gain.reshape(n, -1).argmax(axis=1)
                for i in range(n):
                    j, b = divmod(int(best[i]), BINS)
                    if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                        stat[first + i], cut[first + i] = j, cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(len(y)), stat[node]] > cut[node])
            leaf = 2**DEPTH - 1
            k = node - leaf
            value[leaf:] = RATE * np.bincount(k, g, 2**DEPTH) / (np.bincount(k, h, 2**DEPTH) + 1)
            f += value[node]
            stats.append(stat)
            limits.append(cut)
            values.append(value)
        self.stat, self.cut, self.value = np.stack(stats), np.stack(limits), np.stack(values)
        return self


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in slices(b, "text"):
            yield pa.RecordBatch.from_arrays([x.column("y"), pa.array(list(statistics(x.column("text"))), pa.list_(pa.float32()))], ["y", "stats"])


def _score(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(model.score(statistics(x.column("text"))))], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    rows = in_arrow(labelled(docs, labels, "quality", 3, 1, sample), _measure, "y int, stats array<float>").collect()  # at most 2 x sample
    rows.sort(key=lambda r: (r["y"], r["stats"]))
    x = np.array([r["stats"] for r in rows], np.float32).reshape(len(rows), N_STATS)
    return Trees().fit(x, np.array([r["y"] for r in rows], np.float64))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) for each row of docs (doc_id, text)."""
    return in_arrow(docs.select("doc_id", "text"), _score(model), "doc_id long, score double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

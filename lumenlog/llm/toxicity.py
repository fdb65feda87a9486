"""Operator 6, toxicity: Levenshtein automata intersected with a lexicon trie, scored in context.

The lexicon is learned: words whose presence goes with label 1, by smoothed log odds over training
texts. Its trie is walked together with the Levenshtein automaton of distance one, state sets being
determinised as words need them, so that misspelled terms of five letters and more are caught.
Near matches have log odds of their own. A hit's window of five words separates quotation (quote
marks, reporting words) from plain use; a logistic model weighs plain, near and quoted hits.

Training takes at most 2 x `SAMPLE` labelled texts outside the held-out fold, of at most
`sampling.LONGEST` characters each, chosen by hashes; every text is scored, whole.
Null and empty texts have no hits and get the score of such texts. Without labels every score is 0.
Repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import in_arrow, load, slices
from lumenlog.llm.sampling import LONGEST, fold, labelled

SAMPLE, TERMS, LEAST_ODDS, NEAR_LETTERS, WINDOW, MEMO = 4000, 400, 2.0, 5, 5, 400_000
THRESHOLD = 0.3
_STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»„“”‚‘’…¿¡–—"
_QUOTES = frozenset("\"'«»„“”‘’")
#: Reporting words of the four languages (fixed values).
_REPORTS = frozenset("said says saying quote quoted wrote called word words term slur reported sagte sagt schrieb zitat wort dit disait écrit citation mot dijo dice escribió cita palabra".split())


class Automaton:
    """The lexicon's trie with the Levenshtein automaton of distance one, determinised as it is used."""

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(terms):
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                node = self.child[node][c]
            self.term[node] = t
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[str | None, tuple[str, ...]]] = []
        self.start = self._id({(0, 0)})

    def _id(self, raw: set[tuple[int, int]]) -> int:
        full = raw | {(y, 1) for x, e in raw if e == 0 for y in self.child[x].values()}  # a letter of the term left out
        full = frozenset(s for s in full if s[1] == 0 or (s[0], 0) not in full)
        if full not in self.ids:
            self.ids[full] = len(self.states)
            self.states.append(full)
            self.next.append({})
            exact = [self.term[x] for x, e in full if e == 0 and self.term[x]]
            near = sorted(t for x, e in full if e == 1 and (t := self.term[x]) and len(t) >= NEAR_LETTERS)
            self.accepts.append((exact[0] if exact else None, tuple(near)))
        return self.ids[full]

    def _step(self, state: int, c: str) -> int:
        raw = set()
        for x, e in self.states[state]:
            if c in self.child[x]:
                raw.add((self.child[x][c], e))
            if e == 0:
                raw.add((x, 1))  # a letter too many
                raw.update((y, 1) for y in self.child[x].values())  # another letter
        to = self._id(raw) if raw else -1
        self.next[state][c] = to
        return to

    def match(self, word: str) -> tuple[str | None, tuple[str, ...]]:
        """The term that word is, and the terms at distance one."""
        at = self.start
        for c in word:
            to = self.next[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return None, ()
            at = to
        return self.accepts[at]


N_FEATURES = 9


class Lexicon:
    def __init__(self, exact: dict[str, float]):
        self.exact, self.near = exact, {}
        self.automaton = Automaton(list(exact))
        self.memo: dict[str, tuple[float, bool] | None] = {}

    def __getstate__(self):
        return self.exact, self.near

    def __setstate__(self, state):
        self.__init__(state[0])
        self.near = state[1]

    def hit(self, token: str) -> tuple[float, bool] | None:
        """(log odds, exact) of a lower-case token, or None."""
        try:
            return self.memo[token]
        except KeyError:
            pass
        word = token.strip(_STRIP)
        t, near = self.automaton.match(word) if word else (None, ())
        odds = max((self.near.get(x, 0.0) for x in near), default=0.0)
        got = (self.exact[t], True) if t else (odds, False) if odds > 0 else None
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[token] = got
        return got

    def features(self, text: str) -> list[float]:
        tokens = text.lower().split()
        hits = {w: h for w in set(tokens) if (h := self.hit(w))}
        if not hits:
            return [0.0] * (N_FEATURES - 1) + [float(np.log1p(len(tokens)))]
        plain = quoted = 0.0
        n = 0
        for i, w in enumerate(tokens):
            if w in hits:
                n += 1
                window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                told = any(x.strip(_STRIP) in _REPORTS for x in window) or (sum(x[0] in _QUOTES for x in window) and sum(x.rstrip(".,;:!?")[-1:] in _QUOTES for x in window))
                if told:
                    quoted += 1
                else:
                    plain += 1
        exact = [o for o, e in hits.values() if e]
        near = [o for o, e in hits.values() if not e]
        return [float(len(exact)), sum(exact), max(exact, default=0.0), float(len(near)), sum(near), float(np.log1p(plain)), float(np.log1p(quoted)), 100.0 * n / len(tokens), float(np.log1p(len(tokens)))]


def learn(texts: list[str], y: list[int]) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the logistic weights (last: intercept) from labelled texts."""
    sets = [{w for x in set(t.lower().split()) if len(w := x.strip(_STRIP)) > 2 and any(map(str.isalpha, w))} for t in texts]
    n = (max(1, sum(1 for v in y if not v)), max(1, sum(y)))
    seen = (Counter(), Counter())
    for s, v in zip(sets, y, strict=True):
        seen[v].update(s)

    def odds(pos: int, neg: int) -> float:
        return float(np.log((pos + 0.5) / (n[1] + 1)) - np.log((neg + 0.5) / (n[0] + 1)))

    least = 4
    found = {w: o for w, c in seen[1].items() if c >= least and (o := odds(c, seen[0][w])) >= LEAST_ODDS}
    lex = Lexicon(dict(sorted(found.items(), key=lambda x: (-x[1] * np.sqrt(seen[1][x[0]]), x[0]))[:TERMS]))
    near = (Counter(), Counter())
    for s, v in zip(sets, y, strict=True):
        near[v].update({t for term, close in map(lex.automaton.match, s) if not term for t in close})
    lex.near = {t: o for t in lex.exact if (o := max(0.0, odds(near[1][t], near[0][t]) if near[1][t] + near[0][t] else lex.exact[t] / 2)) > 1.0}
    lex.memo.clear()
    x = np.array([[*lex.features(t), 1.0] for t in texts]).reshape(len(texts), N_FEATURES + 1)
    target = np.array(y, float)
    w = np.zeros(N_FEATURES + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (target - p) - 0.1 * w)
    return lex, w


def _score(lex: Lexicon, w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b, "text"):
                x = np.array([lex.features(t or "") for t in s.column("text").to_pylist()]).reshape(s.num_rows, N_FEATURES)
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(p), pa.array(x[:, 0].astype(np.int64)), pa.array(x[:, 3].astype(np.int64))], ["doc_id", "score", "n_terms", "n_near"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Lexicon, np.ndarray] | None:
    short = docs.where(F.length("text") <= LONGEST)  # bounds what training moves to the driver
    rows = sorted((r["text"], r["y"]) for r in labelled(short, labels, "toxic", 4, 2, sample).collect())
    return learn([t for t, _ in rows], [v for _, v in rows]) if rows else None


def score_toxicity(docs: DataFrame, model: tuple[Lexicon, np.ndarray] | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier toxic), and counts of terms and near terms for each row of docs (doc_id, text)."""
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms"), F.lit(0).cast("long").alias("n_near"))
    return in_arrow(docs.select("doc_id", "text"), _score(*model), "doc_id long, score double, n_terms long, n_near long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

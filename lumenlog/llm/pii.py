"""Operator 2, personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns give the base spans (leftmost, non-overlapping for each kind; failing ones are dropped).
The field then scores segments of up to `LONGEST` tokens around digits, @ and spelt-out addresses.
Features look at a whole candidate span (its shape with digit runs and separators, digit count,
checksum, context word), and a bounded dynamic program over segment ends chooses boundaries and
kinds together. Spans that touch no base span are added, so that written-around forms such as
"jo at mail dot org" or a card with dots are found too.

Weights are learned from at most 2 x `SAMPLE` texts with three digits in a row and at most
`sampling.LONGEST` characters, chosen by a hash: their base spans are positive segments, once as they
are and once written around, and all other tokens are outside. No outside labels are used. The
sample is all that is bounded so; every text is searched, whole.

A segment ends after `LONGEST` tokens, which is more than the longest form that `candidates` takes:
an address of nine dotted parts, with a bracketed connector counting as one token.

Null and empty texts have no spans. Repeated rows are treated alike. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import in_arrow, load, slices
from lumenlog.llm.sampling import LONGEST as LONGEST_TEXT
from lumenlog.llm.sampling import by_text_hash

KINDS = ("email", "ip", "card", "phone")
#: Texts that training may read, tokens of a segment, buckets of hashed features.
SAMPLE, LONGEST, BUCKETS = 400, 20, 1 << 12

# The contract's patterns. A digit run can't begin a match in its middle that it didn't begin at its start, so that one look behind keeps them linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) by start, then kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- sites: the stretches of text that the field reads ------------------------

_TOKEN = re.compile(r"(?i:[\[(](?:at|arroba|dot|punto)[\])])|[^\W\d_]+|[0-9]+|[^\s]")
_SEED = re.compile(r"[0-9@]|(?i:(?<= )[\[(]?(?:at|arroba)[\])]? [a-z0-9-]+ [\[(]?(?:dot|punto)[\])]? )")
#: What may go on around a seed: runs of letters, digits and marks, and spelt-out connectors with a space on each side.
_ON = re.compile(r"(?i:\S*(?: [\[(]?(?:at|arroba|dot|punto)[\])]? \S+)*)")
_BACK = re.compile(r"(?i:(?:\S+ [\])]?(?:ta|aborra|tod|otnup)[\[(]? )*\S*)")


def sites(text: str, around: int = 24, most: int = 512) -> Iterator[tuple[int, int]]:
    """Stretches around digits, @ and "at ... dot", merged where they meet.

    A stretch holds `around` characters on each side, and goes on, to `most` of them, while a word or a
    spelt-out address does.
    """
    lo = hi = -1
    for m in _SEED.finditer(text):
        if m.end() + around <= hi:
            continue
        a, b = max(0, m.start() - around), min(len(text), m.end() + around)
        if a > hi:
            a -= _BACK.match(text[max(0, a - most) : a + 1][::-1]).end() - 1 if a and not text[a].isspace() else 0
        b += _ON.match(text[b - 1 : b + most]).end() - 1 if not text[b - 1].isspace() else 0
        if a <= hi:
            hi = max(hi, b)
        else:
            if hi > 0:
                yield lo, hi
            lo, hi = max(0, a), b
    if hi > 0:
        yield lo, hi


def _bare(word: str) -> str:
    """A token in lower case; a bracketed connector without its brackets."""
    return word.strip("[]()").lower() if len(word) > 1 else word.lower()


def _shape(words: list[str]) -> str:
    out = []
    for w in words:
        if w.isdigit():
            out.append("9" if len(w) == 1 else f"9{min(len(w), 9)}")
        elif w.isalpha() or len(w) > 1:
            low = _bare(w)
            out.append(low if low in ("at", "dot", "arroba", "punto", "point", "punkt") else "a")
        else:
            out.append(w)
    return " ".join(k if n == 1 else f"{k}*" for k, n in ((k, len(list(g))) for k, g in groupby(out)))


def candidates(words: list[str], i: int, j: int) -> list[int]:
    """Kinds that words[i:j] could be at all."""
    first, last = words[i], words[j - 1]
    digits = "".join(w for w in words[i:j] if w.isdigit())
    kinds = []
    if first[0].isalnum() and last[0].isalnum():
        low = [_bare(w) for w in words[i:j]]
        if ("@" in low or "at" in low or "arroba" in low) and ("." in low or "dot" in low or "punto" in low) and 5 <= j - i:
            kinds.append(0)
        parts = [w for w in words[i:j] if w.isdigit()]
        if len(parts) == 4 and j - i >= 7 and not any((w.isalpha() or len(w) > 1 and not w.isdigit()) and _bare(w) != "dot" for w in words[i:j]) and all(len(p) <= 3 and int(p) <= 255 for p in parts):
            kinds.append(1)
        if first.isdigit() and last.isdigit() and 14 <= len(digits) <= 19 and not any(w.isalpha() or len(w) > 1 and not w.isdigit() for w in words[i:j]) and luhn(digits):
            kinds.append(2)
    groups = [len(w) for w in words[i:j] if w.isdigit()]
    if (first in "+(" or groups[-3:] == [3, 3, 4] and len(groups) <= 4) and last.isdigit() and 10 <= len(digits) <= 15 and j - i >= 3 and not any(w.isalpha() or w not in "+().-/" and not w.isdigit() for w in words[i:j]):
        kinds.append(3)
    return kinds


@functools.lru_cache(100_000)
def _bucket(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=4).digest(), "little") % BUCKETS


def features(words: list[str], i: int, j: int, kind: int) -> list[int]:
    """Hashed features of the whole span words[i:j] as kind."""
    k = KINDS[kind]
    digits = sum(len(w) for w in words[i:j] if w.isdigit())
    around = (words[i - 1].lower() if i else "^")[:6], (words[j].lower() if j < len(words) else "$")[:6]
    marks = "".join(sorted({w for w in words[i:j] if not w.isalnum()}))
    edge = ("9" if i and words[i - 1].isdigit() else "+" if i and words[i - 1] in "+.@-" else "") + "|" + ("9" if j < len(words) and words[j].isdigit() else "@" if j < len(words) and words[j] in ".@-" and j + 1 < len(words) and words[j + 1].isalnum() else "")
    return [_bucket(f"{k} {x}") for x in ("bias", f"shape {_shape(words[i:j])}", f"digits {digits}", f"marks {marks}", f"size {j - i}", f"edge {edge}", f"before {around[0]}", f"plus {words[i] == '+'}")]


class Segments:
    """A site's tokens with its candidate segments, and the field's sums over all segmentations."""

    def __init__(self, text: str, lo: int, hi: int):
        found = [m for m in _TOKEN.finditer(text, lo, hi)]
        self.words = [m[0] for m in found]
        self.span = [(m.start(), m.end()) for m in found]
        self.into: list[list[tuple[int, int, list[int]]]] = [[] for _ in range(len(found) + 1)]
        n = len(found)
        for i in range(n):
            if not (self.words[i].isalnum() or self.words[i] in "+("):
                continue
            for j in range(i + 3, min(n, i + LONGEST) + 1):
                for kind in candidates(self.words, i, j):
                    self.into[j].append((i, kind, features(self.words, i, j, kind)))

    def best(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation's spans (start, kind, end); a token outside scores 0."""
        n = len(self.words)
        score, back = [0.0] * (n + 1), [(-1, -1)] * (n + 1)
        for j in range(1, n + 1):
            score[j], back[j] = score[j - 1], (j - 1, -1)
            for i, kind, f in self.into[j]:
                if (s := score[i] + float(w[f].sum())) > score[j]:
                    score[j], back[j] = s, (i, kind)
        out, j = [], n
        while j > 0:
            i, kind = back[j]
            if kind >= 0:
                out.append((self.span[i][0], kind, self.span[j - 1][1]))
            j = i
        return out[::-1]

    def gradient(self, w: np.ndarray, gold: set[tuple[int, int, int]]) -> tuple[np.ndarray, float]:
        """Observed minus expected features, and the log likelihood, by forward and backward sums."""
        n = len(self.words)
        s = [[float(w[f].sum()) for _, _, f in x] for x in self.into]
        a = np.zeros(n + 1)
        for j in range(1, n + 1):
            a[j] = np.logaddexp.reduce([a[j - 1], *(a[i] + x for (i, _, _), x in zip(self.into[j], s[j], strict=True))])
        b = np.full(n + 1, -np.inf)
        b[n] = 0
        for j in range(n, 0, -1):
            b[j - 1] = np.logaddexp(b[j - 1], b[j])
            for (i, _, _), x in zip(self.into[j], s[j], strict=True):
                b[i] = np.logaddexp(b[i], b[j] + x)
        g, like = np.zeros(BUCKETS), -a[n]
        for j in range(1, n + 1):
            for (i, kind, f), x in zip(self.into[j], s[j], strict=True):
                true = (self.span[i][0], kind, self.span[j - 1][1]) in gold
                like += x * true
                np.add.at(g, f, true - float(np.exp(a[i] + x + b[j] - a[n])))
        return g, like


_AROUND = {0: ((("@", " at "), (".", " dot ")), (("@", " [at] "), (".", " [dot] "))), 1: (((".", " . "),), ((".", "[.]"),)), 2: (), 3: (((" ", "."), ("(", ""), (")", "")), (("+", ""),))}


def _written_around(text: str, spans: list[tuple[int, int, int]], turn: int) -> tuple[str, list[tuple[int, int, int]]]:
    out, new, at = [], [], 0
    size = 0
    for start, kind, end in spans:
        if start < at:
            continue
        x = text[start:end]
        if kind == 2:
            x = (" ", ".", "-")[turn % 3].join(x[k : k + 4] for k in range(0, len(x), 4)) if x.isdigit() else x
        elif _AROUND[kind]:
            if kind == 0 and turn % 3:
                x = re.sub("[0-9]+", "doe", x)
            if kind == 0 and turn % 5 > 2:
                x = x.rsplit(".", 2)[0] + "." + x.rsplit(".", 1)[1]
            for a, b in _AROUND[kind][turn % len(_AROUND[kind])]:
                x = x.replace(a, b)
        out += [text[at:start], x]
        size += start - at
        new.append((size, kind, size + len(x)))
        size += len(x)
        at = end
    return "".join([*out, text[at:]]), new


def train(texts: list[str], rounds: int = 12) -> np.ndarray:
    """Weights of the field from the base spans of texts."""
    data = []
    for turn, text in enumerate(texts):
        spans = base_spans(text)
        for t, gold in ((text, spans), _written_around(text, spans, turn)):
            for lo, hi in sites(t):
                seg = Segments(t, lo, hi)
                if any(seg.into):
                    data.append((seg, set(gold)))
    w, square = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    for _ in range(rounds):
        for seg, gold in data:
            g = seg.gradient(w, gold)[0] - 1e-4 * w
            square += g * g
            w += 0.5 * g / np.sqrt(square)
    return w.astype(np.float32)


def all_spans(text: str, w: np.ndarray) -> tuple[list, list]:
    base = base_spans(text)
    found = list(base)
    for lo, hi in sites(text):
        for x in Segments(text, lo, hi).best(w):
            if all(x[2] <= b[0] or x[0] >= b[2] for b in base):
                found.append(x)
    return base, sorted(set(found))


def _find(w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, "text")):
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, every = all_spans(text, w) if text else ([], [])
                count = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                out.append((doc, *count, *(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x) for x in (base, every))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64() if c < 5 else pa.string()) for c in range(7)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    return run


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, counts of base spans by kind, base and all spans as kind:start:end lists for each row of docs."""
    rows = docs.where(F.col("text").rlike("[0-9]{3}") & (F.length("text") <= LONGEST_TEXT)).select("text")
    weights = train(sorted(r["text"] for r in by_text_hash(rows, sample, rows.count()).collect()))  # at most 2 x sample
    return in_arrow(docs.select("doc_id", "text"), _find(weights), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(load(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")

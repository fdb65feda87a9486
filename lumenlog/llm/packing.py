"""Operator 5, best-two-fit packing of token sequences.

1. Tokenise: documents become pieces of at most `size` ids in one Arrow pass; a piece's row holds
   its place, length and checksum. Words are looked up in a bounded memo of the tokenizer's answers.
2. Plan over the histogram of lengths, which has at most `size` entries whatever the input: fill a
   bin greedily, largest first; then, while a gap is left, take the bin's smallest document out if
   two unpacked ones fit the widened gap more tightly. A bin is repeated as often as its lengths last.
3. Deal: a piece's rank among those of its length (count before its task, plus place in its task)
   names its bin and offset. Nothing but the histogram and the plan pass through the driver.

Null text is empty and yields one piece with the closing id 0. Empty input gives no rows. Repeated
rows are packed as separate documents. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import in_arrow, load, slices, stage

SIZE = 2048
#: Distinct strings between white space whose ids a Python worker remembers; a full memo keeps its first half.
MEMO = 250_000

#: Texts with any of these go through the tokenizer whole: other scripts, controls, other numerals, special tokens.
_ODD = re.compile("[^\t\n\r\x20-\x7e\xa0-ɏ]|[²³¹¼-¾İ]|<\\|")
#: Those of them that split() or lower() takes out of sight (fixed values).
_HIDDEN = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000İ\u1e9e\u212a\u212b"
#: The tokenizer's own split, for the remaining characters (fixed value).
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+|\n")


@functools.cache
def _tokenizer(path: str):
    """The tokenizer; a function that encodes distinct words at once; memos of words and of strings between white space."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    level = ByteLevel(add_prefix_space=False, use_regex=False)
    letter = {b: level.pre_tokenize_str(chr(b))[0][0][-1] if b < 128 else level.pre_tokenize_str(bytes([0xC3, b]).decode())[0][0][1] if b < 192 else None for b in range(33, 192)}
    letter |= {b: level.pre_tokenize_str(bytes([b, 0x80]).decode())[0][0][0] for b in range(0xC3, 0xCA)} | {0xC2: level.pre_tokenize_str("\xa1")[0][0][0]}
    tok = Tokenizer.from_file(path)
    bare = json.loads(tok.to_str()) | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}
    plain = Tokenizer.from_str(json.dumps(bare))
    last = np.zeros(tok.get_vocab_size(), bool)
    last[[i for w, i in tok.get_vocab().items() if w.endswith("</w>")]] = True

    def encode(words: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(words), 2048):
            part = words[at : at + 2048]
            ids = np.array(plain.encode(" ".join(part).encode().decode("latin-1").translate(letter), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(last[ids]) + 1  # a word's last token is marked as such
            if len(ends) != len(part):  # a word came apart in this form: these go through the tokenizer as they are
                yield from ((w, np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in part)
                continue
            raw = ids.tobytes()
            yield from zip(part, [raw[4 * i : 4 * j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], strict=True)

    return tok, encode, {}, {}


def _halve(memo: dict[str, bytes]) -> None:
    for w in list(memo)[len(memo) // 2 :]:
        del memo[w]


def ids_of(texts: list[str], path: str) -> Iterator[bytes]:
    """The tokenizer's ids of each text, without special tokens, as little-endian 32-bit numbers."""
    tok, encode, words, memo = _tokenizer(path)
    parts: list[list[str] | None] = [None if any(c in t for c in _HIDDEN) else t.lower().split() for t in texts]
    used = set().union(*(p for p in parts if p))
    if len(memo) + len(used) > MEMO:  # the words met first are the frequent ones
        _halve(memo)
    if len(words) > MEMO:
        _halve(words)
    new = used.difference(memo)
    if _ODD.search("\n".join(new)):
        odd = {w for w in new if _ODD.search(w)}
        parts = [None if p is None or not odd.isdisjoint(p) else p for p in parts]
        new -= odd
    new = list(new)
    found = _SPLIT.findall("\n".join(new))
    words.update(encode(list(set(found).difference(words, "\n"))))
    held: list[bytes] = []
    at = 0
    for x in found:
        if x == "\n":
            memo[new[at]] = held[0] if len(held) == 1 else b"".join(held)
            held.clear()
            at += 1
        else:
            held.append(words[x])
    if new:
        memo[new[at]] = b"".join(held)
    get = memo.__getitem__
    for t, p in zip(texts, parts, strict=True):
        yield np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if p is None else b"".join(map(get, p))


def _pieces(size: int, path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for b in batches:
            for x in slices(b, "text"):
                out: list[tuple] = []
                for doc, ids in zip(x.column("doc_id").to_pylist(), ids_of([t or "" for t in x.column("text").to_pylist()], path), strict=True):
                    raw = ids + b"\0\0\0\0"
                    for k, at4 in enumerate(range(0, len(raw), 4 * size)):
                        part = raw[at4 : at4 + 4 * size]
                        n = len(part) // 4
                        out.append((doc, k, at4 // 4, n, zlib.crc32(part), task, int(seen[n])))
                        seen[n] += 1
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def plan(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Bins as (times, lengths): a packing of counts[n] pieces of each length n."""
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    bins: list[tuple[int, tuple[int, ...]]] = []

    def fitting(most: int) -> int:
        """The largest length in stock up to most, or 0."""
        at = np.flatnonzero(left[1 : most + 1])
        return int(at[-1]) + 1 if len(at) else 0

    while n := fitting(size):
        got, gap = [], size
        while gap and (n := fitting(gap)):  # greedy: the largest that fits
            take = 1 if not got else min(gap // n, int(left[n]))
            got += [n] * take
            left[n] -= take
            gap -= n * take
        while gap and len(got) > 1:  # two for one: the smallest goes if a tighter pair is in stock
            s = got[-1]
            room = gap + s
            stock = np.flatnonzero(left[: room + 1])
            best = (s, 0, 0)
            last = np.maximum.accumulate(np.where(left[: room + 1] > 0, np.arange(room + 1), 0))
            for a in stock.tolist():
                if a * 2 > room and best[0] == room:
                    break
                b = int(last[room - a])
                if b == a and left[a] < 2:
                    b = int(last[a - 1]) if a else 0
                if b and a + b > best[0]:
                    best = (a + b, max(a, b), min(a, b))
            if not best[1]:
                break
            got.pop()
            left[s] += 1
            for x in best[1:]:
                got.append(x)
                left[x] -= 1
            gap = room - best[0]
        kinds, uses = np.unique(got, return_counts=True)
        more = int((left[kinds] // uses).min())
        left[kinds] -= more * uses
        bins.append((more + 1, tuple(got)))
    return bins


def _deal(bins: list[tuple[int, tuple[int, ...]]], size: int):
    """For each length, where in the ranking which bin's slot begins."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, lengths in bins:
        offset = 0
        for n in lengths:
            at = used.get(n, 0)
            runs.setdefault(n, []).append((at, first, offset, times))
            used[n] = at + times
            offset += n
        first += times
    table = {n: np.array(r, np.int64) for n, r in runs.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                t = table[n]
                k = np.searchsorted(t[:, 0], rank[at], "right") - 1
                seq[at] = t[k, 1] + rank[at] - t[k, 0]
                off[at] = t[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece of docs (doc_id, text)."""
    pieces = stage(in_arrow(docs.select("doc_id", "text"), _pieces(size, tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"), "pieces")
    held = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = held.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("task", "length", "before")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    return in_arrow(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), _deal(plan(counts, size), size), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"), default_tokenizer())

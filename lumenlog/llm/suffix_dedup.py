"""Operator 12, suffix-array dedup: bytes that lie in a `width`-byte string which starts anywhere else are removed.

The steps:

1. *Anchors.* Each window (string of `width` bytes) has one anchor, the smallest hashed `k`-byte gram in it, so
   equal windows have equal anchors. A run of consecutive windows with one anchor is a row (key, context): the key
   is the anchor's gram, the context all bytes that the run's windows cover. Windows whose key occurs once repeat
   nowhere and go no further.
2. *Shards.* Of each distinct context one occurrence is cut out and dealt by key, and of a second one its digest,
   which shows whether the slice occurs twice. A task joins what it gets to shards of about `SHARD` bytes, and
   each shard gets its suffix array by Larsson-Sadakane refinement: suffixes are sorted by their first four bytes,
   then only groups not yet sorted are refined, by the ranks of the suffixes 4, 8, 16, ... places further on. Kasai's walk in text order, one lane for each slice, gives the
   prefix each suffix shares with the one before it.
3. *Merging.* A key whose contexts go over a shard's border has suffixes in several arrays. Each suffix of the
   later shard is placed in the earlier arrays by binary search and compared with both neighbours there.
4. *Lengthened keys.* A key with more than `CONTEXTS` contexts is too much for one task. Its contexts are texts
   of their own then: windows in them are anchored by grams of `GRAMS[1]` bytes, and in what is still too much by
   all their bytes, so that a common passage with many surroundings spreads over many keys.
5. What repeats in a context is cut wherever the context occurs.

Null texts count as empty; those and short texts have no window and keep all bytes. Overlapping occurrences in one
text count. Repeated rows are separate occurrences, and so are rows of one doc_id that differ in text. Rows without
doc_id count and are cut like others. Other columns are ignored, and empty input gives no rows. Bytes are compared
as they are; second occurrences of a context are known by 128 bits of BLAKE2, further ones by 128 bits of plainer hashes,
and rows by doc_id and a 64-bit hash of the text. Long texts are read in overlapping pieces of `PIECE` bytes, which change no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import _BASE, _BYTE, _powers, drop, in_arrow, load, mix, slices, stage

WIDTH = 200
#: Bytes of the grams that anchor windows, at each length of keys; the last is a whole window.
GRAMS = (64, 176, WIDTH)
#: Contexts of a key up to which one task takes it, bytes of a shard, bytes of a long text's piece.
CONTEXTS, SHARD, PIECE = 10_000, 1 << 20, 1 << 22
#: Symbols (byte + 1, 0 past the end) that one integer key holds.
PACKED = 7


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts end to end, and where each begins."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if n and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def runs(data: np.ndarray, first: np.ndarray, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, key, context, start, more) for each run of windows of one anchor; the context is data[start:start + more + width]."""
    n, span, size = len(data), width - k + 1, np.diff(first)
    if n < width or not (size >= width).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    pw, inv = _powers(_BASE, n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[:n], out=c[1:])
    g = mix((c[k:] - c[:-k]) * inv[: n - k + 1], 21)
    packed = (g & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(g), dtype=np.uint64)  # pieces are shorter than 2**24
    m, step = packed, 1
    while step * 2 <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    low = np.minimum(m[: len(packed) - span + 1], m[span - step : span - step + len(packed) - span + 1])
    text = np.repeat(np.arange(len(size)), size)
    s = np.arange(n - width + 1)
    s = s[text[s] == text[s + width - 1]]
    a = (low[s] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (text[s[1:]] != text[s[:-1]])))
    lo, hi, a = s[new], s[np.append(new[1:], len(s)) - 1], a[new]
    context = mix(mix((c[hi + width] - c[lo]) * inv[lo], 22) + ((hi - lo) * 512 + (a - lo)).astype(np.uint64), 23)
    return text[lo], mix(g[a], 24), context, lo, hi - lo


def _pieces(b: pa.RecordBatch, col: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """(rows, their bytes, where each begins, places before) for slices of b; a long text comes in pieces that share width - 1 bytes."""
    for x in slices(b, col):
        data, first = _flat(x.column(col))
        for at in range(0, max(1, len(data) - width + 1), PIECE) if x.num_rows == 1 else [0]:
            part = data[at : at + PIECE + width - 1] if x.num_rows == 1 else data
            yield x, part, np.array([0, len(part)]) if x.num_rows == 1 else first, at


def _anchored(width: int, k: int, whole: bool):
    """Keys of the windows' runs; with `whole` also what else is known of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, data, first, before in _pieces(b, "text", width):
                text, key, context, lo, more = runs(data, first, width, k)
                out = {"key": pa.array(key.view(np.int64))}
                if whole:
                    out |= {"context": pa.array(context.view(np.int64)), "id": x.column("id").take(pa.array(text)), "lo": pa.array(lo - first[text] + before), "more": pa.array(more.astype(np.int16))}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def _cut_out(width: int, short: bool):
    """The bytes of the contexts that are listed for each text; with `short`, of a second copy its digest alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                listed = x.column("runs")
                row, r = np.repeat(np.arange(x.num_rows), np.asarray(listed.value_lengths())), listed.flatten()
                data, first = _flat(x.column("text"))
                lo = first[row] + r.field("lo").to_numpy()
                hi = lo + r.field("more").to_numpy() + width
                raw = data.tobytes()
                second = r.field("copy").to_numpy() > 0 if short else np.zeros(len(lo), bool)
                cut = pa.array([_digest(raw[i:j]) if d else raw[i:j] for i, j, d in zip(lo.tolist(), hi.tolist(), second.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(r.field(c) for c in ("key", "context", "copy")), cut], ["key", "context", "copy", "text"])

    return run


def packed(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The next `PACKED` symbols from each place on as one integer; end: where the slice of each place ends."""
    out, left = np.zeros(len(data), np.int64), end - np.arange(len(data))
    symbol = data.astype(np.int64) + 1
    for i in range(PACKED):
        out <<= 9
        n = max(0, len(data) - i)
        out[:n] += np.where(left[:n] > i, symbol[i:], 0)
    return out


def suffix_array(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, packed symbols) of slices end to end, by Larsson-Sadakane refinement.

    A slice's end is smaller than any byte, and ends are ordered by place. Sort keys are (symbols or ranks, place) in
    one integer, so that a plain sort does; a shard has at most 2**21 bytes for that.
    """
    size = np.diff(first)
    n, end, place = len(data), np.repeat(first[1:], size), (1 << 21) - 1
    if n > place:
        raise ValueError(f"a shard of {n} bytes")
    word = packed(data, end)
    at = np.arange(n)
    h = 4  # symbols of nine bits that leave room for the place
    by = np.sort((word >> 9 * (PACKED - h)) << 21 | at)
    sa = by & place
    by >>= 21
    new = np.append(True, by[1:] != by[:-1])
    rank = np.empty(n, np.int64)  # a group's number is the place of its first member, from 1 on
    rank[sa] = np.maximum.accumulate(np.where(new, at + 1, 0))
    longest = int(size.max(initial=0))
    while True:
        unsorted = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(unsorted) or h >= longest:  # what ties to its end is in the order of places already
            return sa, word
        s = sa[unsorted]
        nxt = s + h
        then = np.where(nxt < end[s], rank[np.minimum(nxt, n - 1)], 0)
        by = np.sort(rank[s] << 42 | then << 21 | s)
        s = by & place
        by >>= 21
        sa[unsorted] = s
        first_of = np.append(True, by[1:] != by[:-1])
        new[unsorted] = first_of
        rank[s] = np.maximum.accumulate(np.where(first_of, unsorted + 1, 0))
        h *= 2


def shared(word: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Common prefixes of the suffixes at a and b, which share h symbols already: `width` where that many are, else a lower bound."""
    h, go = h.copy(), np.flatnonzero(h < width)
    while len(go):
        at = np.minimum(h[go], width - PACKED)
        same = word[a[go] + at] == word[b[go] + at]
        go = go[same]
        h[go] = at[same] + PACKED
        go = go[h[go] < width]
    return h


def kasai(leaf: np.ndarray, order: np.ndarray, word: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """What each suffix of order (leaves, in the array's order) shares with the one before it, up to `width`.

    The walk goes in text order, all slices in step: the suffix one place on shares at least one symbol less.
    """
    n = len(leaf)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, np.int64)
    leaves = np.maximum(np.diff(first) - width + 1, 0)
    lane = np.argsort(-leaves, kind="stable")
    counts, h = leaves[lane], np.zeros(len(lane), np.int64)
    for t in range(int(counts[0]) if len(counts) else 0):
        m = int(np.searchsorted(-counts, -t, "left"))  # slices with more than t leaves
        p = first[lane[:m]] + t
        j = before[p]
        ok = np.flatnonzero(j >= 0)
        got = np.zeros(m, np.int64)
        got[ok] = shared(word, p[ok], j[ok], h[:m][ok], width)
        out[p] = got
        nxt = np.minimum(j + 1, n - 1)
        h[:m] = np.where((j >= 0) & (j + 1 < n) & leaf[nxt], np.maximum(got - 1, 0), 0)
    return out


class Shard:
    """Some slices (key, context, copy, text), by key and context, with their suffix array and the places at which repeated windows start.

    A context's second copy comes as a digest after the first; where it is that of the first's bytes, they are one
    slice that occurs twice. A key that has one slice, and none in another shard, has nothing to be compared with and
    stays out of the array.
    """

    def __init__(self, rows: pa.Table, width: int):
        self.width = width
        key, text = (rows.column(c).combine_chunks() for c in ("key", "text"))
        number = key.to_numpy()
        self.first_key, self.last_key = (number[0], number[-1]) if len(number) else (None, None)
        second = rows.column("copy").to_numpy() > 0
        kept = np.flatnonzero(~second)
        many = np.append(second, False)[kept + 1]
        for i in np.flatnonzero(many).tolist():
            many[i] = _digest(text[int(kept[i])].as_py()) == text[int(kept[i]) + 1].as_py()
        number = number[kept]
        edge = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else kept
        counts = np.diff(np.append(edge, len(number)))
        alone = (np.repeat(counts, counts) == 1) & (number != self.first_key) & (number != self.last_key)
        self.twins = rows.take(pa.array(kept[alone & many]))
        rows = rows.take(pa.array(kept[~alone]))
        self.rows, self.key = rows, number[~alone]
        self.data, self.first = _flat(rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.binary()))
        size = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(self.data))
        self.leaf = self.first[1:][self.owner] - at >= width if len(at) else np.zeros(0, bool)
        sa, self.word = suffix_array(self.data, self.first)
        self.order = sa[self.leaf[sa]]
        lcp = kasai(self.leaf, self.order, self.word, self.first, width)[self.order]
        with_next = np.append(lcp[1:], 0) if len(lcp) else lcp
        self.again = many[~alone][self.owner] & self.leaf if len(at) else np.zeros(0, bool)
        self.again[self.order[(lcp >= width) | (with_next >= width)]] = True

    def of_key(self, key: int) -> np.ndarray:
        """The leaves of a key's slices, in the array's order."""
        return self.order[self.key[self.owner[self.order]] == key]

    def merge(self, later: Shard, key: int) -> None:
        """Mark what this shard and a later one have both of a key's windows: binary search of the later's suffixes in this one's array."""
        mine, theirs = self.of_key(key), later.of_key(key)
        if not len(mine) or not len(theirs):
            return
        lo, hi = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self._less(mine[mid], later, theirs[open_])
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        # lo: the first of mine that isn't smaller; equal windows start there and go on
        at = np.flatnonzero(lo < len(mine))
        at = at[self._equal(mine[lo[at]], later, theirs[at])]
        later.again[theirs[at]] = True
        self.again[mine[lo[at]]] = True  # of several equal ones, each has been found within this shard

    def _equal(self, a: np.ndarray, other: Shard, b: np.ndarray) -> np.ndarray:
        same = np.ones(len(a), bool)
        for h in (*range(0, self.width - PACKED, PACKED), self.width - PACKED):
            go = np.flatnonzero(same)
            same[go] = self.word[a[go] + h] == other.word[b[go] + h]
        return same

    def _less(self, a: np.ndarray, other: Shard, b: np.ndarray) -> np.ndarray:
        """Whether each window of this shard is smaller than that of the other."""
        out, go = np.zeros(len(a), bool), np.arange(len(a))
        for h in (*range(0, self.width - PACKED, PACKED), self.width - PACKED):
            x, y = self.word[a[go] + h], other.word[b[go] + h]
            out[go] = x < y
            go = go[x == y]
            if not len(go):
                break
        return out

    def ranges(self) -> list[pa.RecordBatch]:
        """Ranges of bytes of the slices' contexts that repeated windows cover."""
        cover = np.zeros(len(self.data) + 1, np.int64)
        at = np.flatnonzero(self.again)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.width, -1)
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.append(True, gone[1:] != gone[:-1]) if len(gone) else gone
        edge[self.first[:-1]] = True
        at = np.flatnonzero(edge)
        lo, hi = at[gone[at]], np.append(at[1:], len(gone))[gone[at]]
        who = self.owner[lo] if len(lo) else lo
        found = [self.rows.column(c).take(pa.array(who)).combine_chunks() for c in ("key", "context")]
        part = pa.Table.from_arrays([*found, *(pa.array((x - self.first[who]).astype(np.int32)) for x in (lo, hi))], ["key", "context", "from", "to"])
        ends = pc.binary_length(self.twins.column("text")).cast(pa.int32())
        whole = pa.Table.from_arrays([self.twins.column("key"), self.twins.column("context"), pa.array(np.zeros(len(ends), np.int32)), ends], part.column_names)
        return pa.concat_tables([part, whole]).combine_chunks().to_batches()


def _sharded(width: int, most: int):
    """Ranges for slices that come by key: shards of about `most` bytes, and merging where a key goes on in the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[Shard] = []  # those that hold the last key seen
        held: list[pa.RecordBatch] = []

        def shard(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal open_, held
            rows = pa.Table.from_batches(held).combine_chunks()
            stay = 0 if last else 1 + rows.column("copy")[-1].as_py()  # a context's copies stay together
            held = rows.slice(rows.num_rows - stay).to_batches() if stay else []
            if rows.num_rows == stay:
                return
            new = Shard(rows.slice(0, rows.num_rows - stay), width)
            if open_ and open_[-1].last_key == new.first_key:
                for old in open_:
                    old.merge(new, new.first_key)
            if open_ and open_[-1].last_key == new.last_key:
                open_.append(new)  # one key goes through it
                return
            for old in open_:
                yield from old.ranges()
            open_ = [new]

        for b in batches:
            for x in slices(b, "text", most):
                held.append(x)
                if sum(h.column("text").nbytes for h in held) >= most:
                    yield from shard(False)
        if held:
            yield from shard(True)
        for old in open_:
            yield from old.ranges()

    return run


def repeats(texts: DataFrame, width: int = WIDTH, grams: tuple[int, ...] = GRAMS, contexts: int = CONTEXTS, shard: int = SHARD) -> DataFrame:
    """Ranges of bytes (id, lo, hi) of texts (id, text binary) that lie in windows which occur elsewhere as well."""
    k, id_type = grams[0], texts.schema["id"].dataType.simpleString()
    keys = in_arrow(texts, _anchored(width, k, False), "key long").groupBy("key").count().where("count > 1").select("key")
    every = in_arrow(texts, _anchored(width, k, True), f"key long, context long, id {id_type}, lo long, more short")  # cheaper to make twice than to keep
    keys = stage(keys, "keys")
    found = stage(every.join(keys, "key", "left_semi"), "runs")
    drop(keys)
    one = F.struct("id", "lo", "more")
    each = found.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(one).alias("one"), F.max(one).alias("two"))
    each = stage(each, "contexts")
    size = each.groupBy("key").agg(F.count("*").alias("contexts"), F.sum("n").alias("n")).where("n > 1")
    live = each.drop("n").join(size.drop("n"), "key")
    copies = F.when(F.col("one") == F.col("two"), F.array(F.struct(F.lit(0).alias("copy"), "one.*"))).otherwise(F.array(F.struct(F.lit(0).alias("copy"), "one.*"), F.struct(F.lit(1).alias("copy"), "two.*")))
    live = live.select("key", "context", "contexts", F.explode(copies).alias("x")).select("key", "context", "contexts", "x.*")

    def sliced(rows: DataFrame, short: bool) -> DataFrame:
        listed = rows.groupBy("id").agg(F.collect_list(F.struct("key", "context", "copy", "lo", "more")).alias("runs"))
        return in_arrow(texts.join(listed.hint("shuffle_hash"), "id"), _cut_out(width, short), "key long, context long, copy int, text binary")

    live = stage(live, "slices")
    drop(each)
    narrow = live.where(F.col("contexts") <= contexts) if len(grams) > 1 else live
    ranges = in_arrow(sliced(narrow, True).repartition("key").sortWithinPartitions("key", "context", "copy"), _sharded(width, shard), "key long, context long, from int, to int")
    if len(grams) > 1 and not (wide := live.where(F.col("contexts") > contexts)).isEmpty():
        again = stage(sliced(wide, False).select(F.struct("key", "context", "copy").alias("id"), "text"), "wide")
        ranges = ranges.union(repeats(again, width, grams[1:], contexts, shard).select("id.key", "id.context", F.col("lo").cast("int"), F.col("hi").cast("int")))
    # two copies of a context may have repeats each that the other hasn't shown, so a context may have its ranges twice
    ranges = stage(ranges.distinct(), "ranges")
    drop(live)
    return found.join(ranges, ["key", "context"]).select("id", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices(batch, "text")):
        data, first = _flat(b.column("text"))
        listed = b.column("cuts")
        row = np.repeat(np.arange(b.num_rows), np.asarray(listed.fill_null([]).value_lengths()))
        r = listed.fill_null([]).flatten()
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, first[row] + r.field("lo").to_numpy(), 1)
        np.add.at(cover, first[row] + r.field("hi").to_numpy(), -1)
        stay = np.cumsum(cover)[:-1] == 0
        edge = np.append(True, stay[1:] != stay[:-1]) if len(stay) else stay
        edge[first[:-1][np.diff(first) > 0]] = True
        gone = np.add.reduceat(np.append(~stay, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0) if b.num_rows else first[:-1]
        spans = np.add.reduceat(np.append(edge & ~stay, False).astype(np.int64), first[:-1]) * (np.diff(first) > 0) if b.num_rows else first[:-1]
        kept = [data[i:j][stay[i:j]].tobytes() if n else data[i:j].tobytes() for i, j, n in zip(first[:-1].tolist(), first[1:].tolist(), gone.tolist(), strict=True)]
        columns = [b.column("doc_id"), pa.array(np.diff(first)), pa.array(gone), pa.array(spans), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, width: int = WIDTH, grams: tuple[int, ...] = GRAMS, contexts: int = CONTEXTS, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay, which need not be UTF-8) for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", text.cast("binary").alias("text"), F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64(text, F.col("doc_id").isNull()).alias("own")).alias("id"))
    cuts = repeats(docs.select("id", "text"), width, grams, contexts, shard).groupBy("id").agg(F.collect_set(F.struct("lo", "hi")).alias("cuts"))
    return in_arrow(docs.join(cuts, "id", "left").select("doc_id", "text", "cuts"), _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = {
    "op12_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
starts AS (SELECT doc_id, unnest(range(0, n - 199)) AS p, unnest(list_transform(range(0, n - 199), lambda i: md5(substr(h, 2 * i + 1, 400)))) AS s FROM d WHERE n >= 200),
again AS (SELECT doc_id, p AS start FROM starts QUALIFY count(*) OVER (PARTITION BY s) > 1),
opens AS (SELECT doc_id, start, coalesce(start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) > 200, true)::INT AS new FROM again),
spans AS (SELECT doc_id, min(start) AS lo, max(start) + 200 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS span FROM opens) GROUP BY doc_id, span),
gaps AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM spans),
cut AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) AS t FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(t, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
}

"""Operator 1, substring dedup: suffix trees over groups of suffixes with a common, variable-length prefix.

A window is `width` consecutive words of one text. Words that lie in a window whose sequence also
starts elsewhere are removed. The steps:

1. *Prefixes.* Each window has one anchor, the smallest hashed `PREFIX`-gram in it, so that equal
   windows have equal anchors. A run of windows with one anchor is a row (prefix, context): the
   prefix is the anchor's gram, the context all words that the run's windows cover. A prefix that
   occurs once can't start a repeat; its suffixes go no further.
2. *Slices.* Each distinct context is sent once, as words, to the group of its prefix, with the
   number of times it occurs. All groups are small enough for a task: a prefix with more than
   `CONTEXTS` contexts is lengthened to the whole window, `width` words from each start.
3. *Subtrees.* A group's suffixes, all window starts of its slices, are sorted by their words, and
   the words that neighbours share are the depths of the internal nodes above them: a suffix array
   with common prefixes, which is the subtree. A suffix under an internal node at depth `width` or
   more, or that stands for several, repeats down to the deepest such node; those words go. The
   subtree of a lengthened prefix begins at depth `width`, so it repeats where it has two suffixes.
4. The ranges found in a context are cut wherever it occurs.

Nulls, empty and short texts have no window and keep all their words. Repeated rows are separate
occurrences. A row without doc_id keeps its words and counts for none; where rows of one doc_id
differ in text, what is cut from one is cut from the other's same places. Other columns are ignored.
Words are compared as they are within groups; contexts are identified by 128 bits of hash, and so
are the windows of lengthened prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import Words, _powers, _WBASE, filled, hot_keys, in_arrow, load, mix, slices, stage

WIDTH, PREFIX = 35, 10
#: Distinct contexts of a prefix up to which it has one group, and bytes of slices whose subtrees a task grows at once.
CONTEXTS, HELD = 10_000, 2 << 20


def runs(w: Words, width: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, prefix hash, context hash, first start, last start) for each run of windows with one anchor; starts count from the text's first word."""
    n, span = len(w.hash), width - k + 1
    count = np.diff(w.first)
    if n < width or not (count >= width).any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    g = w.grams(k)
    packed = (mix(g, 3) & np.uint64(0xFFFFFFFFFF000000)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(0xFFFFFF))
    m, step = packed, 1
    while step * 2 <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    low = np.minimum(m[: len(packed) - span + 1], m[span - step : span - step + len(packed) - span + 1])
    text = np.repeat(np.arange(len(count)), count)
    s = np.arange(n - width + 1)
    s = s[text[s] == text[s + width - 1]]
    base = s & ~0xFFFFFF
    a = base + (low[s] & np.uint64(0xFFFFFF)).astype(np.int64)
    a = np.where(a < s, a + 0x1000000, a)
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (text[s[1:]] != text[s[:-1]])))
    lo, hi, a = s[new], s[np.append(new[1:], len(s)) - 1], a[new]
    pw, inv = _powers(_WBASE, n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * pw[:n], out=c[1:])
    context = mix(mix((c[hi + width] - c[lo]) * inv[lo], 4) + ((hi - lo) * 64 + (a - lo)).astype(np.uint64), 5)
    t = text[lo]
    return t, g[a], context, lo - w.first[t], hi - w.first[t]


def _anchors(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                t, p, c, lo, hi = runs(Words(filled(x.column("text"))), width, k)
                doc = x.column("doc_id").take(pa.array(t))
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(c.view(np.int64)), doc, pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int16))], ["prefix", "context", "doc_id", "lo", "more"])

    return run


def _listed(x: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
    """The row of each listed run, and the runs."""
    runs_ = x.column("runs")
    return np.repeat(np.arange(x.num_rows), np.asarray(runs_.value_lengths())), runs_.flatten()


def _slices(width: int):
    """The words of the listed runs' contexts, as one piece of text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                w = Words(filled(x.column("text")))
                row, r = _listed(x)
                lo, more = (r.field(c).to_numpy().astype(np.int64) for c in ("lo", "more"))
                ok = np.flatnonzero(w.first[row] + lo + more + width <= w.first[row + 1])  # of another text by that doc_id, if not
                first = w.first[row[ok]] + lo[ok]
                raw = w.raw.tobytes()
                cut = [raw[i:j] for i, j in zip(w.start[first].tolist(), w.end[first + more[ok] + width - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(r.field(c).take(pa.array(ok)) for c in ("prefix", "context", "many")), pa.array(cut, pa.binary())], ["prefix", "context", "many", "words"])

    return run


def _windows(width: int):
    """The windows of listed runs, by 128 bits of hash of all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "words"):
                w = Words(x.column("words").cast(pa.large_binary()))
                n = np.maximum(np.diff(w.first) - width + 1, 0)
                row = np.repeat(np.arange(x.num_rows), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos = w.first[row] + at
                h = [w.grams(width, seed)[pos].view(np.int64) for seed in (2, 9)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, h), *(x.column(c).take(pa.array(row)) for c in ("prefix", "context", "many")), pa.array(at.astype(np.int16))], ["w1", "w2", "prefix", "context", "many", "at"])

    return run


def _ranks(label: np.ndarray, end: np.ndarray, most: int) -> list[np.ndarray]:
    """Ranks of the 1, 2, 4, ... words from each place on (fewer at its slice's end), in their order."""
    at = np.arange(len(label))
    out, h = [label + 1], 1
    while h < most:
        low = out[-1]
        nxt = np.where(at + h < end, low[np.minimum(at + h, len(low) - 1)], 0)
        out.append(np.unique(low * (int(low.max()) + 1) + nxt, return_inverse=True)[1] + 1)
        h *= 2
    return out


def subtree(group: np.ndarray, many: np.ndarray, words: list[list[bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix place, its slice, depth) of all suffixes of at least `width` words, over the slices' words end to end.

    depth: how many words the suffix shares down to the deepest internal node above it within its group.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = [x for w in words for x in w]
    number = {x: i for i, x in enumerate(set(flat))}
    label = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    stop = np.cumsum(size)
    owner = np.repeat(np.arange(len(size)), size)
    end = stop[owner]
    ranks = _ranks(label, end, int(size.max()))
    place = np.flatnonzero(end - np.arange(len(flat)) >= width)
    order = place[np.lexsort((ranks[-1][place], group[owner[place]]))]  # the leaves from left to right
    left, right = order[:-1].copy(), order[1:].copy()
    same = group[owner[left]] == group[owner[right]]
    shared = np.zeros(len(left), np.int64)
    for level in range(len(ranks) - 1, -1, -1):  # the depth of the node above two neighbours
        h = 1 << level
        go = same & (left + h <= end[order[:-1]]) & (right + h <= end[order[1:]])
        go[go] = ranks[level][left[go]] == ranks[level][right[go]]
        shared[go] += h
        left[go] += h
        right[go] += h
    depth = np.maximum(np.append(0, shared), np.append(shared, 0)) if len(order) else np.zeros(0, np.int64)
    own = owner[order]
    return order, own, np.where(many[own], end[order] - order, depth)


def _grown(rows: pa.Table, width: int) -> pa.RecordBatch:
    """Ranges of words of the slices that lie under nodes at depth `width` and more."""
    prefix = rows.column("prefix").to_numpy()
    words = [x.split() for x in rows.column("words").to_pylist()]
    place, own, depth = subtree(np.append(0, np.cumsum(prefix[1:] != prefix[:-1])), rows.column("many").to_numpy(), words, width)
    begin = np.append(0, np.cumsum([len(w) for w in words]))
    cover = np.zeros(begin[-1] + 1, np.int64)
    deep = depth >= width
    np.add.at(cover, place[deep], 1)
    np.add.at(cover, place[deep] + depth[deep], -1)
    gone = np.cumsum(cover)[:-1] > 0
    edge = np.append(True, gone[1:] != gone[:-1])
    edge[begin[:-1]] = True
    at = np.flatnonzero(edge)
    lo, hi = at[gone[at]], np.append(at[1:], len(gone))[gone[at]]
    who = np.searchsorted(begin, lo, "right") - 1
    found = [rows.column(c).take(pa.array(who)).combine_chunks() for c in ("prefix", "context")]
    return pa.RecordBatch.from_arrays([*found, *(pa.array((x - begin[who]).astype(np.int32)) for x in (lo, hi))], ["prefix", "context", "from", "to"])


def _subtrees(width: int):
    """Ranges for slices that come by prefix, some groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.column("words").nbytes < HELD:
                continue
            prefix = held.column("prefix").to_numpy()
            whole = int(np.flatnonzero(prefix != prefix[-1])[-1]) + 1 if prefix[0] != prefix[-1] else 0
            if whole:  # the last group may go on
                yield _grown(held.slice(0, whole), width)
                held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield _grown(held, width)

    return run


def repeats(docs: DataFrame, width: int = WIDTH, k: int = PREFIX, most: int = CONTEXTS) -> DataFrame:
    """Ranges of words (doc_id, lo, hi) of docs (doc_id, text) whose windows occur elsewhere as well."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    anchors = in_arrow(docs, _anchors(width, k), "prefix long, context long, doc_id long, lo int, more short")  # cheaper to make twice than to keep
    hot = hot_keys(anchors, "prefix", 50_000)
    few = ~F.col("prefix").isin(hot) if hot else F.lit(True)
    by, ctx = Window.partitionBy("prefix"), Window.partitionBy("prefix", "context")
    columns = ["prefix", "context", "doc_id", "lo", "more", (F.col("n") > 1).alias("many"), (F.col("contexts") > most).alias("wide"), "nth"]
    cold = (
        anchors.where(few)
        .withColumn("n", F.count("*").over(ctx))
        .withColumn("nth", F.row_number().over(ctx.orderBy("context")))
        .withColumn("contexts", F.sum((F.col("nth") == 1).cast("long")).over(by))
        .where("n > 1 or contexts > 1")
        .select(*columns)
    )
    found = [cold]
    if hot:  # prefixes of a large part of the corpus are counted by partial sums and never meet in one task
        held = anchors.where(F.col("prefix").isin(hot))
        each = held.groupBy("prefix", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo")).alias("least"))
        contexts = F.broadcast(each.groupBy("prefix").agg(F.count("*").alias("contexts")))  # at most 500 rows
        each = stage(each.join(contexts, "prefix").where("n > 1 or contexts > 1"), "contexts")
        nth = F.when((F.col("doc_id") == F.col("least.doc_id")) & (F.col("lo") == F.col("least.lo")), 1).otherwise(2).alias("nth")
        found.append(held.join(each, ["prefix", "context"]).withColumn("nth", nth).select(*columns))
    seen = stage(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "runs")

    def sliced(rows: DataFrame) -> DataFrame:
        per_doc = rows.where("nth = 1").groupBy("doc_id").agg(F.collect_list(F.struct("lo", "more", "prefix", "context", "many")).alias("runs"))
        return in_arrow(docs.join(per_doc.hint("shuffle_hash"), "doc_id"), _slices(width), "prefix long, context long, many boolean, words binary")

    ranges = in_arrow(sliced(seen.where("not wide")).repartition("prefix").sortWithinPartitions("prefix"), _subtrees(width), "prefix long, context long, from int, to int")
    if not seen.where("wide").isEmpty():
        windows = stage(in_arrow(sliced(seen.where("wide")), _windows(width), "w1 long, w2 long, prefix long, context long, many boolean, at short"), "windows")
        again = windows.groupBy("w1", "w2").agg(F.sum(F.when(F.col("many"), 2).otherwise(1)).alias("n")).where("n > 1").select("w1", "w2")
        ranges = ranges.union(windows.join(again, ["w1", "w2"]).select("prefix", "context", F.col("at").cast("int"), (F.col("at") + width).cast("int")))
    ranges = stage(ranges, "ranges")
    return seen.join(ranges, ["prefix", "context"]).select("doc_id", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for batch in batches for x in slices(batch, "text")):
        out: list[tuple] = []
        for doc, text, rows in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
            words = (text or "").encode().split()
            gone = 0
            if rows:
                keep = np.zeros(len(words) + 1, np.int32)
                np.add.at(keep, [min(r["lo"], len(words)) for r in rows], 1)
                np.add.at(keep, [min(r["hi"], len(words)) for r in rows], -1)
                stay = np.cumsum(keep)[:-1] == 0
                gone = len(words) - int(stay.sum())
                kept = b" ".join([x for x, y in zip(words, stay.tolist(), strict=True) if y])
            else:
                kept = b" ".join(words)
            out.append((doc, len(words), gone, kept.decode()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the kept words joined by one space) for each row of docs."""
    docs = docs.select("doc_id", "text")
    cuts = repeats(docs, width).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    return in_arrow(docs.join(cuts, "doc_id", "left"), _cut, "doc_id long, n_words long, n_removed long, kept_text string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = {
    "op1_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(0, len(w) - 34)) AS p, unnest(list_transform(range(0, len(w) - 34), lambda i: md5(array_to_string(w[i + 1:i + 35], ' ')))) AS h FROM d WHERE len(w) >= 35),
again AS (SELECT doc_id, p AS start FROM starts QUALIFY count(*) OVER (PARTITION BY h) > 1),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS word FROM d),
marked AS (SELECT words.doc_id, words.p, word, max(start) OVER (PARTITION BY words.doc_id ORDER BY words.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM words LEFT JOIN again ON words.doc_id = again.doc_id AND words.p = start),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
}

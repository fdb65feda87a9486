"""Operator 4, n-gram Jaccard join over a token-group matrix.

Links join documents whose sets of `k`-word shingles have Jaccard similarity of at least
`percent` / 100. All links between different sets are found; documents with equal sets are a class.

1. *Signatures.* Two linked sets of at most `hi` shingles differ in at most D of them. Shingles are
   dealt by hash into D + 1 + slack parts, so a linked pair has equal shingles in at least one part
   that isn't empty. A part's signature is a hash of its shingles. A set leaves its `slack` smallest
   parts out, by size and signature: of the slack + 1 or more parts that a pair shares, the largest
   stays in both. Sizes are dealt into classes; a set has the signatures of its own class and, if it
   can link upwards, of the next. Shared passages would make false candidates, so the shingles that
   most documents have are left out at first; a set whose parts are then empty more often than the
   slack has the signatures of all its shingles too, and if those are, each shingle of a prefix: a
   pair of which one set isn't such a case shares a part before, and one of which both are, then.
2. *Blocks.* Sets of a class with a common signature are candidates; connected candidates a block. A
   set can be in a block of either of its classes, so blocks don't run on from one size to the next.
   A block is dealt into chunks of bounded size, sets with the same most common signature together.
   Only members' shingles are sent to them, as hashes.
3. *Token-group matrix.* A chunk's sets meet in one task, which orders them, cuts them into groups of
   similar ones, and keeps each group's union of shingles. A set opens a group only if its overlap
   with that union reaches the bound; only then are exact similarities taken.
4. *Blocks of many chunks.* Where components have swallowed most of a block, one set of each meets
   those of its other chunks until no more link: a block of near copies is one then. Sets outside
   their block's largest component then visit those other chunks that hold a set with one of their
   signatures and of another component, in batches of bounded size, and meet the same matrix there.
5. *Components* over the links found, by the smallest doc_id of each set; copies take their set's.

Documents without words (null or empty text) have no shingles and stay alone; one with fewer than k
words has its whole word sequence as its shingle. Ties don't matter. Rows with equal doc_id count
as one document: what one of their texts links, is linked to all. A null doc_id links with nothing.
Sets and shingles are identified by 128 and 64 bits of hash. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import Words, components, filled, in_arrow, load, mix, slices, stage

#: Sets and shingles of a block's chunk; sets of a group of the matrix, and cells of it at once.
CHUNK, CHUNK_SHINGLES, GROUP, CELLS = 6000, 1_500_000, 64, 4_000_000
TINY = 16
#: Shares that a block's rows are dealt over where they look up what holds for the block; sets that a task remembers to have signed.
SALTS, REMEMBERED = 16, 1_000_000
#: Shingles that signatures leave out at most, and the sets that must have one.
COMMON, LEAST = 20_000, 100


def classes(percent: int) -> list[tuple[int, int]]:
    """(largest size, parts) of each size class from 0 on; parts 0: prefixes instead."""
    out, lo = [], 1
    while lo < 1 << 40:
        hi = max(lo, TINY if not out else math.floor(lo * 100 / percent) * 16 // 15)
        most = (100 - percent) * 2 * hi // (100 + percent)
        out.append((hi, 0 if hi <= TINY else most + 1 + _slack(most)))
        lo = hi + 1
    return out


def _slack(most):
    return 3 + most // 5


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) pairs, sorted and distinct."""
    count = np.diff(w.first)
    n = len(w.hash)
    text = np.repeat(np.arange(len(count)), count)
    g = w.grams(k)
    at = np.arange(len(g))
    at = at[text[at] == text[at + k - 1]] if len(g) else at
    texts, tokens = [text[at]], [g[at]]
    for i in np.flatnonzero((count > 0) & (count < k)).tolist():  # too short: the whole sequence
        h = w.hash[w.first[i] : w.first[i + 1]]
        x = np.uint64(len(h))
        for v in h:
            x = mix(np.array([x ^ v]), 11)[0]
        texts.append(np.array([i]))
        tokens.append(np.array([x], np.uint64))
    t, s = np.concatenate(texts), np.concatenate(tokens)
    order = np.lexsort((s, t))
    t, s = t[order], s[order]
    new = np.append(True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])) if len(t) else np.zeros(0, bool)
    return t[new], s[new]


def _sum_by(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, start) if len(start) else np.zeros(0, values.dtype)


def identities(t: np.ndarray, s: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit hashes of each text's set."""
    size = np.bincount(t, minlength=texts)
    c1, c2 = np.zeros(len(s) + 1, np.uint64), np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s, 21), out=c1[1:])
    np.cumsum(mix(s, 22), out=c2[1:])
    end = np.cumsum(size)
    return size, mix((c1[end] - c1[end - size]) ^ size.astype(np.uint64), 23), mix((c2[end] - c2[end - size]) ^ size.astype(np.uint64), 24)


def class_of(size: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(np.array([hi for hi, _ in classes(percent)], np.int64), size)


def signatures(t: np.ndarray, s: np.ndarray, size: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each signature's text, size class and value; common: sorted shingles to leave out while enough parts stay filled."""
    table = classes(percent)
    his = np.array([hi for hi, _ in table], np.int64)
    parts_of = np.array([m for _, m in table], np.int64)
    own = class_of(size, percent)
    rare = np.ones(len(s), bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s
    out_t, out_c, out_s = [], [], []
    for up in (0, 1):
        cls = own + up
        takes = (size > 0) if not up else (size > 0) & (size * 100 > his[own] * percent - 100)
        parts = parts_of[cls]
        cut = takes & (parts > 0)
        prefix = takes & (parts == 0)
        for kind in (0, 1):  # of a pair, one set or none has too many empty parts and the rare shingles do, or both go on to all shingles
            row = cut[t] & (rare if kind == 0 else True)
            ti, si = t[row], s[row]
            part = (mix(si, 31) % parts[ti].astype(np.uint64)).astype(np.int64)
            key = ti.astype(np.int64) << 40 | part
            order = np.argsort(key, kind="stable")
            key, ti, part = key[order], ti[order], part[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            ti = ti[first]
            sig = mix(_sum_by(mix(si[order], 32), first) ^ mix(((part[first] * 4096 + cls[ti]) * 2 + kind).astype(np.uint64), 33), 34)
            held = np.diff(np.append(first, len(order)))
            filled_parts = np.bincount(ti, minlength=len(size))
            empty = parts - filled_parts
            slack = _slack((100 - percent) * 2 * his[cls] // (100 + percent))
            order = np.lexsort((sig, held, ti))  # the smallest parts first; empty ones come before them
            ti, sig = ti[order], sig[order]
            nth = np.arange(len(ti)) - (np.cumsum(filled_parts) - filled_parts)[ti]
            keep = nth >= (slack - empty)[ti]
            out_t.append(ti[keep])
            out_c.append(cls[ti[keep]])
            out_s.append(sig[keep])
            cut = cut & (empty > slack)
        prefix = prefix | cut
        row = prefix[t]
        if row.any():  # the smallest shingles by hash, as many as a linked pair can't all miss
            ti, si = t[row], mix(s[row], 35)
            order = np.lexsort((si, ti))
            ti, si = ti[order], si[order]
            begin = np.flatnonzero(np.append(True, ti[1:] != ti[:-1]))
            rank = np.arange(len(ti)) - np.repeat(begin, np.diff(np.append(begin, len(ti))))
            keep = rank <= size[ti] - -(-percent * size[ti] // 100)
            out_t.append(ti[keep])
            out_c.append(cls[ti[keep]])
            out_s.append(mix(si[keep] ^ mix(cls[ti[keep]].astype(np.uint64), 36), 37))
    if not out_t:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_t), np.concatenate(out_c), np.concatenate(out_s)


def _identify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                t, s = shingle_sets(Words(filled(x.column("text")), lower=True), k)
                size, a, c = identities(t, s, x.num_rows)
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(size), pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(class_of(size, percent).astype(np.int32))], ["doc_id", "n_shingles", "set1", "set2", "cls"])

    return run


def _repeated(k: int):
    """Shingles that two or more sets of a slice have, with how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                _, s = shingle_sets(Words(filled(x.column("text")), lower=True), k)
                token, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    return run


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """At most `COMMON` shingles that most documents share, sorted. Whatever they are, no link is lost; the more of them, the fewer false candidates."""
    counts = in_arrow(docs.select("text"), _repeated(k), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= LEAST).orderBy(F.desc("n"), "shingle").limit(COMMON).collect()
    return np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))


def _sign(k: int, percent: int, common: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for x in slices(b, "text"):
                t, s = shingle_sets(Words(filled(x.column("text")), lower=True), k)
                size, a, _ = identities(t, s, x.num_rows)
                held, first = np.unique(a, return_index=True)  # copies within a task sign once
                one = np.zeros(len(a), bool)
                one[first[[h not in seen for h in held.tolist()]]] = True
                seen = seen if len(seen) < REMEMBERED else set()
                seen.update(held.tolist())
                row = one[t]
                ti, cls, sig = signatures(t[row], s[row], np.where(one, size, 0), percent, common)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(a[ti].view(np.int64)), pa.array(size[ti].astype(np.int32)), pa.array(cls.astype(np.int32))], ["sig", "set1", "n", "cls"])

    return run


def matrix_links(sets: list[np.ndarray], side: np.ndarray, percent: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the linked sets of a task into their components (a spanning part of all links).

    side: 0 for one chunk alone, else 1 for members and 2 for visitors, and only links across count.
    known: numbers of the components that the sets are in already, which need no link.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    token, col, seen = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    shared = seen[col] > 1
    cols = np.cumsum(seen > 1) - 1
    own_col, own_row = cols[col[shared]], owner[shared]
    width = int((seen > 1).sum())
    # sets with the most common shingles first: the hubs of their clusters
    weight = np.bincount(own_row, seen[col[shared]], n) / np.maximum(size, 1)
    order = np.lexsort((-weight, size // 8)) if n <= GROUP else np.argsort(-weight, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    parent = np.arange(n)
    if known is not None:
        _, first, component = np.unique(known, return_index=True, return_inverse=True)
        parent = first[component]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    by_row = np.argsort(own_row, kind="stable")
    row_cols = own_col[by_row]
    row_at = np.searchsorted(own_row[by_row], np.arange(n + 1))
    links = []
    after = 0
    while after < n:
        g = after
        members = order[g : g + GROUP]
        cells = np.cumsum(size[members]) * np.arange(1, len(members) + 1)
        members = members[: max(1, int(np.searchsorted(cells, CELLS, "right")))]  # fewer if they are long
        after = g + len(members)
        union = np.unique(np.concatenate([row_cols[row_at[i] : row_at[i + 1]] for i in members]))
        if not len(union):
            continue
        place = np.full(width, -1, np.int64)
        place[union] = np.arange(len(union))
        inside = place[own_col]
        hit = inside >= 0
        overlap = np.bincount(own_row[hit], minlength=n)
        opens = overlap * 100 >= percent * size  # |Q and union| >= t |Q|
        opens &= rank >= g
        if side.any():
            here = set(side[members].tolist())
            opens &= np.isin(side, [3 - x for x in here]) if len(here) == 1 else True
        queries = np.flatnonzero(opens)
        if not len(queries):
            continue
        mm = np.zeros((len(members), len(union)), np.float32)
        for r, i in enumerate(members.tolist()):
            mm[r, place[row_cols[row_at[i] : row_at[i + 1]]]] = 1
        step = max(1, CELLS // len(union))
        for lo in range(0, len(queries), step):
            part = queries[lo : lo + step]
            m = np.zeros((len(part), len(union)), np.float32)
            for r, i in enumerate(part.tolist()):
                at = place[row_cols[row_at[i] : row_at[i + 1]]]
                m[r, at[at >= 0]] = 1
            inter = np.rint(m @ mm.T).astype(np.int64)
            linked = 100 * inter >= percent * (size[part][:, None] + size[members][None, :] - inter)
            for q, r in np.argwhere(linked).tolist():
                a, b = int(part[q]), int(members[r])
                if a == b or side[a] == side[b] != 0:
                    continue
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[ra] = rb
                    links.append((a, b))
    return links


def _bodies(k: int):
    """The sorted shingles of each row's text, where they are the set that the row stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                t, s = shingle_sets(Words(filled(x.column("text")), lower=True), k)
                size, a, _ = identities(t, s, x.num_rows)
                at = np.flatnonzero(a.view(np.int64) == x.column("set1").to_numpy())
                end = np.cumsum(size)
                tokens = [s[end[i] - size[i] : end[i]].tobytes() for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([*(x.column(c).take(pa.array(at)) for c in ("doc_id", "block", "chunk")), pa.array(tokens, pa.binary())], ["rep", "block", "chunk", "tokens"])

    return run


def _open(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("rep").to_numpy()
        side = rows.column("side").to_numpy() if "side" in rows.column_names else np.zeros(len(ids), np.int64)
        known = rows.column("root").to_numpy() if "root" in rows.column_names else None
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in rows.column("tokens").chunks for x in c]
        links = np.array(matrix_links(sets, side, percent, known), np.int64).reshape(-1, 2)
        return pa.table({"a": ids[links[:, 0]], "b": ids[links[:, 1]]})

    return run


def _node(set1: str, cls: Column) -> Column:
    """A set as a member of a size class."""
    return F.xxhash64(set1, cls)


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows (rep, ...) joined with table (one row a key); a key of many rows is dealt over salts."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def _shares() -> Column:
    """How many chunks a group's sets (of n shingles) make."""
    return F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / CHUNK_SHINGLES)).cast("int")


def _at_home(several: DataFrame, buckets: DataFrame) -> DataFrame:
    """several, sets of blocks with many chunks, with their chunk: sets whose most common signature is the same come together."""
    home = buckets.join(several.select("set1", "cls", "rep", "block"), ["set1", "cls"]).groupBy("rep", "block").agg(F.max_by("sig", F.struct("bucket", "sig")).alias("home"))
    rows = stage(several.join(home, ["rep", "block"], "left").withColumn("home", F.coalesce("home", F.xxhash64("rep"))), "homes")
    large = rows.groupBy("block", "home").agg(_shares().alias("parts")).where("parts > 1")
    few = F.pmod(F.xxhash64("home"), 2 * F.col("chunks"))
    return rows.join(large, ["block", "home"], "left").withColumn("chunk", F.when(F.col("parts") > 1, F.xxhash64("home", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")))).otherwise(few)).select("rep", "set1", "cls", "n", "block", "chunk")


def _across(sets: DataFrame, bodies: DataFrame, buckets: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links between chunks (a, b), given all sets (rep, set1, cls, n, block, chunk) of blocks with several chunks, and the components within chunks."""
    opened = _open(percent)
    tokens = bodies.select("rep", "block", "tokens")
    links, edges, before = [], roots.select(F.col("id").alias("a"), F.col("root").alias("b")), None
    seed = 3
    while True:
        known = stage(sets.join(roots, F.col("rep") == F.col("id"), "left").withColumn("root", F.coalesce("root", "rep")).drop("id"), "known")
        of_block = known.groupBy("block").agg(F.count("*").alias("all"), F.count_distinct("root").alias("different")).where("different > 1 and 4 * different <= all").select("block")
        first = Window.partitionBy("block", "root").orderBy(F.desc("n"), "rep")
        heads = stage(known.join(of_block, "block", "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("rep", "n", "block"), "heads")
        count = heads.count()
        if count == 0 or before is not None and count > 0.75 * before:
            break
        before, seed = count, seed + 1
        dealt = _looked_up(heads, heads.groupBy("block").agg(_shares().alias("chunks")), "block").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(seed)), F.col("chunks")))
        links.append(stage(dealt.join(tokens, ["rep", "block"]).select("block", "chunk", "rep", "tokens").groupBy("block", "chunk").applyInArrow(opened, "a long, b long"), "head-links"))
        edges = edges.union(links[-1])
        roots = stage(components(edges), "roots")
    # every set out of the block's largest component visits where a set of another component has a signature of it
    open_ = known.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("block")
    known = stage(known.join(open_, "block", "left_semi"), "open")
    main = known.groupBy("block", "root").count().groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    signed = stage(buckets.select("sig", "set1", "cls").join(_looked_up(known, main, "block"), ["set1", "cls"]).select("sig", "rep", "n", "block", "chunk", "root", "main"), "signed")
    targets = signed.groupBy("sig", "block", F.col("chunk").alias("to")).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    visits = signed.where("root <> main").join(targets, ["sig", "block"]).where("chunk <> to and (low <> root or high <> root)").select("rep", "block", F.col("to").alias("chunk"), "root", "n").distinct()
    visits = stage(visits, "visits")
    batches = stage(visits.groupBy("block", "chunk").agg(_shares().alias("batches")), "batches")
    guests = visits.join(batches, ["block", "chunk"]).withColumn("batch", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("batches")).cast("int")).withColumn("side", F.lit(2))
    hosts = known.join(batches, ["block", "chunk"]).withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1))).withColumn("side", F.lit(1))
    columns = ["block", "chunk", "batch", "rep", "root", "side"]
    met = guests.select(*columns).union(hosts.select(*columns)).join(tokens, ["rep", "block"])
    links.append(met.groupBy("block", "chunk", "batch").applyInArrow(opened, "a long, b long"))
    return functools.reduce(DataFrame.union, links)


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) for each row of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    ids = stage(in_arrow(docs, _identify(k, percent), "doc_id long, n_shingles long, set1 long, set2 long, cls int"), "sets")
    signed = in_arrow(docs, _sign(k, percent, common_shingles(docs, k)), "sig long, set1 long, n int, cls int")
    # sets that share a signature, each with its neighbours by size
    w = Window.partitionBy("sig").orderBy("n", "set1")
    near = signed.withColumn("p", F.lag("set1").over(w)).withColumn("pn", F.lag("n").over(w)).withColumn("f", F.lead("set1").over(w)).where("p <> set1 or f <> set1")
    buckets = stage(near.withColumn("bucket", F.count("*").over(Window.partitionBy("sig"))).select("sig", "set1", "cls", "n", "bucket", "p", "pn"), "buckets")
    edges = buckets.where(f"p <> set1 and 100 * pn >= {percent} * n").select(_node("set1", F.col("cls")).alias("a"), _node("p", F.col("cls")).alias("b"))
    blocks = stage(components(edges).select(F.col("id").alias("node"), F.col("root").alias("block")), "blocks")
    one = stage(ids.where("n_shingles > 0").groupBy("set1", "set2").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("cls").alias("cls")).where("rep is not null"), "classes")
    members = one.withColumn("cls", F.explode(F.array("cls", F.col("cls") + 1))).withColumn("node", _node("set1", F.col("cls"))).join(blocks, "node").select("rep", "set1", "cls", "n", "block")
    members = stage(_looked_up(members, members.groupBy("block").agg(_shares().alias("chunks")), "block"), "members")
    several = members.where("chunks > 1")
    sets = None if several.isEmpty() else stage(_at_home(several, buckets), "dealt")
    placed = members.where("chunks = 1").select(F.col("rep").alias("doc_id"), "set1", "block", F.lit(0).cast("long").alias("chunk"))
    if sets is not None:
        placed = placed.union(sets.select("rep", "set1", "block", "chunk"))
    bodies = stage(in_arrow(docs.join(placed.hint("shuffle_hash"), "doc_id"), _bodies(k), "rep long, block long, chunk long, tokens binary"), "bodies")
    links = stage(bodies.groupBy("block", "chunk").applyInArrow(_open(percent), "a long, b long"), "links")
    roots = stage(components(links), "roots")
    if sets is not None:
        more = stage(_across(sets, bodies, buckets, roots, percent), "more")
        roots = stage(components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(more)), "roots")
    named = one.join(roots, F.col("rep") == F.col("id"), "left").select("set1", "set2", F.coalesce("root", "rep").alias("component_id"))
    found = ids.join(named, ["set1", "set2"], "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(load(spark, sf_dir, "documents"), k=4, percent=85)

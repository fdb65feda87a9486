"""Shared pieces of the training-data operators: stage tables, hashing of words, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python task holds as 64-bit arrays at once.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: ASCII white space of the contracts: x20 and x09 to x0D.
SPACE = "[\\x20\\x09-\\x0D]+"

_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"
    return f"{root.rstrip('/')}/lumenlog"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends here, and a lost executor costs only unread files."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    spark._jvm.System.gc()  # Spark deletes shuffle files once the driver has collected what refers to them
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that stage() gave, whose readers are done; what is built on it must be staged by then."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = next((i for i, (_, p) in enumerate(_MADE) if p.rstrip("/").rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]), None)
        if at is not None:
            spark, made = _MADE.pop(at)
            p = spark._jvm.org.apache.hadoop.fs.Path(made)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete the stage tables of this driver; called at exit, and safe to call once their readers are done."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone at exit; the folder is the cluster's to clean then
            return


atexit.register(release)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hot_keys(df: DataFrame, col: str, least: int, tracked: int = 20_000) -> list[int]:
    """Keys of df that more than `least` rows may hold, from a frequency sketch of bounded size (at most 500 keys).

    The sketch only chooses the plan of a key; callers get the same rows whichever keys it names.
    """
    row = df.agg(F.expr(f"approx_top_k({col}, 500, {tracked})").alias("top")).first()
    return [x["item"] for x in (row["top"] or []) if x["item"] is not None and x["count"] > least]


#: Edges that a task contracts at once.
EDGES = 500_000


def gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of `most` rows or a little more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= most:
            yield held
            held, n = [], 0
    if n:
        yield held


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of up to `EDGES` rows as stars around the smallest id of each of their components: fewer rounds, the same components."""
    for part in gathered(batches, EDGES):
        ids, at = np.unique(np.concatenate([x.column(c).to_numpy() for c in (0, 1) for x in part]), return_inverse=True)
        x, y = at[: len(at) // 2], at[len(at) // 2 :]
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        far = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (id, root), root the smallest id reachable.

    Edges become stars within the tasks that find them, then within tasks of `EDGES` edges each for as
    long as a quarter goes. Alternating large-star and small-star steps on staged tables follow until
    nothing changes. Minima are combined before they are sent; a hub's neighbours are rows of its join,
    which Spark splits where skewed.
    """
    e = stage(in_arrow(edges.where("a <> b").select("a", "b"), _contract, "u long, v long"), "edges")
    left = e.count()
    while left:
        tasks, before = -(-left // EDGES), left
        e = stage(in_arrow(e.coalesce(tasks), _contract, "u long, v long"), "edges")
        left = e.count()
        if tasks == 1 or 4 * left > 3 * before:
            break
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        m = F.least("u", "m")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), m.alias("v")).distinct()
        least2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = stage(small, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root")
    return roots.union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


# ---- hashing of words in numpy -------------------------------------------------

_RNG = np.random.default_rng(20_240_917)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _WBASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so invertible modulo 2**64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finalizer over uint64."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = tuple(out)
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # a long text goes through in pieces
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + 2 * SLICE_BYTES, "right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        pw, inv = _powers(_BASE, b - a)
        c = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * pw, out=c[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((c[e] - c[s]) * inv[s], 1)
        lo = hi
    return out


class Words:
    """The words of some texts as flat arrays: hash, byte range, and first[i]:first[i + 1] of text i."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        off = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        buf = texts.buffers()[2] if len(texts) else None
        raw = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        self.raw = raw
        data = LOWER[raw] if lower else raw
        word = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[off] = True  # a text's end also ends its last word
        at = np.flatnonzero(edge[:-1])
        begin = at[word[at]] if len(at) else at
        stop = np.append(at[1:], len(data))[word[at]] if len(at) else at
        self.start, self.end = begin, stop
        self.hash = _word_hashes(data, begin, stop)
        self.first = np.searchsorted(begin, off)
        self.text_at = off

    def grams(self, k: int, seed: int = 2) -> np.ndarray:
        """Hash of the k words from each word on; only those within a text make sense."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.uint64)
        pw, inv = _powers(_WBASE, n + 1)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((self.hash if seed == 2 else mix(self.hash, seed)) * pw[:n], out=c[1:])
        return mix((c[k:] - c[:-k]) * inv[: n - k + 1], seed)


def slices(batch: pa.RecordBatch, col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of batch with about `most` bytes in col; a longer value comes alone."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(col)), 0), np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tidied(f):
    """f, a function of mapInArrow, that gives its memory back when it is done: Spark keeps Python workers for the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) with batches of bounded size, since JVM and worker hold a batch each, next to the heap; f's memory is given back.

    The session's own limits stay where they are lower.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(tidied(f), schema)


def filled(col: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.fill_null(col, "")

"""Operator 13, target-distribution importance resampling over hashed n-grams, by CRC combination algebra.

Documents are drawn so that their hashed n-grams follow a target's. A feature is a run of one to `most`
consecutive words, joined by one space; its bucket is its crc32 modulo `buckets`. The steps:

1. *Words.* The crc of each word of a batch is computed once, for all words together, a byte place at a time.
2. *Composition.* crc32(A B) is M^|B| crc32(A) xor crc32(B), where M is the 32 x 32 matrix over GF(2) that
   appends one zero byte. The powers M^1, M^2, M^4, ... are made by squaring, and each is applied as four
   tables of 256 entries. An n-gram's crc comes from the crc of the first n - 1 words and that of " " with
   the last word; no n-gram is ever spelt out.
3. *Counts.* Tasks count buckets in an array and send one row for each bucket they have seen. The summed
   tables, of `buckets` rows, give the gains.
4. *Weights.* A document's weight is the floored mean of its features' gains. Gumbel noise from a hash of
   its doc_id makes the draw of the highest scores a weighted draw without replacement.
5. *Draw.* Scores are put in order by range partitions, and a row's rank is its place in its partition plus
   the rows of the partitions before it.

Nulls and texts without words have no features and weight 0. Documents of fewer than `least_words` words are
scored and never drawn. Rows with one doc_id and text are scored and drawn each. Ties go to the smaller doc_id;
a null doc_id has no score and is not drawn. Empty documents give no rows; an empty target counts nothing,
and so favours rare buckets. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import LOWER, filled, in_arrow, load, slices, stage
from lumenlog.llm.spelling import A_Z, CRC_SQL, crc_of

BUCKETS, LEAST_WORDS, SEED = 10_000, 20, 2024
#: Words longer than this are hashed by zlib, one at a time.
SHORT = 48

_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _byte_table() -> np.ndarray:
    """The crc register after one byte, for each byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _byte_table()


def _applied(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A matrix over GF(2), as tables of its four byte columns, times each vector of x."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _shifts() -> list[np.ndarray]:
    """M^1, M^2, M^4, ... as tables: M appends one zero byte to what a crc stands for."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
    m = (one >> np.uint32(8)) ^ _TABLE[one & 255]
    out = [m]
    for _ in range(31):
        out.append(_applied(out[-1], out[-1]))
    return out


_SHIFT = _shifts()


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """M^size times each crc."""
    out, bit = crc.copy(), 0
    while len(size) and (size >> bit).any():
        at = np.flatnonzero(size >> bit & 1)
        out[at] = _applied(_SHIFT[bit], out[at])
        bit += 1
    return out


def combined(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc of each A B, from the crcs of A and B and the bytes of B."""
    return shifted(a, size) ^ b


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of each data[start:end]."""
    size = np.minimum(end - start, SHORT + 1)
    order = np.argsort(-size, kind="stable")
    by_size = size[order]
    long = int(np.searchsorted(-by_size, -SHORT, "left"))
    at, register = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    for i in range(int(by_size[long]) if long < len(by_size) else 0):
        n = int(np.searchsorted(-by_size, -i, "left"))  # words of more than i bytes
        x = register[long:n]
        register[long:n] = (x >> 8) ^ _TABLE[(x ^ data[at[long:n] + i]) & 255]
    out = np.empty(len(order), np.uint32)
    out[order] = ~register
    raw = data.tobytes() if long else b""
    for i in order[:long].tolist():
        out[i] = zlib.crc32(raw[start[i] : end[i]])
    return out


class Grams:
    """Features of some texts: bucket and text of each, and the number of words of each text."""

    def __init__(self, texts: pa.Array, most: int, buckets: int):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]] if n and off[-1] > off[0] else np.zeros(0, np.uint8)
        off = off - off[0]
        data = LOWER[raw]
        word = _WORD[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[off] = True
        at = np.flatnonzero(edge[:-1])
        start, end = at[word[at]], np.append(at[1:], len(data))[word[at]]
        self.words = np.diff(np.searchsorted(start, off))
        text = np.repeat(np.arange(n), self.words)
        own = word_crcs(data, start, end)
        crc, at, found, owner = own, np.arange(len(own)), [own], [text]
        size = end - start
        spaced = combined(np.full(len(own), zlib.crc32(b" "), np.uint32), own, size)  # the crc of " word"
        for k in range(1, most):
            at = at[at + k < len(text)]
            at = at[text[at] == text[at + k]]
            full = np.zeros(len(text), np.uint32)
            full[at] = combined(crc[at], spaced[at + k], size[at + k] + 1)
            crc = full
            found.append(crc[at])
            owner.append(text[at])
        self.bucket = (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)
        self.text = np.concatenate(owner)


def _counted(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in slices(b, "text"):
                n += np.bincount(Grams(filled(x.column("text")), most, buckets).bucket, minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often features of texts (text) fall into each bucket that has any."""
    return in_arrow(texts.select("text"), _counted(most, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in target against its share in docs, both smoothed by one."""
    of_docs = bucket_counts(docs, most, buckets).withColumnRenamed("n", "s")
    of_target = bucket_counts(target, most, buckets).withColumnRenamed("n", "t")
    both = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(of_docs, "bucket", "left").join(of_target, "bucket", "left").na.fill(0)
    rows = sorted(both.collect())  # one row for each bucket
    total_s, total_t = sum(r["s"] for r in rows), sum(r["t"] for r in rows)
    s, t = (np.array([r[c] for r in rows], np.float64) for c in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (total_s + buckets) / ((s + 1) * (total_t + buckets)))).astype(np.int64)


def _weighed(gain: np.ndarray, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in slices(b, "text"):
                g = Grams(filled(x.column("text")), most, len(gain))
                n = np.bincount(g.text, minlength=x.num_rows)
                total = np.zeros(x.num_rows, np.int64)
                np.add.at(total, g.text, gain[g.bucket])
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), *map(pa.array, (n, g.words, total // np.maximum(n, 1)))], ["doc_id", "n_features", "n_words", "weight"])

    return run


def in_order(rows: DataFrame, *by) -> DataFrame:
    """rows with rank, their place 1, 2, 3, ... in the order of `by`: range partitions, and the rows of those before each.

    The sorted rows are staged, so that counts and places are of the same partitions whatever is computed again.
    """
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())
    placed = stage(placed.withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)), "ordered")
    before, start = [], 0
    for part, n in sorted(placed.groupBy("part").count().collect()):  # one row for each partition
        before.append((part, start))
        start += n
    offsets = rows.sparkSession.createDataFrame(before, "part int, before long")
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at") + 1).drop("part", "at", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, most: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight, score and rank (null: not drawn) for each row of docs, against the texts of target."""
    scored = in_arrow(docs.select("doc_id", "text"), _weighed(gains(docs, target, most, buckets), most), "doc_id long, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    scored = stage(scored.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))), "scores")
    able = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = percent * scored.where(able).count() // 100
    ranked = in_order(scored.where(able), F.desc("score"), F.asc("doc_id")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("n_words")


SQL = {
    "op13_resampling": rf"""
WITH {CRC_SQL.strip()},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{A_Z.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{A_Z}', '{A_Z.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
bucket AS (SELECT word, {crc_of("word")} % 10000 AS b FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY b),
total AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
gain AS (SELECT b, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (total.s + 10000) / ((s.s + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b), total),
mean AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM dw JOIN bucket USING (word) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, len(w) AS n_features, coalesce(CASE WHEN g % n < 0 THEN g // n - 1 ELSE g // n END, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN mean USING (doc_id)),
noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS nth, count(*) OVER () AS n FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN nth <= 10 * n // 100 THEN nth END AS rank FROM noisy LEFT JOIN ranked USING (doc_id)
"""
}

"""Operator 11, spelling variant grouping: rare-first prefix filter over positional bigrams.

Two words are near if one inserted, deleted or replaced code point makes one of the other. The steps:

1. *Order.* All bigrams of the vocabulary are counted and ordered, rare ones first, ties by code.
2. *Prefix.* A word gives its three first bigrams in that order (then by place). One edit destroys at
   most two bigrams of either word, and the others keep their order; so the first one that survives
   is among the three of both words.
3. *Limits.* A surviving bigram lies before the edit or after it. Before: places are equal, and so is all
   of the word up to and with the bigram. After: places counted from the end are equal, and so is the
   rest from the bigram on. What lies on the edit's side is halved, and the half without the edit is equal
   too. Each bigram so gives four keys, by the four places of the edit, made of the parts that must be
   equal. A shorter word is found by the keys that a longer one makes for a partner with one code point less.
4. *Verification.* Pairs with a common key are compared in full. Keys are 64-bit hashes, which only choose
   the pairs to compare.

A word's form is its near word of largest count, if that is at least `ratio` times its own; ties go to the
smallest in code-point order. Its root is where the forms end; counts grow with each step, so they do.

Words of under four code points may keep no bigram and are returned with no near words. Null words are
left out. The order table holds the `ORDERED` commonest bigrams (letters of one alphabet have fewer; the
rest come before them, by code): any order gives the same rows, a good one gives them sooner. Empty input
gives no rows, other columns are ignored, and rows that repeat a word are summed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import _BASE, _powers, in_arrow, load, mix, stage

RARE, LEAST, ORDERED = 3, 4, 100_000
A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Letters:
    """Code points of some words end to end: word i is code[first[i]:first[i + 1]]."""

    def __init__(self, words: pa.Array):
        got = words.to_pylist()
        self.size = np.fromiter(map(len, got), np.int64, len(got))
        self.first = np.append(0, np.cumsum(self.size))
        self.code = np.frombuffer("".join(got).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code, word, place) of each bigram."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        at = np.flatnonzero(word[1:] == word[:-1])
        return self.code[at] << 21 | self.code[at + 1], word[at], at - self.first[word[at]]


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, int] = {}
    for b in batches:
        for g, n in zip(*(x.tolist() for x in np.unique(Letters(b.column("word")).bigrams()[0], return_counts=True)), strict=True):
            seen[g] = seen.get(g, 0) + n
        if len(seen) > ORDERED:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["bigram", "n"])
            seen = {}
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["bigram", "n"])


def rarest(x: Letters, known: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, place) of each word's `RARE` first bigrams in the order that rank gives the sorted codes in `known`."""
    code, word, place = x.bigrams()
    if not len(code):
        return word, place
    at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
    found = known[at] == code if len(known) else np.zeros(len(code), bool)
    order = np.lexsort((place, code, np.where(found, rank[at] if len(rank) else 0, -1), word))
    nth = np.arange(len(order)) - np.searchsorted(word[order], word[order])
    first = order[nth < RARE]
    return word[first], place[first]


def keys(x: Letters, word: np.ndarray, place: np.ndarray, shorter: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, key): for each bigram the four keys that a partner with `shorter` fewer code points has as well."""
    n, first = x.size[word], x.first[word]
    size = n - shorter  # the partner's
    pw, inv = _powers(_BASE, len(x.code) + 1)
    c = np.append(np.uint64(0), np.cumsum(mix(x.code.astype(np.uint64), 11) * pw[: len(x.code)]))

    def part(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (c[first + hi] - c[first + lo]) * inv[first + lo]

    def key(kind: int, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """head code points from the start and tail from the end, by words of `size`."""
        return mix(mix(part(np.zeros_like(head), head), 12) + mix(part(n - tail, n), 13) * np.uint64(_BASE) + (size * 4 + kind).astype(np.uint64), 14)

    own = np.arange(len(word))
    out = []
    # the edit lies after the bigram: what follows is halved at q
    end = place + 2
    q = end + (size - end + 1) // 2
    ok = end <= size
    out += [(own[ok], key(0, np.minimum(q, n), 0 * q)[ok]), (own[ok], key(1, np.minimum(end, n), np.maximum(size - q, 0))[ok])]
    # the edit lies before it: in the partner the bigram stands `shorter` places earlier
    p = place - shorter
    q = p // 2
    ok = p >= 0
    out += [(own[ok], key(2, np.maximum(q, 0), np.clip(size - p, 0, n))[ok]), (own[ok], key(3, 0 * q, np.clip(size - q, 0, n))[ok])]
    at = np.concatenate([a for a, _ in out])
    return word[at], np.concatenate([k for _, k in out])


def _keyed(known: np.ndarray, rank: np.ndarray, partners: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = Letters(b.column("word"))
            word, place = rarest(x, known, rank)
            for shorter in partners:
                own, key = keys(x, word, place, shorter)
                at = np.unique(np.stack([own, key.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at[1]), b.column("word").take(pa.array(at[0])), b.column("n").take(pa.array(at[0])), pa.array(np.full(at.shape[1], shorter, np.int8))], ["key", "word", "n", "shorter"])

    return run


def near_words(words: DataFrame) -> DataFrame:
    """Rows (word, n, near, near_n) for each word of words (word, n) and each of its near words."""
    long = words.where(F.length("word") >= LEAST)
    counted = in_arrow(long, _bigram_counts, "bigram long, n long").groupBy("bigram").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "bigram").limit(ORDERED).collect()  # of one alphabet, so a bounded table
    known = np.array(sorted(r["bigram"] for r in top), np.int64)
    rank = np.zeros(len(known), np.int64)
    rank[np.searchsorted(known, np.array([r["bigram"] for r in top], np.int64))] = np.arange(len(top), 0, -1)
    schema = "key long, word string, n long, shorter byte"
    held = in_arrow(long, _keyed(known, rank, (0,)), schema).select("key", "word", "n")
    asked = in_arrow(long, _keyed(known, rank, (0, 1)), schema).select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "shorter")
    # of two words of one length, the smaller asks
    pairs = held.join(asked, "key").where("(shorter = 1 or other < word) and levenshtein(word, other, 1) = 1").select("word", "n", "other", "other_n").distinct()
    both = F.array(F.struct("word", "n", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(both).alias("x")).select("x.*")


def _roots(forms: DataFrame) -> DataFrame:
    """Where (word, form) ends: each round doubles the steps taken, so a chain takes the logarithm of its length."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stage(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of words (word, n)."""
    words = stage(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))  # strings compare by UTF-8 bytes, which is code-point order
    found = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = stage(found.select("word", "n_near", F.when(-F.col("best.less") >= F.col("n") * ratio, F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("x")), "near")
    roots = _roots(found.where("x is not null").select("word", "x.form"))
    return (
        words.join(found, "word", "left").join(roots, "word", "left")
        .select("word", "x.form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "x.form_n")
    )


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """word, n: the letter runs of docs (doc_id, text), A-Z in lower case, where each run whose crc32 with its doc_id
    `every` divides has lost one code point; those of at least `least_length` code points and `least_count` occurrences.

    A null text has no run; a null doc_id counts as an empty one.
    """
    lower = F.translate("text", A_Z, A_Z.lower())
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), 0)).alias("run"))
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    runs = runs.withColumn("h", h).withColumn("cut", F.when(F.col("h") % every == 0, (F.col("h") % F.length("run")).cast("int")))
    word = F.when(F.col("cut").isNull(), F.col("run")).otherwise(F.concat(F.expr("substring(run, 1, cut)"), F.expr("substring(run, cut + 2)")))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(load(spark, sf_dir, "documents")))


#: crc32 of a text's UTF-8 bytes: the table by its rule, then a fold over the bytes.
CRC_SQL = r"""
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)
"""


def crc_of(text: str) -> str:
    """SQL for crc32 of the text expression, where crc.t is at hand."""
    digit = "instr('123456789ABCDEF', {})"
    byte = f"16 * {digit.format('h[2 * i + 1]')} + {digit.format('h[2 * i + 2]')}"
    return (
        f"list_transform([hex({text})], lambda h: xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(length(h) // 2), lambda i: {byte})), "
        "lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1]))))[1]"
    )


SQL = {
    "op11_spelling": rf"""
WITH RECURSIVE {CRC_SQL.strip()},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{A_Z}', '{A_Z.lower()}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (SELECT run, {crc_of("doc_id::VARCHAR || ':' || run")} AS h FROM runs, crc WHERE length(run) >= 7),
got AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, count(*) AS n FROM got WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
near AS (SELECT x.word, y.word AS near FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
best AS (SELECT near.word, near.near, w.n, count(*) OVER (PARTITION BY near.word) AS n_near,
  row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near.near COLLATE "C") AS nth FROM near JOIN w ON near.near = w.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN near END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word AND nth = 1),
walk AS (SELECT word, word AS root FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NOT NULL),
last AS (SELECT walk.word, walk.root FROM walk JOIN f ON walk.root = f.word WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""
}

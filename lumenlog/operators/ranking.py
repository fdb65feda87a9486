"""Ranks of statements for a batch of cases: cosine, BM25, recency, judge, fusion.

Every rank is a total order with its full chain of ties, within query_id. Scores are rounded to nine
digits before they are compared, so that the order of a sum's terms can't change a rank. Ranks that
only feed a top list are cut by row_number() <= k, which Spark applies before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions import scoring as S
from lumenlog.functions.text import DOC_CLIP, clip, tokenize
from lumenlog.functions.vectors import dot
from lumenlog.operators import lexical
from lumenlog.operators.order import total_order
from lumenlog.sources.staging import staged

DIGITS = 9


def row_rank(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def corpus(statements: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searchable statements (with vec), and those without a vector, which are reported and never dropped silently."""
    first = embeddings.groupBy("id").agg(F.min_by("vec", "at").alias("vec")) if "at" in embeddings.columns else embeddings.dropDuplicates(["id"])
    return statements.join(first, "id"), statements.join(first.select("id"), "id", "left_anti")


def cosine(pairs: DataFrame) -> DataFrame:
    """pairs (query_id, id, qvec, vec) with cos, the inner product of unit vectors; vectors of different lengths are an error."""
    return pairs.withColumn("cos", F.round(dot(F.col("qvec"), F.col("vec")), DIGITS))


def emb_rank() -> Column:
    return row_rank(["query_id"], F.desc("cos"), F.asc("micros"), F.asc("id"))


def terms(texts: DataFrame) -> DataFrame:
    """(id, term, tf) and the length of each text with its clip applied."""
    t = texts.select("id", tokenize(clip(F.col("text"), DOC_CLIP)).alias("tokens"))
    return t.select("id", F.size("tokens").alias("len"), F.explode_outer("tokens").alias("term")).groupBy("id", "len", "term").agg(F.count("term").alias("tf"))


def bm25(visible: DataFrame, queries: DataFrame, statements: DataFrame) -> DataFrame:
    """visible pairs (query_id, id, ...) with bm25: zero where no term is shared.

    Document frequency, their number and average length are those of what the query may see; only pairs with a
    shared term are scored.
    """
    postings, lengths = lexical.index(statements)
    scored = lexical.scores(postings, lengths, queries, DIGITS)
    return visible.join(scored, ["query_id", "id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


def bm25_rank() -> Column:
    return row_rank(["query_id"], F.desc("bm25"), F.asc("id"))


def thread_rank(pairs: DataFrame) -> DataFrame:
    """pairs with thread_rank, newest first among the query's own thread; null elsewhere."""
    own = pairs.where(F.col("session_id") == F.col("thread_id")).select("query_id", "id", row_rank(["query_id"], F.desc("micros"), F.desc("id")).alias("thread_rank"))
    return pairs.join(own, ["query_id", "id"], "left")


def ranks(visible: DataFrame, queries: DataFrame, statements: DataFrame) -> DataFrame:
    """Visible pairs with cos, bm25, their places among all that their query sees by each, and thread_rank.

    No task holds all that one query sees: each order goes over range partitions.
    """
    scored = staged(bm25(cosine(visible).drop("qvec", "vec"), queries, statements), "scored")  # an order samples its rows first
    by_emb = total_order(scored, ["query_id"], F.desc("cos"), F.asc("micros"), F.asc("id"), name="emb_rank")
    return thread_rank(total_order(by_emb, ["query_id"], F.desc("bm25"), F.asc("id"), name="bm25_rank"))


def prefilter(ranked: DataFrame, emb: int = S.TOP_EMB, lexical: int = S.TOP_BM25, thread: int = S.TOP_THREAD) -> DataFrame:
    """The union of the three top lists; ranks stay those of the full history."""
    return ranked.where((F.col("emb_rank") <= emb) | (F.col("bm25_rank") <= lexical) | (F.coalesce(F.col("thread_rank"), F.lit(1 << 30)) <= thread))


def judge_rank() -> Column:
    """By probability, refused (null) last in embedding order."""
    return row_rank(["query_id"], F.col("p").desc_nulls_last(), F.asc("emb_rank"), F.asc("micros"), F.asc("id"))


def fuse(candidates: DataFrame, mode: str = "prompt") -> DataFrame:
    """Judge rank inside the prefilter, then weighted reciprocal-rank fusion and its order."""
    k, w = S.RRF_K[mode], S.WEIGHTS
    d = candidates.withColumn("judge_rank", judge_rank())
    rrf = S.reciprocal(F.col("emb_rank"), k, w["emb"]) + S.reciprocal(F.col("bm25_rank"), k, w["bm25"]) + S.reciprocal(F.col("judge_rank"), k, w["judge"])
    return d.withColumn("rrf", F.round(rrf, 12)).withColumn("rank", row_rank(["query_id"], F.desc("rrf"), F.asc("emb_rank"), F.asc("micros"), F.asc("id")))


def fill(ranked: DataFrame, pool: DataFrame, n: int = S.TOP_N) -> DataFrame:
    """ranked (query_id, id, score, rank) up to n rows a query, filled from pool (query_id, id, cos, emb_rank) below its lowest score."""
    head = ranked.where(F.col("rank") <= n)
    have = head.groupBy("query_id").agg(F.count("*").alias("have"), (F.min("score") - 1).alias("floor"))
    more = pool.join(head.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("k", row_rank(["query_id"], F.asc("emb_rank"))).where(F.col("k") <= n)
    more = more.join(have, "query_id", "left").select("query_id", "id", (F.coalesce("floor", F.lit(0.0)) + F.col("cos") * 1e-3).alias("score"), (F.coalesce("have", F.lit(0)) + F.col("k")).cast("int").alias("rank"))
    return head.select("query_id", "id", "score", "rank").unionByName(more.where(F.col("rank") <= n))


def head_reorder(ranked: DataFrame, keys: DataFrame, head: int) -> DataFrame:
    """The first `head` of each query in the order of keys (query_id, id, key), largest first, the tail as it was."""
    k = ranked.join(keys, ["query_id", "id"], "left")
    inside = F.col("rank") <= head
    order = row_rank(["query_id"], F.when(inside, 0).otherwise(1), F.when(inside, F.col("key")).desc_nulls_last(), F.asc("rank"))
    return k.withColumn("new_rank", order)


def mirrored_choice(choices: DataFrame, n: Column) -> DataFrame:
    """(query_id, slot, forward, backward) -> the mean of slot i forwards and slot n-1-i backwards."""
    back = choices.select("query_id", (n - 1 - F.col("slot")).alias("slot"), F.col("backward").alias("mirror"))
    return choices.join(back, ["query_id", "slot"]).withColumn("listwise", (F.col("forward") + F.col("mirror")) / 2)


def rrf_lists(lists: DataFrame, top: int = S.COMPOSE["hyde_top"], k: int = S.COMPOSE["hyde_k"]) -> DataFrame:
    """(query_id, list, id, micros, rank) -> fused (query_id, id, score, rank) over any number of lists."""
    fused = lists.where(F.col("rank") <= top).groupBy("query_id", "id", "micros").agg(F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12).alias("score"))
    return fused.withColumn("rank", row_rank(["query_id"], F.desc("score"), F.asc("micros"), F.asc("id")))


def hyde(visible: DataFrame, texts: DataFrame, ranked: DataFrame, top: int = S.COMPOSE["hyde_top"]) -> DataFrame:
    """Fused (query_id, id, score, rank) of the lists of a case's generated texts (query_id, texts: (list, hvec)) and its own two lists.

    A pair's inner products with all of its case's texts are taken in one row; lists are cut before they are fused.
    """
    pairs = visible.select("query_id", "id", "micros", "vec").join(texts, "query_id")
    each = pairs.select("query_id", "id", "micros", F.transform("texts", lambda t: F.struct(t["list"].alias("list"), F.round(dot(t["hvec"], F.col("vec")), DIGITS).alias("cos"))).alias("x"))
    each = each.select("query_id", "id", "micros", F.explode("x").alias("x")).select("query_id", "id", "micros", "x.list", "x.cos")
    near = each.withColumn("rank", row_rank(["query_id", "list"], F.desc("cos"), F.asc("micros"), F.asc("id"))).where(F.col("rank") <= top)
    own = [ranked.where(F.col(c) <= top).select("query_id", F.lit(name).alias("list"), "id", "micros", F.col(c).alias("rank")) for name, c in ((-1, "emb_rank"), (-2, "bm25_rank"))]
    return rrf_lists(near.select("query_id", "list", "id", "micros", "rank").union(own[0]).union(own[1]), top)


def with_durability(rows: DataFrame, durability: DataFrame) -> DataFrame:
    """rows with durable, the table's p of their id: null is a refusal, an id that the table lacks is an error."""
    held = durability.select("id", F.col("p").alias("durable"), F.lit(True).alias("known"))
    lack = F.raise_error(F.concat(F.lit("no durability for "), F.col("id").cast("string"))).cast("double")
    return rows.join(held, "id", "left").withColumn("durable", F.when(F.col("known"), F.col("durable")).otherwise(lack)).drop("known")

"""Ranked retrieval: the query plans over a batch of cases, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions import scoring as S
from lumenlog.functions.text import DOC_CLIP, clip, tokenize
from lumenlog.operators import eligibility, lexical, ranking, selection, sessions
from lumenlog.operators.order import total_order
from lumenlog.plans import stand_ins as T
from lumenlog.plans.catalog import query
from lumenlog.sources.staging import staged

_E, _M = T.EPOCH, T.MINUTE


def _base(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, searchable statements, and what each case may see, without texts.

    Statements are spread before they meet the cases: a row is sent once and used for every case.
    """
    cases = T.cases(spark, sf)
    corpus, _ = ranking.corpus(T.statements(spark, sf), T.embeddings(spark, sf))
    spread = corpus.drop("text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return cases, corpus, eligibility.visible(cases, spread)


def _judged(candidates: DataFrame, cases: DataFrame, statements: DataFrame) -> DataFrame:
    """candidates with the stand-in judge's p, from how many distinct tokens of five letters and more both texts have."""
    long = lambda c: F.array_distinct(F.filter(tokenize(c), lambda w: F.length(w) >= 5))
    held = candidates.join(statements.select("id", long(clip(F.col("text"), DOC_CLIP)).alias("held")), "id")
    both = held.join(cases.select("query_id", long(F.col("situation")).alias("asked")), "query_id")
    return both.withColumn("p", T.judge_p(F.size(F.array_intersect("held", "asked")))).drop("held", "asked")


# ---- the shared SQL: corpus, cosine, BM25, ranks, judge --------------------------

_DOT = "list_inner_product(list_transform({a}, lambda x: x::DOUBLE), list_transform({b}, lambda x: x::DOUBLE))"
CORPUS = f"""{T.STATEMENTS}, {T.CASES}, corpus AS (SELECT s.*, embedding AS vec FROM s JOIN embeddings ON vec_id = id),
v AS (SELECT c.*, corpus.* FROM c JOIN corpus ON micros < decision AND session_id <> exclude_session)"""
EMB = f"""{CORPUS}, e AS (SELECT *, round({_DOT.format(a='qvec', b='vec')}, 9) AS cos FROM v),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, micros, id) AS emb_rank FROM e)"""


def _bm25_sql(text: str) -> str:
    """Ranks by BM25 over the tokens of `text`, an expression over corpus."""
    return f"""{EMB}, tok AS (SELECT id, {T.tokens_sql(text)} AS tokens FROM corpus),
qt AS (SELECT query_id, unnest(list_distinct({T.tokens_sql('situation')})) AS term FROM c),
tf AS (SELECT id, len(tokens) AS len, term, count(*) AS tf FROM (SELECT id, tokens, unnest(tokens) AS term FROM tok) GROUP BY ALL), st AS (SELECT query_id, count(*) AS n, avg(len(tokens)) AS avg FROM er JOIN tok USING (id) GROUP BY query_id),
hit AS (SELECT er.query_id, er.id, tf.term, tf, len FROM er JOIN tf ON tf.id = er.id JOIN qt ON qt.query_id = er.query_id AND qt.term = tf.term),
df AS (SELECT query_id, term, count(*) AS df FROM hit GROUP BY ALL),
bs AS (SELECT hit.query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg))) AS score FROM hit JOIN df USING (query_id, term) JOIN st USING (query_id) GROUP BY ALL),
br AS (SELECT er.*, round(coalesce(score, 0), 9) AS bm25 FROM er LEFT JOIN bs USING (query_id, id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS bm25_rank,
  CASE WHEN session_id = thread_id THEN row_number() OVER (PARTITION BY query_id, session_id = thread_id ORDER BY micros DESC, id DESC) END AS thread_rank FROM br)"""


BM25 = _bm25_sql(T.clip_sql("text", 4000))
#: The same over whole texts.
BM25_WHOLE = _bm25_sql("text")
PREFILTER = f"""{BM25}, pf AS (SELECT * FROM r WHERE emb_rank <= 150 OR bm25_rank <= 60 OR thread_rank <= 30)"""
_LONG = f"unnest(list_distinct(list_filter({{x}}, lambda w: length(w) >= 5)))"
JUDGE = f"""{PREFILTER}, lq AS (SELECT query_id, {_LONG.format(x=T.tokens_sql('situation'))} AS term FROM c), ld AS (SELECT id, {_LONG.format(x='tokens')} AS term FROM tok),
sh AS (SELECT query_id, id, count(*) AS shared FROM lq JOIN ld USING (term) GROUP BY ALL),
j AS (SELECT pf.*, CASE WHEN (id + query_id) % 13 = 0 THEN NULL ELSE CASE WHEN coalesce(shared, 0) >= 2 THEN 0.99 ELSE 0.04 END - (id % 5) * 0.002 END::DOUBLE AS p FROM pf LEFT JOIN sh USING (query_id, id)),
jr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p DESC NULLS LAST, emb_rank, micros, id) AS judge_rank FROM j)"""
FUSED = f"""{JUDGE}, f AS (SELECT *, round(1.0::DOUBLE / (10 + emb_rank) + 1.0::DOUBLE / (10 + bm25_rank) + 2.0::DOUBLE / (10 + judge_rank), 12) AS rrf FROM jr),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, emb_rank, micros, id) AS rank FROM f)"""


@query("tokenize_counts", f"WITH {T.STATEMENTS}, t AS (SELECT id, unnest({T.tokens_sql(T.clip_sql('text', 4000))}) AS term FROM s) SELECT id, term, count(*) AS tf FROM t GROUP BY ALL")
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Term frequencies of every statement."""
    return ranking.terms(T.statements(spark, sf)).where("term is not null").select("id", "term", "tf")


@query("embedding_join_missing", f"WITH {T.STATEMENTS} SELECT host, count(vec_id) AS searchable, count(*) - count(vec_id) AS missing FROM s LEFT JOIN embeddings ON vec_id = id GROUP BY host")
def embedding_join_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Statements with and without a vector: none is lost."""
    have, lack = ranking.corpus(T.statements(spark, sf), T.embeddings(spark, sf))
    n = have.groupBy("host").agg(F.count("*").alias("searchable")).join(lack.groupBy("host").agg(F.count("*").alias("missing")), "host", "full_outer")
    return n.select("host", F.coalesce("searchable", F.lit(0)).alias("searchable"), F.coalesce("missing", F.lit(0)).alias("missing"))


@query("cosine_topk", f"WITH {EMB} SELECT query_id, id, round(cos, 6) AS cos, emb_rank::INT AS emb_rank FROM er WHERE emb_rank <= 50 AND cos >= 0.1")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Plan `embeddings`: the 50 nearest, those at the bar."""
    _, _, visible = _base(spark, sf)
    top = ranking.cosine(visible).withColumn("emb_rank", ranking.emb_rank()).where(F.col("emb_rank") <= S.TOP_N)
    return selection.gate(top, "cos", 0.1).select("query_id", "id", F.round("cos", 6).alias("cos"), "emb_rank")


def _index(spark: SparkSession, sf: str, most: int | None = DOC_CLIP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, and postings and lengths of the searchable statements."""
    corpus, _ = ranking.corpus(T.statements(spark, sf), T.embeddings(spark, sf))
    return T.cases(spark, sf), *lexical.index(corpus, most)


@query("bm25_docfreq", f"WITH {BM25_WHOLE} SELECT query_id, term, df FROM df")
def bm25_docfreq(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency of each query term among the whole texts that the query may see, from prefix counts of the index."""
    cases, postings, lengths = _index(spark, sf, most=None)
    return lexical.document_frequency(lexical.statistics(postings, lengths, cases))


@query("bm25_statistics", f"WITH {BM25} SELECT query_id, n, round(avg, 9) AS avg FROM st")
def bm25_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Number and average length of what each query may see, as of its decision."""
    cases, postings, lengths = _index(spark, sf)
    return lexical.statistics(postings, lengths, cases).where("term = '' and n > 0").select("query_id", "n", F.round(F.col("total") / F.col("n"), 9).alias("avg"))


@query("bm25_topk", f"WITH {BM25_WHOLE} SELECT query_id, id, round(bm25, 6) AS bm25, bm25_rank::INT AS bm25_rank FROM r WHERE bm25_rank <= 60")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The 60 best by BM25 over whole texts: only statements that share a term with a case meet it, unless those are too few."""
    cases, postings, lengths = _index(spark, sf, most=None)
    scored = lexical.scores(postings, lengths, cases)
    return lexical.top(staged(scored, "bm25"), cases, lengths, S.TOP_BM25).select("query_id", "id", F.round("bm25", 6).alias("bm25"), "bm25_rank")


@query("full_ranks", f"WITH {BM25} SELECT query_id, id, emb_rank::INT AS emb_rank, bm25_rank::INT AS bm25_rank, row_number() OVER (PARTITION BY query_id ORDER BY micros DESC, id DESC)::INT AS recency_rank FROM r")
def full_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Every visible pair's place by embedding, BM25 and recency."""
    cases, corpus, visible = _base(spark, sf)
    ranked = total_order(ranking.ranks(visible, cases, corpus), ["query_id"], F.desc("micros"), F.desc("id"), name="recency_rank")
    return ranked.select("query_id", "id", "emb_rank", "bm25_rank", "recency_rank")


@query("prefilter_union", f"WITH {PREFILTER} SELECT query_id, id, emb_rank::INT AS emb_rank, bm25_rank::INT AS bm25_rank, thread_rank::INT AS thread_rank FROM pf")
def prefilter_union(spark: SparkSession, sf: str) -> DataFrame:
    cases, corpus, visible = _base(spark, sf)
    return ranking.prefilter(ranking.ranks(visible, cases, corpus)).select("query_id", "id", "emb_rank", "bm25_rank", "thread_rank")


def _fused(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    cases, corpus, visible = _base(spark, sf)
    ranked = ranking.ranks(visible, cases, corpus)
    return ranking.fuse(_judged(ranking.prefilter(ranked), cases, corpus)), ranked, cases


@query("rrf_default", f"WITH {FUSED} SELECT query_id, id, round(rrf, 9) AS rrf, rank::INT AS rank, emb_rank::INT AS emb_rank, bm25_rank::INT AS bm25_rank, judge_rank::INT AS judge_rank FROM fr WHERE rank <= 50")
def rrf_default(spark: SparkSession, sf: str) -> DataFrame:
    """Plan `default`: prefilter, judge, weighted reciprocal-rank fusion, the best 50."""
    fused, _, _ = _fused(spark, sf)
    return fused.where(F.col("rank") <= S.TOP_N).select("query_id", "id", F.round("rrf", 9).alias("rrf"), "rank", "emb_rank", "bm25_rank", "judge_rank")


@query("rrf_refused_last", f"WITH {JUDGE} SELECT query_id, count(*) AS items, count(*) - count(p) AS refused, min(CASE WHEN p IS NULL THEN judge_rank END)::INT AS first_refused, max(CASE WHEN p IS NOT NULL THEN judge_rank END)::INT AS last_answered FROM jr GROUP BY query_id")
def rrf_refused_last(spark: SparkSession, sf: str) -> DataFrame:
    fused, _, _ = _fused(spark, sf)
    p = F.col("p").isNull()
    return fused.groupBy("query_id").agg(F.count("*").alias("items"), F.count_if(p).alias("refused"), F.min(F.when(p, F.col("judge_rank"))).alias("first_refused"), F.max(F.when(~p, F.col("judge_rank"))).alias("last_answered"))


@query(
    "fill_from_embeddings",
    f"""WITH {FUSED}, h AS (SELECT query_id, id, rrf AS score, rank FROM fr WHERE p >= 0.95 AND rank <= 50), hn AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM h),
  have AS (SELECT query_id, count(*) AS have, min(score) - 1 AS floor FROM hn GROUP BY ALL),
  m AS (SELECT er.query_id, er.id, cos, row_number() OVER (PARTITION BY er.query_id ORDER BY emb_rank) AS k FROM er WHERE NOT EXISTS (SELECT 1 FROM hn WHERE hn.query_id = er.query_id AND hn.id = er.id))
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM hn UNION ALL
SELECT m.query_id, id, round(coalesce(floor, 0) + cos * 0.001, 6), (coalesce(have, 0) + k)::INT FROM m LEFT JOIN have USING (query_id) WHERE coalesce(have, 0) + k <= 50""",
)
def fill_from_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """What passes the gate, filled up to 50 from the embedding order below it."""
    fused, ranked, _ = _fused(spark, sf)
    head = selection.gate(fused.where(F.col("rank") <= S.TOP_N), "p", S.PROMPT_GATE).withColumn("rank", ranking.row_rank(["query_id"], F.asc("rank")))
    out = ranking.fill(head.withColumn("score", F.col("rrf")), ranked)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "listwise_mirror",
    f"""WITH {FUSED}, h AS (SELECT *, least(24, count(*) OVER (PARTITION BY query_id)) AS n FROM fr WHERE rank <= 50), hd AS (SELECT query_id, id, rank, n, rank - 1 AS slot, ((id * 7 + query_id) % 101) / 101.0::DOUBLE AS fw, ((id * 13 + query_id) % 89) / 89.0::DOUBLE AS bw FROM h WHERE rank <= n),
  lw AS (SELECT a.query_id, a.id, (a.fw + b.bw) / 2 AS listwise FROM hd a JOIN hd b ON a.query_id = b.query_id AND b.slot = a.n - 1 - a.slot)
SELECT h.query_id, h.id, round(round(listwise, 9), 6) AS listwise, row_number() OVER (PARTITION BY h.query_id ORDER BY CASE WHEN rank <= 24 THEN 0 ELSE 1 END, CASE WHEN rank <= 24 THEN round(listwise, 9) END DESC NULLS LAST, rank)::INT AS new_rank FROM h LEFT JOIN lw ON lw.query_id = h.query_id AND lw.id = h.id""",
)
def listwise_mirror(spark: SparkSession, sf: str) -> DataFrame:
    """Plan `default+listwise`: the first 24 reordered by a choice asked forwards and backwards."""
    fused, _, _ = _fused(spark, sf)
    base = fused.where(F.col("rank") <= S.TOP_N).select("query_id", "id", "rank")
    h = base.withColumn("n", F.least(F.lit(24), F.count("*").over(Window.partitionBy("query_id"))).cast("int")).where(F.col("rank") <= 24)
    slots = h.select("query_id", "id", "n", (F.col("rank") - 1).alias("slot"), (((F.col("id") * 7 + F.col("query_id")) % 101) / 101.0).alias("forward"), (((F.col("id") * 13 + F.col("query_id")) % 89) / 89.0).alias("backward"))
    keys = ranking.mirrored_choice(slots, F.col("n")).select("query_id", "id", F.round("listwise", 9).alias("key"))
    return ranking.head_reorder(base, keys, 24).select("query_id", "id", F.round("key", 6).alias("listwise"), "new_rank")


@query(
    "rerank_head_tail",
    f"""WITH {FUSED}, h AS (SELECT query_id, id, rank FROM fr WHERE rank <= 50), k AS (SELECT *, CASE WHEN rank <= 20 THEN (id * 31) % 97 END AS key FROM h),
n AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 20 THEN 0 ELSE 1 END, key DESC NULLS LAST, rank)::INT AS new_rank, least(20, count(*) OVER (PARTITION BY query_id)) AS top FROM k)
SELECT query_id, id, new_rank, CASE WHEN new_rank <= 20 THEN top - new_rank + 1 ELSE 20 - new_rank END::INT AS score FROM n""",
)
def rerank_head_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Plan `default+rerank`: a complete permutation of the first 20, the tail below it."""
    fused, _, _ = _fused(spark, sf)
    base = fused.where(F.col("rank") <= S.TOP_N).select("query_id", "id", "rank")
    keys = base.where(F.col("rank") <= 20).select("query_id", "id", ((F.col("id") * 31) % 97).alias("key"))
    out = ranking.head_reorder(base, keys, 20).withColumn("top", F.least(F.lit(20), F.count("*").over(Window.partitionBy("query_id"))))
    return out.select("query_id", "id", "new_rank", F.when(F.col("new_rank") <= 20, F.col("top") - F.col("new_rank") + 1).otherwise(20 - F.col("new_rank")).cast("int").alias("score"))


# The stand-ins for the eight generated texts have vectors of the table, other ones for each case.
HYDE = f"""hy AS (SELECT er.query_id, l AS list, er.id, er.micros, row_number() OVER (PARTITION BY er.query_id, l ORDER BY round({_DOT.format(a='h.embedding', b='er.vec')}, 9) DESC, er.micros, er.id) AS rank
    FROM er, unnest([0, 1, 2, 3, 4, 5, 6, 7]) t(l) JOIN embeddings h ON h.vec_id = (er.query_id * 8 + l) * 7 % (SELECT max(vec_id) + 1 FROM embeddings)),
  al AS (SELECT query_id, list, id, micros, rank FROM hy UNION ALL SELECT query_id, 8, id, micros, emb_rank FROM r UNION ALL SELECT query_id, 9, id, micros, bm25_rank FROM r),
  fu AS (SELECT query_id, id, micros, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM al WHERE rank <= 1000 GROUP BY ALL), fk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, micros, id) AS rank FROM fu)"""


def _hyde(spark: SparkSession, sf: str, cases: DataFrame, visible: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, id, score, rank): the eight generated texts' lists fused with the embedding and BM25 lists."""
    e = T.embeddings(spark, sf)
    n = e.agg(F.max("id") + 1).first()[0] or 1
    h = cases.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("list")).withColumn("vec_id", (F.col("query_id") * 8 + F.col("list")) * 7 % n)
    h = h.join(e.select(F.col("id").alias("vec_id"), F.col("vec").alias("hvec")), "vec_id").groupBy("query_id").agg(F.collect_list(F.struct("list", "hvec")).alias("texts"))
    return ranking.hyde(visible, h, ranked)


@query("hyde_multilist_rrf", f"WITH {BM25}, {HYDE} SELECT query_id, id, round(score, 8) AS score, rank::INT AS rank FROM fk WHERE rank <= 300")
def hyde_multilist_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Eight generated texts' lists with the embedding and BM25 lists, fused."""
    cases, corpus, visible = _base(spark, sf)
    fused = _hyde(spark, sf, cases, visible, ranking.ranks(visible, cases, corpus))
    return fused.where(F.col("rank") <= S.COMPOSE["hyde"]).select("query_id", "id", F.round("score", 8).alias("score"), "rank")


# ---- sessions and composed plans ------------------------------------------------

_NODE_P = "CASE WHEN (start + session_id * 5 + query_id) % 17 = 0 THEN NULL ELSE ((start * 3 + session_id * 11 + query_id * 7) % 100) / 100.0::DOUBLE END"
NODES = f"""ch AS (SELECT *, ((row_number() OVER (PARTITION BY query_id, session_id ORDER BY micros, id) - 1) // 24 * 24)::INT AS start FROM r),
nd AS (SELECT query_id, session_id, start, count(*) AS members, min(emb_rank) AS best, {_NODE_P} AS node_p FROM ch GROUP BY query_id, session_id, start),
nk AS (SELECT *, CASE WHEN node_p IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY node_p DESC NULLS LAST, best, session_id, start) END AS node_rank FROM nd)"""


def _node_p() -> object:
    s, x, q = F.col("start"), F.col("session_id"), F.col("query_id")
    return F.when((s + x * 5 + q) % 17 == 0, None).otherwise(((s * 3 + x * 11 + q * 7) % 100) / 100.0)


def _routed(ranked: DataFrame) -> DataFrame:
    """Ranked items with their node's probability and rank."""
    c = ranked.withColumn("start", (F.floor((F.row_number().over(Window.partitionBy("query_id", "session_id").orderBy("micros", "id")) - 1) / sessions.CHUNK) * sessions.CHUNK).cast("int"))
    n = c.groupBy("query_id", "session_id", "start").agg(F.min("emb_rank").alias("emb_rank")).withColumn("node_p", _node_p())
    n = n.withColumn("node_rank", sessions.node_rank()).drop("emb_rank")
    return c.join(n, ["query_id", "session_id", "start"])


@query(
    "sessions_rank",
    f"""WITH {JUDGE}, {NODES}, it AS (SELECT ch.query_id, ch.id, ch.emb_rank, node_p, node_rank, count(*) OVER (PARTITION BY ch.query_id) AS n, CASE WHEN (ch.id + ch.query_id) % 13 = 0 THEN NULL ELSE CASE WHEN coalesce(shared, 0) >= 2 THEN 0.99 ELSE 0.04 END - (ch.id % 5) * 0.002 END::DOUBLE AS p
  FROM ch JOIN nk USING (query_id, session_id, start) LEFT JOIN sh ON sh.query_id = ch.query_id AND sh.id = ch.id),
  sc AS (SELECT *, round(CASE WHEN node_rank <= 32 AND p IS NOT NULL THEN 0.75::DOUBLE * (p + node_p) / 2 + 0.25::DOUBLE / log2(emb_rank + 1) ELSE -1 - emb_rank / (n + 1)::DOUBLE END, 9) AS score FROM it), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, emb_rank) AS rank FROM sc)
SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank, node_rank::INT AS node_rank FROM o WHERE rank <= 50""",
)
def sessions_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Plan `sessions`: nodes are judged first, the best 32 are opened and their items judged."""
    cases, corpus, visible = _base(spark, sf)
    items = _judged(_routed(ranking.ranks(visible, cases, corpus)), cases, corpus)
    out = sessions.item_scores(items, F.count("*").over(Window.partitionBy("query_id")))
    return out.where(F.col("rank") <= S.TOP_N).select("query_id", "id", F.round("score", 6).alias("score"), "rank", "node_rank")


@query(
    "sessions_chunks",
    f"""WITH u AS (SELECT conv_id, turn, text FROM conversations), n AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 * 3)::INT AS start, {T.clip_sql('text', 260)} AS line FROM u),
  o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id, start ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS "offset" FROM n)
SELECT conv_id, start, count(*) AS members, sum(CASE WHEN "offset" < 400 THEN 1 ELSE 0 END)::BIGINT AS visible, max("offset")::INT AS last_offset, {T.clip_sql("string_agg(line, chr(10) ORDER BY turn)", 400)} AS text FROM o GROUP BY conv_id, start""",
)
def sessions_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Session nodes cut from conversations: chunks, visible members, clipped text. Small sizes, so that conversations have several."""
    c = sessions.chunks(T.table(spark, sf, "conversations").withColumn("emb_rank", F.col("turn")), ["conv_id"], ["turn"], 3, 400)
    n = sessions.nodes(c, ["conv_id"], ["turn"], 400).drop("emb_rank")
    return n.join(c.groupBy("conv_id", "start").agg(F.max("offset").alias("last_offset")), ["conv_id", "start"])


def _compose_sql(lean: bool) -> str:
    m = S.MODELS["compose-lean" if lean else "compose"]
    raw = {"d": "p", "node": "node_p", "embedding": "1 / log2(emb_rank + 1)", "bm25": "1 / log2(bm25_rank + 1)", "hyde": "CASE WHEN hyde_rank IS NOT NULL THEN 1 / log2(hyde_rank + 1) END", "durable": "durable", "same_thread": "CASE WHEN session_id = thread_id THEN 1.0 ELSE 0.0 END", "recency": "1 / log2(recency_rank + 1)"}
    terms = [f"({m['intercept']!r})::DOUBLE"]
    for j, f in enumerate(m["features"]):
        x = f"({raw[f]})::DOUBLE"
        terms.append(f"(coalesce({x}, {m['medians'][j]!r}::DOUBLE) - {m['means'][j]!r}::DOUBLE) / {m['scales'][j]!r}::DOUBLE * ({m['coefficients'][j]!r})::DOUBLE + CASE WHEN {x} IS NULL THEN ({m['coefficients'][len(m['features']) + j]!r})::DOUBLE ELSE 0 END")
    wide = "" if lean else " OR hyde_rank <= 300 OR durable >= 0.3"
    more = "" if lean else f"{HYDE}, {T.DURABLE}, "
    return f"""{JUDGE}, {NODES}, {more}it AS (SELECT ch.*, node_p, node_rank, row_number() OVER (PARTITION BY ch.query_id ORDER BY ch.micros DESC, ch.id DESC) AS recency_rank{', fk.rank AS hyde_rank, durable.p AS durable' if not lean else ''},
  CASE WHEN (ch.id + ch.query_id) % 13 = 0 THEN NULL ELSE CASE WHEN coalesce(shared, 0) >= 2 THEN 0.99 ELSE 0.04 END - (ch.id % 5) * 0.002 END::DOUBLE AS p
  FROM ch JOIN nk USING (query_id, session_id, start) LEFT JOIN sh ON sh.query_id = ch.query_id AND sh.id = ch.id{' LEFT JOIN fk ON fk.query_id = ch.query_id AND fk.id = ch.id AND fk.rank <= 300 JOIN durable ON durable.id = ch.id' if not lean else ''}),
li AS (SELECT *, round({' + '.join(terms)}, 9) AS linear FROM it WHERE node_rank <= 32 OR emb_rank <= 300 OR bm25_rank <= 100{wide}),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY linear DESC, micros, id) AS rank FROM li)"""


def _linear(spark: SparkSession, sf: str, lean: bool) -> DataFrame:
    cases, corpus, visible = _base(spark, sf)
    ranked = total_order(ranking.ranks(visible, cases, corpus), ["query_id"], F.desc("micros"), F.desc("id"), name="recency_rank")
    t = _judged(_routed(ranked), cases, corpus)
    least, i = S.COMPOSE, S.inverse_log_rank
    keep = (F.coalesce("node_rank", F.lit(1 << 30)) <= least["nodes"]) | (F.col("emb_rank") <= least["emb"]) | (F.col("bm25_rank") <= least["bm25"])
    raw = {"d": F.col("p"), "node": F.col("node_p"), "embedding": i(F.col("emb_rank")), "bm25": i(F.col("bm25_rank")), "same_thread": F.coalesce((F.col("session_id") == F.col("thread_id")).cast("double"), F.lit(0.0)), "recency": i(F.col("recency_rank"))}
    if not lean:
        hyde = _hyde(spark, sf, cases, visible, ranked).where(F.col("rank") <= least["hyde"]).select("query_id", "id", F.col("rank").alias("hyde_rank"))
        t = ranking.with_durability(t.join(hyde, ["query_id", "id"], "left"), T.durability(spark, sf))
        keep = keep | F.col("hyde_rank").isNotNull() | F.coalesce(F.col("durable") >= least["durable"], F.lit(False))
        raw |= {"hyde": i(F.col("hyde_rank")), "durable": F.col("durable")}
    t = t.where(keep).withColumn("linear", F.round(S.linear_model("compose-lean" if lean else "compose", raw), 9))
    return t.withColumn("rank", ranking.row_rank(["query_id"], F.desc("linear"), F.asc("micros"), F.asc("id")))


@query("compose_lean_score", f"WITH {_compose_sql(True)} SELECT query_id, id, round(linear, 6) AS linear, rank::INT AS rank FROM lr WHERE rank <= 50")
def compose_lean_score(spark: SparkSession, sf: str) -> DataFrame:
    """Plan `compose-lean`: channel union and the frozen linear model of six features."""
    return _linear(spark, sf, True).where(F.col("rank") <= S.TOP_N).select("query_id", "id", F.round("linear", 6).alias("linear"), "rank")


@query(
    "compose_softmax_blend",
    f"""WITH {_compose_sql(False)}, h AS (SELECT query_id, id, rank, linear, ((id * 7 + query_id) % 101) / 101.0::DOUBLE AS listwise, exp(linear - max(linear) OVER (PARTITION BY query_id)) AS ex FROM lr WHERE rank <= 24),
  b AS (SELECT *, round(0.5::DOUBLE * listwise + 0.5::DOUBLE * ex / sum(ex) OVER (PARTITION BY query_id), 9) AS blend FROM h)
SELECT query_id, id, round(blend, 6) AS blend, row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, rank)::INT AS rank FROM b""",
)
def compose_softmax_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Plan `compose`: eight features; the first 24 blended with a listwise choice by softmax."""
    h = _linear(spark, sf, False).where(F.col("rank") <= S.COMPOSE["listwise"]).withColumn("listwise", ((F.col("id") * 7 + F.col("query_id")) % 101) / 101.0)
    b = h.withColumn("blend", F.round(S.COMPOSE["weight"] * F.col("listwise") + (1 - S.COMPOSE["weight"]) * S.softmax(F.col("linear"), "query_id"), 9))
    return b.select("query_id", "id", F.round("blend", 6).alias("blend"), ranking.row_rank(["query_id"], F.desc("blend"), F.asc("rank")).alias("rank"))


@query("recency_rank", f"WITH {CORPUS} SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY micros DESC, id DESC)::INT AS rank FROM v) WHERE rank <= 30")
def recency_rank(spark: SparkSession, sf: str) -> DataFrame:
    _, _, visible = _base(spark, sf)
    return visible.withColumn("rank", ranking.row_rank(["query_id"], F.desc("micros"), F.desc("id"))).where(F.col("rank") <= 30).select("query_id", "id", "rank")


# ---- eligibility and selection ----------------------------------------------------


@query("point_in_time", f"WITH {T.STATEMENTS}, {T.CASES}, v AS (SELECT query_id, id FROM c JOIN s ON micros < decision AND session_id <> exclude_session), x AS (SELECT query_id, query_id * 3 AS id FROM c) SELECT query_id, count(*) AS n, max(id) AS newest, sum(id)::BIGINT AS total FROM v WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.query_id = v.query_id AND x.id = v.id) GROUP BY query_id")
def point_in_time(spark: SparkSession, sf: str) -> DataFrame:
    cases = T.cases(spark, sf)
    excluded = cases.select("query_id", (F.col("query_id") * 3).alias("id"))
    return eligibility.visible(cases, T.statements(spark, sf), excluded).groupBy("query_id").agg(F.count("*").alias("n"), F.max("id").alias("newest"), F.sum("id").alias("total"))


_ALLOWED = "kind NOT IN ('question', 'status') AND (repo = current_repo OR (scope = 'global' AND kind IN ('rule', 'preference')))"


@query("card_fail_closed", f"WITH {T.STATEMENTS}, {T.CARDS}, {T.CASES}, v AS (SELECT query_id, s.id, kind, coalesce({_ALLOWED}, false) AS ok FROM c JOIN s ON micros < decision AND session_id <> exclude_session LEFT JOIN cards ON cards.id = s.id) SELECT query_id, count(*) AS n, count_if(kind IS NULL)::BIGINT AS no_card, count_if(ok)::BIGINT AS allowed FROM v GROUP BY query_id")
def card_fail_closed(spark: SparkSession, sf: str) -> DataFrame:
    v = eligibility.visible(T.cases(spark, sf), T.statements(spark, sf)).join(T.cards(spark, sf), "id", "left").withColumn("ok", eligibility.card_allowed())
    return v.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isNull()).alias("no_card"), F.count_if("ok").alias("allowed"))


@query(
    "precision_tally",
    f"""WITH {T.STATEMENTS}, {T.CARDS}, {T.CASES}, v AS (SELECT query_id, s.id, micros, CASE WHEN gist_source = 'none' THEN 'gist-placeholder' WHEN regexp_matches(text, 'https?://|127\\.0\\.0\\.1|localhost|:\\d{{4,5}}\\b|/Users/|~/|\\.(ts|js|mjs|md|json|tsx)\\b') THEN 'cites-location'
   WHEN length(text) >= 300 AND NOT coalesce(repo = current_repo, false) THEN 'cross-repo-long' WHEN kind IN ('rule', 'preference') AND length(text) >= 500 THEN 'long-directive' END AS reason
   FROM c JOIN s ON micros < decision AND session_id <> exclude_session JOIN cards ON cards.id = s.id WHERE coalesce({_ALLOWED}, false)),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id, reason ORDER BY micros DESC, id DESC) AS k FROM v WHERE reason IS NOT NULL)
SELECT query_id, reason, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY micros, id) FILTER (k <= 50) AS ids FROM k GROUP BY query_id, reason""",
)
def precision_tally(spark: SparkSession, sf: str) -> DataFrame:
    ruled = T.statements(spark, sf).join(T.cards(spark, sf), "id").withColumn("cites", eligibility.cites_location(F.col("text"))).withColumn("chars", F.length("text")).drop("text")
    spread = ruled.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")  # the rules on texts are settled once a statement, not once a pair
    v = eligibility.visible(T.cases(spark, sf), spread).where(eligibility.card_allowed()).withColumn("reason", eligibility.precision_reason(cites=F.col("cites"), chars=F.col("chars")))
    return eligibility.tally(v, ["query_id"]).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(
    "alias_same_repo",
    f"WITH {T.STATEMENTS}, a AS (SELECT id, repo, CASE repo WHEN 'src1' THEN 'src2' WHEN 'src3' THEN 'src2' ELSE repo END AS canon FROM s) SELECT repo, count(*) AS n, count_if(coalesce(canon = 'src2', false))::BIGINT AS same FROM a GROUP BY repo",
)
def alias_same_repo(spark: SparkSession, sf: str) -> DataFrame:
    from lumenlog.functions.repo import same_repo

    return T.statements(spark, sf).groupBy("repo").agg(F.count("*").alias("n"), F.count_if(same_repo(F.col("repo"), F.lit("src2"), {"src1": "src2", "src3": "src2"})).alias("same"))


_HUB_NOW = "TIMESTAMP '2024-01-24 00:00:00'"
HUB_NOW = 1_706_054_400_000_000


@query("hub_suppress", f"WITH {T.LOG} SELECT k AS id, count(DISTINCT session_id) AS sessions FROM log WHERE outcome = 'silent' AND ts > {_HUB_NOW} - INTERVAL 14 DAY AND ts < {_HUB_NOW} AND session_id <> 7 GROUP BY k HAVING count(DISTINCT session_id) >= 10")
def hub_suppress(spark: SparkSession, sf: str) -> DataFrame:
    log = T.turn_log(spark, sf).where("outcome = 'silent'").select(F.col("k").alias("id"), F.col("session_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return selection.hub_ids(log, HUB_NOW, 14, 10, 7)


@query("hub_index_latest", f"WITH {T.LOG} SELECT k AS id, session_id AS session, epoch_us(max(ts)) AS last FROM log WHERE k IS NOT NULL GROUP BY ALL")
def hub_index_latest(spark: SparkSession, sf: str) -> DataFrame:
    log = T.turn_log(spark, sf).where("k is not null").select(F.col("k").alias("id"), F.col("session_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return selection.hub_index(log)


_RANKED = f"SELECT 0 AS query_id, id % 7 AS session, id, text, ((id * 37) % 1009) / 1009.0::DOUBLE AS score, row_number() OVER (ORDER BY ((id * 37) % 1009) DESC, id)::INT AS rank FROM s"


def _ranked_all(spark: SparkSession, sf: str) -> DataFrame:
    """All statements in one order, over range partitions. Numbers alone are ranked; texts are joined to them afterwards."""
    s = T.statements(spark, sf)
    n = s.select(F.lit(0).alias("query_id"), (F.col("id") % 7).alias("session"), "id", (((F.col("id") * 37) % 1009) / 1009.0).alias("score"))
    ranked = total_order(n, ["query_id"], F.desc("score"), F.asc("id"))
    return ranked.join(s.select("id", "text"), "id")


@query("no_repeat", f"WITH {T.STATEMENTS}, r AS ({_RANKED}), told AS (SELECT DISTINCT user_id % 7 AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 AS id FROM events), tk AS (SELECT DISTINCT session, lower({T.norm_sql('text')}) AS key FROM told JOIN s USING (id)) SELECT id, session, rank FROM r WHERE NOT EXISTS (SELECT 1 FROM told WHERE told.session = r.session AND told.id = r.id) AND NOT EXISTS (SELECT 1 FROM tk WHERE tk.session = r.session AND tk.key = lower({T.norm_sql('r.text')}))")
def no_repeat(spark: SparkSession, sf: str) -> DataFrame:
    told = T.table(spark, sf, "events").select((F.col("user_id") % 7).alias("session"), (F.get_json_object("props", "$.k").cast("bigint") * 3).alias("id"))
    return selection.no_repeat(_ranked_all(spark, sf), told, T.statements(spark, sf)).select("id", "session", "rank")


@query("dedupe_keep_best", f"WITH {T.STATEMENTS}, r AS ({_RANKED}), k AS (SELECT id, rank, row_number() OVER (PARTITION BY lower({T.norm_sql('text')}) ORDER BY score DESC, rank) AS copy FROM r) SELECT id, rank FROM k WHERE copy = 1")
def dedupe_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    return selection.keep_best(_ranked_all(spark, sf), ["query_id"]).select("id", "rank")


_SURV = f"""{FUSED}, sv AS (SELECT *, CASE WHEN id % 9 = 0 THEN NULL ELSE ((id * 7 + query_id) % 100) / 100.0::DOUBLE END AS apply_p FROM fr WHERE rank <= 50 AND p >= 0.95)"""


def _survivors(spark: SparkSession, sf: str) -> DataFrame:
    fused, _, _ = _fused(spark, sf)
    s = selection.gate(fused.where(F.col("rank") <= S.TOP_N), "p", S.PROMPT_GATE)
    return s.withColumn("apply_p", F.when(F.col("id") % 9 != 0, ((F.col("id") * 7 + F.col("query_id")) % 100) / 100.0))


@query("apply_gate_topk", f"WITH {_SURV}, g AS (SELECT query_id, id, apply_p, row_number() OVER (PARTITION BY query_id ORDER BY apply_p DESC, rank)::INT AS place FROM sv WHERE apply_p >= 0.2) SELECT * FROM g WHERE place <= 3")
def apply_gate_topk(spark: SparkSession, sf: str) -> DataFrame:
    return selection.apply_gate(_survivors(spark, sf), 3).select("query_id", "id", "apply_p", "place")


@query("gate_verdicts", f"WITH {_SURV}, g AS (SELECT *, CASE WHEN apply_p >= 0.2 THEN row_number() OVER (PARTITION BY query_id, apply_p >= 0.2 ORDER BY apply_p DESC, rank) END AS place FROM sv) SELECT query_id, id, CASE WHEN place <= 3 THEN 'injected' WHEN apply_p IS NULL THEN 'no-answer' WHEN apply_p >= 0.2 THEN 'cut' ELSE 'below' END AS verdict FROM g")
def gate_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    s = _survivors(spark, sf)
    return selection.gate_rows(s, selection.apply_gate(s, 3)).select("query_id", "id", "verdict")


@query("gate_then_cut", f"WITH {FUSED}, g AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS place FROM fr WHERE rank <= 50 AND p >= 0.95) SELECT * FROM g WHERE place <= 5")
def gate_then_cut(spark: SparkSession, sf: str) -> DataFrame:
    fused, _, _ = _fused(spark, sf)
    return selection.cut(selection.gate(fused.where(F.col("rank") <= S.TOP_N), "p", S.PROMPT_GATE), 5).select("query_id", "id", "place")


_RECALL = f"""WITH {FUSED}, gold AS (SELECT query_id, id FROM c JOIN s ON contains(text, situation)), g AS (SELECT gold.query_id, min(fr.rank) AS first, count(*) AS gold, count_if(coalesce(fr.rank <= 5, false)) AS top5, count_if(coalesce(fr.rank <= 10, false)) AS top10 FROM gold LEFT JOIN fr ON fr.query_id = gold.query_id AND fr.id = gold.id AND fr.rank <= 50 GROUP BY gold.query_id)
SELECT query_id, gold, round(top5::DOUBLE / gold, 6) AS recall5, round(top10::DOUBLE / gold, 6) AS recall10, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr FROM g"""


@query("recall_mrr", _RECALL)
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation of the default plan: gold are statements that hold the item's text."""
    from lumenlog.plans.evaluate import metrics

    fused, _, cases = _fused(spark, sf)
    gold = eligibility.in_batches(cases.select("query_id", "situation"), T.statements(spark, sf), F.expr("contains(text, situation)")).select("query_id", "id")
    return metrics(fused.where(F.col("rank") <= S.TOP_N), gold)


@query(
    "bootstrap_ci",
    f"""WITH va AS ({_RECALL}), nu AS (SELECT recall5 AS value, row_number() OVER (ORDER BY query_id) AS place, count(*) OVER () AS n FROM va),
  pk AS (SELECT draw, ('0x' || substr(md5(draw || ':' || place || ':42'), 1, 8))::BIGINT % n + 1 AS place FROM nu, unnest(range(1, 201)) t(draw)), m AS (SELECT draw, avg(value) AS m FROM pk JOIN nu USING (place) GROUP BY draw)
SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Seeded bootstrap interval of mean recall@5."""
    from lumenlog.plans.evaluate import bootstrap

    return bootstrap(recall_mrr(spark, sf).select("query_id", F.col("recall5").alias("value")))

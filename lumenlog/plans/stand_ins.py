"""The tables at hand as the engine's relations, and the same as SQL views for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01T00:00Z in microseconds; statements come a minute apart.
EPOCH, MINUTE = 1_704_067_200_000_000, 60_000_000
KINDS = ("rule", "preference", "decision", "correction", "question", "status", "other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("repo"), F.col("lang").alias("host"),
        (F.col("doc_id") % 61).alias("session_id"), (F.col("doc_id") * MINUTE + EPOCH).alias("micros"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        id_.alias("id"), F.element_at(F.array(*map(F.lit, KINDS)), (id_ % 7 + 1).cast("int")).alias("kind"),
        F.when(F.col("quality") == 1, F.when(id_ % 3 == 0, "repo").otherwise("global")).otherwise("unclear").alias("scope"),
        F.when(id_ % 11 == 0, "none").otherwise("assistant").alias("gist_source"),
    )


def durability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, p) for every statement, null where the model refused: how likely it holds for long. A rule over lengths stands in for the model."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 6 != 0, (F.length(F.coalesce("text", F.lit(""))) * 7 + F.col("doc_id")) % 100 / 100.0).alias("p"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, with a time, a thread and a repo; an item's vector is the one with its number."""
    i = F.col("item_id")
    q = table(spark, sf_dir, "benchmark").select(
        i.alias("query_id"), F.col("text").alias("situation"), (i * 17 * MINUTE + EPOCH + 200 * MINUTE).alias("decision"),
        (i % 61).alias("thread_id"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("current_repo"), ((i * 7) % 61).alias("exclude_session"),
    )
    return q.join(embeddings(spark, sf_dir).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "query_id")


#: The stand-in judge of the tests: sure where texts share two distinct tokens of length five or more; every 13th pair is refused.
def judge_p(shared) -> object:
    return F.when((F.col("id") + F.col("query_id")) % 13 == 0, None).otherwise(F.when(shared >= 2, 0.99).otherwise(0.04) - (F.col("id") % 5) * 0.002)


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turn-log lines."""
    t, e = F.col("event_type"), F.col("event_id")
    outcome = F.when(t == "purchase", "injected").when(t == "view", "silent").when(t == "click", "injected").when(t == "signup", "blocked").otherwise(F.lit(None).cast("string"))
    reason = F.when(t == "view", F.element_at(F.array(*map(F.lit, ("skip:short", "cap-reached", "headless:pipe", "nothing-above", "unknown:tty"))), (e % 5 + 1).cast("int"))).when(t == "signup", "policy")
    return table(spark, sf_dir, "events").select(
        e.alias("at"), "ts", F.col("user_id").alias("session_id"), F.when(e % 10 == 9, "auto-index").when(e % 2 == 0, "prompt").otherwise("stop").alias("event"), outcome.alias("outcome"), reason.alias("reason"),
        F.when(e % 50 == 7, "error").otherwise("info").alias("level"), F.when(e % 3 > 0, F.element_at(F.array(F.lit("a"), F.lit("b")), (e % 3).cast("int"))).alias("host"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.col("value").alias("cost"), F.when(e % 4 > 0, F.concat(F.lit("p"), (e % 4).cast("string"))).alias("project"),
    )


STATEMENTS = f"""s AS (SELECT doc_id AS id, coalesce(text, '') AS text, source AS repo, lang AS host, doc_id % 61 AS session_id, doc_id * {MINUTE} + {EPOCH} AS micros FROM documents)"""
CARDS = f"""cards AS (SELECT doc_id AS id, ({list(KINDS)!r})[doc_id % 7 + 1] AS kind,
  CASE WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'repo' ELSE 'global' END ELSE 'unclear' END AS scope,
  CASE WHEN doc_id % 11 = 0 THEN 'none' ELSE 'assistant' END AS gist_source FROM labels)"""
DURABLE = "durable AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 <> 0 THEN (length(coalesce(text, '')) * 7 + doc_id) % 100 / 100.0::DOUBLE END AS p FROM documents)"
CASES = f"""c AS (SELECT item_id AS query_id, b.text AS situation, item_id * 17 * {MINUTE} + {EPOCH + 200 * MINUTE} AS decision, item_id % 61 AS thread_id,
  'src' || (item_id % 20) AS current_repo, (item_id * 7) % 61 AS exclude_session, embedding AS qvec FROM benchmark b JOIN embeddings ON vec_id = item_id)"""
LOG = """log AS (SELECT event_id AS ln, ts, user_id AS session_id, CASE WHEN event_id % 10 = 9 THEN 'auto-index' WHEN event_id % 2 = 0 THEN 'prompt' ELSE 'stop' END AS event,
  CASE event_type WHEN 'purchase' THEN 'injected' WHEN 'view' THEN 'silent' WHEN 'click' THEN 'injected' WHEN 'signup' THEN 'blocked' END AS outcome,
  CASE WHEN event_type = 'view' THEN (['skip:short', 'cap-reached', 'headless:pipe', 'nothing-above', 'unknown:tty'])[event_id % 5 + 1] WHEN event_type = 'signup' THEN 'policy' END AS reason,
  CASE WHEN event_id % 50 = 7 THEN 'error' ELSE 'info' END AS level, CASE WHEN event_id % 3 > 0 THEN (['a', 'b'])[event_id % 3] END AS host,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS cost, CASE WHEN event_id % 4 > 0 THEN 'p' || (event_id % 4) END AS project FROM events)"""

#: Spark's norm, clip and tokenize in DuckDB, for ASCII white space.
MACRO_WS = r"[ \t\n\x0B\f\r]"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def clip_sql(x: str, n: int) -> str:
    t = trim_sql(x)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace(substr({t}, 1, {n}), '\\s+$', '') || ' [...]' END"


def tokens_sql(x: str) -> str:
    from lumenlog.functions.text import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9_$./-]{{2,}}'), lambda w: trim(w, './-')), lambda w: length(w) >= 2 AND w NOT IN ({stop}))"

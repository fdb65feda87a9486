"""Queries over what Spark writes from the tables: keyed tables, backfill, cached questions, line files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions.vectors import dot
from lumenlog.operators import questions
from lumenlog.plans import stand_ins as T
from lumenlog.plans.catalog import query
from lumenlog.sources import backfill, chunks, loglines
from lumenlog.sources.commits import KeyedTable
from lumenlog.sources.staging import new_path


def _table(spark: SparkSession, name: str, keys: list[str], schema: str) -> KeyedTable:
    return KeyedTable(spark, new_path(spark, name), keys, schema)


@query(
    "keyed_upserts",
    f"""WITH {T.STATEMENTS}, a AS (SELECT id AS key, host AS value FROM s WHERE id % 3 > 0), b AS (SELECT * FROM a UNION ALL SELECT id, 'second' FROM s WHERE id % 3 = 0),
c AS (SELECT key, CASE WHEN key % 10 = 4 THEN 'replaced' ELSE value END AS value FROM b WHERE key % 7 > 0) SELECT key, value FROM c""",
)
def keyed_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """A keyed table after an append, an insert that must ignore what is held, and a replacement that retires keys."""
    s = T.statements(spark, sf).select(F.col("id").alias("key"), F.col("host").alias("value"))
    t = _table(spark, "upserts", ["key"], "key long, value string")
    t.append(s.where("key % 3 > 0"))
    t.insert_or_ignore(s.withColumn("value", F.lit("second")))
    t.replace(s.where("key % 10 = 4 and key % 7 > 0").withColumn("value", F.lit("replaced")), retired=s.where("key % 7 = 0"))
    return t.read()


@query(
    "versioned_backfill",
    f"""WITH {T.STATEMENTS}, w AS (SELECT id, trim(regexp_replace(text, '^\\S+\\s', '')) AS text, text AS raw FROM s)
SELECT host, count(*) AS held, sum(length(w.text))::BIGINT AS chars, count_if(w.text <> s.text)::BIGINT AS rewritten FROM w JOIN s USING (id) WHERE length(w.text) >= 40 AND length(s.text) >= 20 GROUP BY host""",
)
def versioned_backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Statements judged under one version of a rule, then under the next: what stays, as a rebuild would have it."""
    lines = T.statements(spark, sf).select(F.concat(F.lit("f:L"), F.col("id").cast("string")).alias("src"), F.col("id").cast("string").alias("id"), "host", F.col("text").alias("raw"))
    t = [_table(spark, n, k, s) for n, k, s in (("statements", ["src"], backfill.STATEMENT_SCHEMA), ("stamps", ["src"], backfill.STAMP_SCHEMA), ("retired", ["src", "version"], backfill.RETIRED_SCHEMA))]

    def rule(text, least: int):
        kept = F.when(F.length(text) >= least, text)
        return lambda x: x.select("src", "id", kept.alias("text"), F.when(kept.isNull(), "short").alias("reason"))

    backfill.backfill(*t, lines, rule(F.col("raw"), 20), 1)
    # lines that the first version rejected stay out of this view, as their texts are too short for the second as well
    backfill.backfill(*t, lines, rule(F.trim(F.regexp_replace("raw", r"^\S+\s", "")), 40), 2)
    held = t[0].read().select("src", F.length("text").alias("chars"), backfill.mark("text").alias("now"))
    both = held.join(lines.select("src", "host", backfill.mark("raw").alias("was")), "src")
    return both.groupBy("host").agg(F.count("*").alias("held"), F.sum("chars").alias("chars"), F.count_if(F.col("now") != F.col("was")).alias("rewritten"))


def _stand_in(given: str, asked: list[dict]) -> list[float | None]:
    """Stands in for the remote scorer: refuses every thirteenth length, and else a probability by lengths."""
    return [None if len(q["instructions"]) % 13 == 0 else (len(q["instructions"]) * 7 + len(given)) % 100 / 100 for q in asked]


@query(
    "cached_questions",
    """WITH q AS (SELECT c.conv_id, c.turn, f.text AS input, c.text AS instructions FROM conversations c JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations GROUP BY ALL) f USING (conv_id) WHERE c.text IS NOT NULL AND f.text IS NOT NULL),
a AS (SELECT *, length(instructions) % 2 = 0 AS cached FROM q)
SELECT conv_id, turn, cached, CASE WHEN cached THEN 0.5 WHEN length(instructions) % 13 = 0 THEN NULL ELSE (length(instructions) * 7 + length(input)) % 100 / 100.0 END::DOUBLE AS p FROM a""",
)
def cached_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as questions about their conversation's first turn: half the answers are held, the rest are asked in packs, each key once."""
    c = T.table(spark, sf, "conversations")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("input"))
    q = c.join(first, "conv_id").where("text is not null and input is not null").select("conv_id", "turn", "input", F.lit("predicate").alias("type"), F.col("text").alias("instructions"), F.lit(None).cast("array<string>").alias("choices"))
    cache = _table(spark, "answers", ["key"], questions.CACHE_SCHEMA)
    cache.insert_or_ignore(q.where(F.length("instructions") % 2 == 0).select(questions.key().alias("key"), F.array(F.lit(0.5)).alias("p")))
    return questions.score(q, cache, _stand_in).select("conv_id", "turn", "cached", F.col("p")[0].alias("p"))


@query("line_numbers", "SELECT role, count(*) AS n, sum(conv_id * 1000 + turn)::BIGINT AS total, sum(length(text))::BIGINT AS chars, true AS numbered FROM conversations GROUP BY role")
def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as JSONL files, read back by byte ranges: every turn is there once, and a file's lines are numbered without a gap."""
    path = new_path(spark, "lines")
    T.table(spark, sf, "conversations").write.json(path)
    got = loglines.lines(spark, [path], pattern="*.json", split_bytes=1 << 20)
    rows = got.withColumn("r", F.from_json("value", "conv_id long, turn long, role string, text string")).select("file", "line_no", "r.*")
    files = rows.groupBy("file").agg(F.count("*").alias("lines"), F.max("line_no").alias("last"), F.countDistinct("line_no").alias("numbers"))
    ok = files.agg(F.bool_and((F.col("lines") == F.col("last")) & (F.col("lines") == F.col("numbers"))).alias("numbered"))
    return rows.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.col("conv_id") * 1000 + F.col("turn")).alias("total"), F.sum(F.length("text")).alias("chars")).crossJoin(F.broadcast(ok))  # one row


@query("vector_chunks", "SELECT vec_id AS id, round(list_inner_product(embedding, embedding)::DOUBLE, 4) AS norm, true AS listed FROM embeddings WHERE embedding IS NOT NULL")
def vector_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings written as vector chunks and read back, with the hashes that the chunks list."""
    path, e = new_path(spark, "chunks"), T.embeddings(spark, sf).where("vec is not null")
    chunks.append(e.select(F.col("id").cast("string").alias("hash"), "vec"), path, 64)
    got = chunks.vectors(spark, path, 64).join(chunks.hashes(spark, path).withColumn("listed", F.lit(True)), "hash", "left")
    return got.select(F.col("hash").cast("long").alias("id"), F.round(dot(F.col("vec"), F.col("vec")), 4).alias("norm"), F.coalesce("listed", F.lit(False)).alias("listed"))

"""Operator 3, exact dedup: skew-safe combining, with DataFrame operations only.

Texts are equal when identical after each run of ASCII white space is made one space; null counts
as empty. Three stages, each comparing the full normalised content next to its digest:

1. map-side: partial aggregation combines equal contents within a task before anything is sent;
2. (digest, salt): a digest that a frequency sketch names as large is dealt out over `SALTS` salts;
3. the salts' winners are combined for those digests alone. Others have one salt and are done.

A digest that should stand for two contents (none is known) is joined by content instead.

Rows with one doc_id and text are all counted and all carry the same decision. Empty input gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import SPACE, hot_keys, load, stage

SALTS, LARGE = 64, 10_000


def normal(text: str) -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, keep_id (smallest doc_id of the equal texts), group_size, kept and text_sha256 for each row of docs."""
    text = normal("text")
    digest = F.unhex(F.sha2(text, 256))
    keys = stage(docs.select("doc_id", digest.alias("digest")).withColumn("h", F.xxhash64("digest")), "digests")
    hot = hot_keys(keys, "h", large)
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    full = docs.select("doc_id", digest.alias("digest"), text.alias("content")).withColumn("h", F.xxhash64("digest"))

    def combined(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy("digest", *by, "content").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))

    found = combined(full.where(~is_hot) if hot else full).select("digest", "keep_id", "group_size")
    if hot:
        salted = combined(full.where(is_hot).withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS))), "salt")
        found = found.union(salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).select("digest", "keep_id", "group_size"))
    winners = stage(found, "winners")
    doubled = winners.groupBy("digest").count().where("count > 1").select("digest")
    mixed = not doubled.isEmpty()
    single = winners.join(doubled, "digest", "left_anti") if mixed else winners
    cold = single.where(~F.xxhash64("digest").isin(hot)) if hot else single
    out = (keys.where(~is_hot) if hot else keys).join(cold, "digest")
    if hot:  # at most 500 digests, so the large groups' rows stay where they are
        out = out.unionByName(keys.where(is_hot).join(F.broadcast(single.where(F.xxhash64("digest").isin(hot))), "digest"))
    if mixed:
        rest = full.join(doubled, "digest", "left_semi")
        out = out.unionByName(rest.join(combined(rest), ["digest", "content"]).drop("content"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"))


SQL = {
    "op3_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""
}

"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; each one's rows are written as Parquet to
the shared folder and read back as the next one's docs. All but the last return the columns of docs,
whatever further columns there are. Null and empty texts and those without letters go with the first
stage. Of rows that repeat a doc_id and its text, exact dedup keeps one. Rows that share a doc_id but
not their text stay apart until a later stage drops that doc_id, with all its rows; one with a null
doc_id can be found by no later stage and stays. Very long texts are read whole. Empty tables give no
rows. Ties go to the smallest doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm import decontamination, exact_dedup, jaccard_join, language_id, packing
from lumenlog.llm.common import load, stage

#: Share of a text's words that its language must have.
LEAST_SHARE = 0.5


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """docs without the doc_ids in gone, whose staged size tells Spark how to join."""
    return docs.join(stage(gone.select("doc_id").distinct(), name), "doc_id", "left_anti").select(docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too), and those in which no language has half of the words, go."""
    scored = language_id.identify_rows(docs, language_id.train(docs))
    return scored.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("doc.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id stays; of its rows, where they are repeated, one."""
    found = stage(exact_dedup.exact_dedup(docs), "exact")
    left = _without(docs, found.where("not kept"), "copies")
    again = stage(found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id").distinct(), "again")
    if again.isEmpty():
        return left
    nth = F.row_number().over(Window.partitionBy("doc_id", exact_dedup.normal("text")).orderBy("text"))
    rows = left.join(again, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("doc"), "doc_id", "text").withColumn("nth", nth)
    return left.join(again, "doc_id", "left_anti").select(docs.columns).union(rows.where("nth = 1").select("doc.*"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component at five-word shingles and similarity 0.8, the document with the smallest doc_id stays."""
    return _without(docs, jaccard_join.jaccard_join(docs, k=5, percent=80).where("doc_id <> component_id"), "near")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark")), "leaks")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens; a repeated row is packed each time."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The learned language model and the tokenizer have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Line-oriented sources: JSONL files with their line numbers, first lines, tails, contract rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenlog.sources import loglines

#: Paths that hold credentials are never read.
FORBIDDEN = r"(^|/)(\.ssh|secrets|auth\.json|\.credentials\.json|\.env)(/|$)|token"


def listing(spark: SparkSession, roots: list[str], pattern: str = "*.jsonl*") -> DataFrame:
    """Files below the roots (path, size, modified), in no order; dot folders, subagents and credential paths are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(roots).select("path", "length", "modificationTime")
    inner = F.col("path")
    return files.where(~inner.rlike(FORBIDDEN) & ~inner.rlike(r"/\.[^/]+/") & ~inner.contains("/subagents/")).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def lines(spark: SparkSession, paths: list[str], resume: DataFrame | None = None) -> DataFrame:
    """(file, line_no, value) of whole, newline-terminated lines that aren't blank; zstd files by their extension.

    Files are read in splits by the line source; what follows a last newline is left for a later read. resume (file,
    lines): only lines after those already read. Where byte offsets are known, loglines.lines skips what was read.
    """
    split = loglines.lines(spark, paths, pattern="*").select("file", "line_no", "value")
    if resume is None:
        return split
    return split.join(resume.select("file", F.col("lines").alias("seen")), "file", "left").where(F.col("line_no") > F.coalesce("seen", F.lit(0))).drop("seen")


def first_lines(rows: DataFrame) -> DataFrame:
    """(file, header) of rows at hand; loglines.first_lines reads no more than the heads."""
    return rows.groupBy("file").agg(F.min_by("value", "line_no").alias("header"))


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n lines of each file, of rows at hand; loglines.last_lines reads no more than the last bytes."""
    return rows.withColumn("from_end", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("line_no")))).where(F.col("from_end") <= n)


def contract(rows: DataFrame, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON rows under an explicit schema; a corrupt line is an error that names it, or a null record when not strict."""
    parsed = rows.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    bad = F.try_parse_json("value").isNull()
    if strict:
        parsed = parsed.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("corrupt line "), F.col("line_no").cast("string"), F.lit(" in "), F.col("file"))).cast(parsed.schema["r"].dataType)).otherwise(F.col("r")))
    return parsed.select("file", "line_no", "r.*")


def file_todo(files: DataFrame, state: DataFrame) -> DataFrame:
    """Incremental scan: files new or grown since the state (path, size, lines); a shrunk one is read from its start."""
    j = files.join(state.select("path", F.col("size").alias("old_size"), F.col("lines").alias("old_lines")), "path", "left")
    action = F.when(F.col("old_size").isNull(), "new").when(F.col("size") == F.col("old_size"), "unchanged").when(F.col("size") > F.col("old_size"), "grown").otherwise("rewritten")
    return j.withColumn("action", action).where("action <> 'unchanged'").withColumn("from_line", F.when(F.col("action") == "grown", F.col("old_lines")).otherwise(0)).drop("old_size", "old_lines")

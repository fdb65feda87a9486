"""Resumable replay."""

import pytest
from pyspark.sql import functions as F

from lumenlog.plans.evaluate import OUTPUT_SCHEMA, resume
from lumenlog.sources.commits import KeyedTable


def test_a_stopped_run_goes_on_and_asks_no_case_twice(spark, tmp_path):
    outputs = KeyedTable(spark, str(tmp_path / "out"), ["query_id"], OUTPUT_SCHEMA, buckets=2)
    cases = spark.range(7).select(F.col("id").alias("query_id"))
    asked = []

    def run(part):
        ids = sorted(r["query_id"] for r in part.collect())
        asked.append(ids)
        if len(asked) == 2:
            raise RuntimeError("stopped")
        rows = [(q, 10 * q + k, 1.0 / k, k) for q in ids if q != 3 for k in (2, 1)]
        return spark.createDataFrame(rows, "query_id long, id long, score double, rank int")

    with pytest.raises(RuntimeError):
        resume(cases, outputs, run, batch=3)
    assert outputs.read().count() == 3
    assert resume(cases, outputs, run, batch=3) == 4
    assert asked == [[0, 1, 2], [3, 4, 5], [3, 4, 5], [6]]
    got = {r["query_id"]: [(x["id"], x["score"]) for x in r["ranked"]] for r in outputs.read().collect()}
    assert got == {q: [] if q == 3 else [(10 * q + 1, 1.0), (10 * q + 2, 0.5)] for q in range(7)}
    assert resume(cases, outputs, run) == 0
    with pytest.raises(ValueError, match="twice"):
        resume(cases.union(cases), outputs, run)

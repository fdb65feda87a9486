"""The pipeline's stages on a small fixture, each against a plain version of what it keeps."""

import corpus_pipeline as P
import pytest
from test_dedup import brute_components, texts

from lumenlog.llm import packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, docs, words):
    d = tmp_path_factory.mktemp("sf")
    docs.write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(0, words(40))], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def test_stages(spark, folder):
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "decontamination", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    a = P.language_stage(spark, docs, folder)
    assert a.columns == columns
    kept = {i for i, _ in texts(a)}
    assert not kept & {0, 1, 2} and {3, 6, 7, 11, 30} <= kept
    assert sum(r["doc_id"] == 7 for r in a.collect()) == 2
    b = P.exact_stage(spark, a, folder)
    assert [r["doc_id"] for r in b.collect()].count(7) == 1  # repeated rows: one stays
    assert b.columns == columns and {i for i, _ in texts(b)} == kept - {5, 8, 9} | ({4, 5} & kept)
    c = P.jaccard_stage(spark, b, folder)
    want = {i for i, _, root in brute_components(texts(b), 5, 80) if i == root}
    assert c.columns == columns and {i for i, _ in texts(c)} == want
    d = P.decontamination_stage(spark, c, folder)
    assert d.columns == columns and {i for i, _ in texts(d)} == want
    assert {r["doc_id"] for r in P.packing_stage(spark, d, folder).collect()} == want


def test_run_gives_the_packed_rest(spark, folder):
    rows = P.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} and max(r["offset"] + r["length"] for r in rows) <= packing.SIZE


def test_columns_with_clashing_names(spark, folder, docs):
    odd = docs.selectExpr("*", "text as score", "1 as lang_pred", "n_chars as nth", "'x' as doc", "2 as kept", "3 as component_id")
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, odd, folder)
        assert got.columns == odd.columns and got.count() > 0, name
    assert P.packing_stage(spark, odd, folder).count() > 0


def test_run_on_empty_tables(spark, tmp_path, docs):
    docs.where("1 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0

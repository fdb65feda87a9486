"""The inverted index: counts of each text's terms, made without grouping what a task holds."""

import math
from collections import Counter

import pytest
from oracle import same
from pyspark.sql import functions as F

from lumenlog.functions.text import DOC_CLIP, clip, tokenize
from lumenlog.operators import lexical
from lumenlog.plans import catalog


def test_postings_are_counted_within_their_row(spark, monkeypatch):
    plans, write = {}, lexical.staged

    def staged(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(lexical, "staged", staged)
    texts = ["red fox, red dog", "", "the and of", "one", "zeta alpha zeta alpha alpha", "b-b b.b b/b b-b " * 700]
    rows = spark.createDataFrame([(i, t, i * 10, None if i == 3 else i % 2) for i, t in enumerate(texts)], "id long, text string, micros long, session_id long")
    postings, lengths = lexical.index(rows)
    tokens = {r["id"]: r["t"] for r in rows.select("id", tokenize(clip(F.col("text"), DOC_CLIP)).alias("t")).collect()}
    assert sorted((r["id"], r["term"], r["tf"], r["len"]) for r in postings.collect()) == sorted((i, w, n, len(t)) for i, t in tokens.items() for w, n in Counter(t).items())
    assert {r["id"]: r["len"] for r in lengths.collect()} == {i: len(t) for i, t in tokens.items()}
    # a task's memory doesn't hold the terms of all its texts
    assert "Aggregate" not in plans["postings"] and "Exchange" not in plans["postings"]


def test_postings_are_not_sent_to_every_task(spark):
    rows = spark.createDataFrame([(i, f"red fox {i} dog", i * 10, i % 2) for i in range(20)], "id long, text string, micros long, session_id long")
    cases = spark.createDataFrame([(1, "red dog", 1000, 0), (2, "fox", 50, None)], "query_id long, situation string, decision long, exclude_session long")
    found = lexical.hits(lexical.index(rows)[0], cases)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["term"], r["id"]) for r in found.collect()) == sorted([(1, w, i) for w in ("red", "dog") for i in range(1, 20, 2)] + [(2, "fox", i) for i in range(5)])


def test_postings_are_not_sorted_to_meet_a_few_terms(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"red fox {i} dog", i * 10, i % 2) for i in range(20)], "id long, text string, micros long, session_id long")
    cases = spark.createDataFrame([(1, "red dog", 1000, 0), (2, "fox", 50, None)], "query_id long, situation string, decision long, exclude_session long")
    postings, _ = lexical.index(rows)
    found = lexical.hits(postings, cases)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the cases' terms are the side that a task holds: its memory doesn't grow with the postings
    assert "ShuffledHashJoin" in plan and "BuildRight" in plan and "Sort" not in plan
    monkeypatch.setattr(lexical, "HELD_TERMS", 2)
    sorted_ = lexical.hits(postings, cases)
    assert "SortMergeJoin" in sorted_._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sorted_.collect())) == sorted(map(tuple, found.collect())) != []


#: Statements whose terms lie at the start, around and far beyond the clip, some repeated there.
LONG = ["quokka wombat", "filler " * 900 + "quokka", "numbat " + "pad " * 995 + "wombat", "zebra " * 20000 + "numbat numbat quokka", " " * 5000 + "wombat", None, "pad"]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """A folder of the three tables that an index is made of, and a connection that sees the same ones."""
    import duckdb

    sf, con = tmp_path_factory.mktemp("long"), duckdb.connect()
    documents = spark.createDataFrame([(i, t, "en", "src1") for i, t in enumerate(LONG)], "doc_id long, text string, lang string, source string")
    embeddings = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(len(LONG))], "vec_id long, embedding array<float>")
    benchmark = spark.createDataFrame([(0, "quokka numbat"), (1, "wombat, quokka zebra")], "item_id long, text string")
    for name, rows in {"documents": documents, "embeddings": embeddings, "benchmark": benchmark}.items():
        rows.write.parquet(f"{sf}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet/*.parquet'")
    return str(sf), con


def test_document_frequency_counts_whole_texts(spark, long_texts):
    sf, con = long_texts
    found = catalog.queries()["bm25_docfreq"](spark, sf)
    assert same(found, con, catalog.oracle_sql()["bm25_docfreq"]) == 5
    # item 0 doesn't see session 0, which is document 0
    assert {(r["query_id"], r["term"]): r["df"] for r in found.collect()} == {(0, "quokka"): 2, (0, "numbat"): 2, (1, "quokka"): 3, (1, "wombat"): 3, (1, "zebra"): 1}


def test_bm25_ranks_by_whole_texts(spark, long_texts):
    sf, con = long_texts
    found = catalog.queries()["bm25_topk"](spark, sf)
    assert same(found, con, catalog.oracle_sql()["bm25_topk"]) == 13
    # item 0 sees documents 1 to 6, item 1 all but session 7, which there is none of
    docs = {i: Counter(w for w in (t or "").replace(",", " ").split()) for i, t in enumerate(LONG)}
    for item, asked, seen in ((0, ("quokka", "numbat"), range(1, 7)), (1, ("wombat", "quokka", "zebra"), range(7))):
        avg = sum(docs[i].total() for i in seen) / len(seen)
        df = {w: sum(w in docs[i] for i in seen) for w in asked}
        score = {i: sum(math.log(1 + (len(seen) - df[w] + 0.5) / (df[w] + 0.5)) * docs[i][w] * 2.2 / (docs[i][w] + 1.2 * (0.25 + 0.75 * docs[i].total() / avg)) for w in asked) for i in seen}
        best = sorted(seen, key=lambda i: (-score[i], i))
        rows = sorted((r["bm25_rank"], r["id"], r["bm25"]) for r in found.where(f"query_id = {item}").collect())
        assert [r[:2] for r in rows] == [(k + 1, i) for k, i in enumerate(best)]
        assert [r[2] for r in rows] == [pytest.approx(score[i], abs=1e-6) for i in best]

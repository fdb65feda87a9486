"""Benchmark decontamination against a plain version, and cases of changed slots."""

import pytest

from lumenlog.llm.decontamination import decontaminate

ITEM = "Ann drove from Paris with 12 boxes that weigh 5 kg each , so how much do the 12 boxes weigh when she leaves Paris again"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, ITEM, "n"), (1, None, "n"), (2, "", "n"), (3, "where is the blue house", "n"), (4, ITEM.replace("Ann", "She"), "n")], "item_id long, text string, n string")


def run(spark, bench, text):
    df = spark.createDataFrame([(9, text, "h")], "doc_id long, text string, hashes string")
    return {r["item_id"] for r in decontaminate(df, bench).collect()}


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (ITEM, True),
        ("some words before it. " + ITEM + " and some after", True),
        (ITEM.replace("Paris", "Lyon").replace("12", "31"), True),  # re-parameterised, consistently
        (ITEM.replace("Paris", "Lyon", 1).replace("12", "31", 1).replace("5 kg", "7 lb"), True),  # most windows agree
        (" ".join(ITEM.split()[:9]), False),  # less than half of it
        ("an unrelated text about Paris and 12 other things that nobody weighs", False),
        ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 21 22 23 24", False),
        ("", False),
        (None, False),
    ],
)
def test_cases(spark, bench, text, hit):
    assert (0 in run(spark, bench, text)) is hit


def test_short_items_match_at_any_place(spark, bench):
    assert run(spark, bench, "x y z where is the blue house now") == {3}


def test_exact_passages_are_found_wherever_they_begin(spark, bench, words):
    rows = [(i, f"{words(i)} {ITEM} {words(7)}", "h") for i in range(12)] + [(99, words(200), "h"), (5, None, "h")]
    got = {r["doc_id"] for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string, h string"), bench).collect()}
    assert got >= set(range(12)) and 99 not in got


def test_empty_tables(spark, bench, docs, empty):
    assert decontaminate(docs, bench.where("1 = 0")).count() == 0
    assert decontaminate(empty, bench).count() == 0


def test_planted_items_of_the_tables(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    gold = set(duckdb.sql(f"select doc_id, item_id from '{sf}/documents.parquet' d join '{sf}/benchmark.parquet' b on contains(d.text, b.text)").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert gold and gold <= got and len(got) < 1.2 * len(gold) + 3


SHORT = "Tom sold nine old red hats at noon today quietly"
DENSE = "Each day Tom sells 12 pens , 7 cups , 30 books and 4 lamps for 95 dollars to Ann , Bob and Eve"


@pytest.mark.parametrize("n", [8, 9, 10])
def test_items_of_about_a_window_are_found_at_every_offset(spark, words, n):
    item = " ".join(SHORT.split()[:n])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(i, " ".join([*words(9).split()[:i], item, words(9)])) for i in range(9)]
    got = {r["doc_id"] for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == set(range(9))


def test_items_dense_in_slots_are_found(spark, words):
    bench = spark.createDataFrame([(0, DENSE), (1, "3 plus 4 is 7"), (2, "1 2 3 4 5 6 7 8 9 10 11 12")], "item_id long, text string")
    other = DENSE.replace("12", "15").replace("30", "41").replace("Tom", "Joe").replace("95", "80")
    rows = [(10 * k + i, f"{' '.join(words(9).split()[:i])} {x} {words(9)}") for k, x in enumerate([DENSE, other]) for i in range(8)]
    rows += [(50, f"so 3 plus 4 is 7 {words(9)}"), (51, f"so 3 plus 5 is 8 {words(9)}"), (52, "0 1 2 3 4 5 6 7 8 9 10 11 12 13"), (53, "9 8 7 6 5 4 3 2 1 0 9 8 7 6 5")]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(10 * k + i, 0) for k in range(2) for i in range(8)} | {(50, 1), (52, 2)}


def test_occurrences_with_other_slots_do_not_mix(spark, bench, words):
    one, two = ITEM.replace("Paris", "Lyon").replace("12", "31").replace("5 kg", "7 kg"), ITEM.replace("Paris", "Rome").replace("12", "99").replace("5 kg", "2 kg")
    rows = [(10 * k + i, f"{words(i + 1)} {a} {words(i)} {b} {words(5)}") for k, (a, b) in enumerate([(ITEM, one), (one, ITEM), (one, two), (two, one)]) for i in range(8)]
    longer = one.replace("how much", "please tell me how very much")
    rows += [(90, f"{longer} {two}"), (91, " ".join([one, two, ITEM] * 4))]
    got = {r["doc_id"] for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).where("item_id = 0").collect()}
    assert got == {r[0] for r in rows}

"""A version bump brings the tables to what a full rebuild would give, and changes only the files it must."""

from pyspark.sql import functions as F

from lumenlog.sources.backfill import RETIRED_SCHEMA, STAMP_SCHEMA, STATEMENT_SCHEMA, backfill
from lumenlog.sources.commits import KeyedTable


def tables(spark, path):
    return [KeyedTable(spark, str(path / n), k, s, buckets=8) for n, k, s in (("s", ["src"], STATEMENT_SCHEMA), ("v", ["src"], STAMP_SCHEMA), ("r", ["src", "version"], RETIRED_SCHEMA))]


def rule(trim, least):
    """Texts without a mark, if long enough; an id is the text's hash."""

    def judge(lines):
        text = F.regexp_replace("raw", trim, "")
        kept = F.when(F.length(text) >= least, text)
        return lines.select("src", F.sha1(text).alias("id"), kept.alias("text"), F.when(kept.isNull(), "short").alias("reason"))

    return judge


def test_a_bump_equals_a_rebuild_and_touches_few_files(spark, tmp_path):
    raw = [(f"f:L{i}", f"text number {i}" + ("!" if i == 7 else "")) for i in range(60)] + [("f:L90", "ab!c"), ("f:L91", "no"), ("g:L1", "same!"), ("g:L2", "same")]
    lines = spark.createDataFrame(raw, "src string, raw string")
    s, v, r = tables(spark, tmp_path / "a")
    assert backfill(s, v, r, lines, rule("#", 3), 1) == {"add": 63, "drop": 1}
    before = s.snapshot().live
    assert backfill(s, v, r, lines, rule("#", 3), 1) == {}
    first = {x["src"]: x["id"] for x in s.read().collect()}

    # the new rules peel "!" and want four characters: two rewrites, one of them to what another line holds, one retired
    assert backfill(s, v, r, lines, rule("!", 4), 2) == {"keep": 60, "rewrite": 1, "retire": 2, "drop": 1}
    after = s.snapshot().live
    touched = {x[0] for x in lines.where("src in ('f:L7', 'f:L90', 'g:L1')").select(s._bucket(8)).collect()}
    assert {int(b) for b in {*before, *after} if before.get(b) != after.get(b)} == touched
    assert sorted((x["src"], x["reason"], x["version"]) for x in r.read().collect()) == [("f:L90", "short", 2), ("g:L1", "turn-held-by-another-statement", 2)]
    assert s.snapshot().properties == {"rules": "2"}

    fresh = tables(spark, tmp_path / "b")
    backfill(*fresh, lines, rule("!", 4), 2)
    text = lambda t: sorted(x["text"] for x in t.read().collect())
    assert text(s) == text(fresh[0])
    assert all(x["id"] == first[x["src"]] for x in s.read().collect())  # a rewrite keeps its id


def test_new_lines_alone_are_judged(spark, tmp_path):
    lines = spark.createDataFrame([("a", "one two"), ("b", "three")], "src string, raw string")
    t = tables(spark, tmp_path)
    backfill(*t, lines.where("src = 'a'"), rule("!", 1), 1)
    seen = []

    def judge(x):
        seen.extend(r["src"] for r in x.collect())
        return rule("!", 1)(x)

    assert backfill(*t, lines, judge, 1) == {"add": 1} and seen == ["b"]


def shuffled(spark):
    """Bytes that all tasks so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_texts_are_sent_once_a_version(spark, tmp_path):
    text = F.concat_ws("", *[F.sha2(F.concat_ws(":", "id", F.lit(i)), 512) for i in range(16)])  # 2,048 characters that compress to half
    lines = spark.range(3000).select(F.concat(F.lit("f:L"), "id").alias("src"), text.alias("raw"))
    lines.write.parquet(str(tmp_path / "lines"))
    lines, t, began = spark.read.parquet(str(tmp_path / "lines")), tables(spark, tmp_path), shuffled(spark)
    assert backfill(*t, lines, rule("#", 3), 1) == {"add": 3000}
    assert backfill(*t, lines, rule("^.", 3), 2) == {"rewrite": 3000}
    assert t[0].read().where(F.length("text") == 2047).count() == 3000
    assert shuffled(spark) - began < 3 * 3000 * 2048  # two versions, and keys and digests


def test_rows_that_stay_are_the_same_by_either_set_of_keys(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], "a long, b string, v int", buckets=4)
    rows = [(i, None if i % 4 == 0 else f"k{i}", i) for i in range(40)] + [(1, "k1", 100)]  # a key held twice, and null ones
    t.append(spark.createDataFrame(rows, t.schema))
    for gone in ([(2, "k2"), (4, None)], [(i, f"k{i}") for i in range(2, 40)]):
        keys = spark.createDataFrame(gone, "a long, b string")
        got = sorted((r["a"], str(r["b"]), r["v"]) for r in t._without(t.snapshot().folders(), keys).collect())
        assert got == sorted((a, str(b), v) for a, b, v in rows if b is None or (a, b) not in gone)

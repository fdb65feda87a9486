"""Rendering and owner rules on small rows."""

import hashlib
import re

from pyspark.sql import functions as F

from lumenlog.functions import owner, paths, render
from lumenlog.functions.text import WRAPPERS
from lumenlog.plans import catalog


def test_parts_that_do_not_exist_are_left_out(spark):
    df = spark.createDataFrame([("now", "web", "before", "```\nx = 1\n```"), ("now", None, None, None)], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(render.context_situation(*map(F.col, "abcd"))).collect()]
    latest = "OWNER (latest message, before the agent has acted): now"
    assert sorted(got) == sorted([f"{render.STOP_HEAD}\n\nPROJECT: web\n\nOWNER (earlier): before\n\n{latest}", f"{render.STOP_HEAD}\n\n{latest}"])


def test_a_delivered_message_is_its_senders(spark):
    long = "please keep the export button where it is for now"
    df = spark.createDataFrame([(f"[web] sam: {long}",), (f"[web] kit of api about tests: {long}",)], "raw string")
    j = [r["j"] for r in df.select(owner.judge(F.col("raw"), owner_names=("Sam",)).alias("j")).collect()]
    assert {(x["text"], x["reason"]) for x in j} == {(long, None), (None, "delivered-by-agent")}


def test_paths_that_name_nothing_give_null(spark):
    df = spark.createDataFrame([("test", "/opt/x"), (None, "/home/jo/src/x")], "src string, file string")
    rows = df.select(paths.parse_src(F.col("src")).alias("s"), paths.home_of(F.col("file"), "/home/jo").alias("h")).collect()
    assert all(r["s"] is None and r["h"] is None for r in rows)


def test_a_statement_without_a_card_is_not_rendered(spark):
    df = spark.range(1).select(F.lit("t").alias("t"), F.lit(None).cast("string").alias("none"), F.current_timestamp().alias("ts"))
    c = F.col
    assert df.select(render.card_lines(c("t"), c("ts"), c("none"), c("none"), c("none"), c("none"), c("none"))).first()[0] is None


def _plain(t):
    """Prose of a text by a walk over its lines."""
    t = re.sub("|".join(rf"<{w}\b[^>]*>.*?(?:</{w}>|\Z)" for w in WRAPPERS), "\n", t, flags=re.S | re.I)
    out, fence = [], None
    for line in t.split("\n"):
        mark = line.lstrip(" \t")[:3]
        if fence is None and mark in ("```", "~~~"):
            fence = mark
            out.append("")
        elif fence is not None:
            fence = None if mark == fence else fence
        else:
            out.append(line)
    t = re.sub(r"\[([^\]\n]*)\]\((?:https?|ftp|file)://[^)\s]*\)", r"\1", "\n".join(out))
    t = re.sub(r"\S{81,}", "", re.sub(r"\b(?:https?|ftp|wss?|file)://\S+", "", t, flags=re.I))
    kept = []
    for line in t.split("\n"):
        numbered, diff = re.match(r"\s*\d{1,6}(?:\t|\u2192| ?\| )", line), re.match(r"diff --git |index [0-9a-f]{7,}\.\.[0-9a-f]{7,}|--- a/|\+\+\+ b/|@@ .* @@", line)
        code = re.match(r"(?: {4,}|\t)", line) and not re.match(r"\s*(?:[-*+]|\d+[.)])\s", line)
        if not (numbered or diff or code or re.match(r"\s*\$ \S", line)):
            kept.append(line.rstrip())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def test_prose_of_every_text_against_a_plain_version(spark, tmp_path):
    texts = ["a\n```js\nx\n```\nb", "see [d](https://x.y/z) https://q.r\n    code\n\t- item", "<stdout>x\ny</stdout>kept\n\n\n\nend", "", "1\tone\n2\ttwo\n$ ls\ntext", "~~~\nopen", "x" * 90 + " y", "  led \n\n"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(99, None, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["id"]: (r["chars"], r["prose_sha256"]) for r in catalog.queries()["prose_corpus"](spark, str(tmp_path)).collect()}
    want = {i: _plain(t) for i, t in [*enumerate(texts), (99, "")]}
    assert got == {i: (len(p), hashlib.sha256(p.encode()).hexdigest()) for i, p in want.items()}

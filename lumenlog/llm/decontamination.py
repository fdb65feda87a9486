"""Operator 7, benchmark decontamination by template canonicalisation, with DataFrame operations only.

1. *Canonicalise.* A word with a digit becomes `<n>` (with a unit stuck to it, `<n><u>`), a unit word
   `<u>`, a capitalised word inside a sentence `<p>`; others are lower-cased without outer marks. The
   replaced words are the slots.
2. *Join.* Items and texts give the windows of `width` words at all places, and both meet in a hash
   join. The key of a window is its template, or its own words where fewer than `LITERALS` of them
   are plain and the template says too little. Items whose plain windows cover less than `COVER` of
   them also give the plain windows of the first of the `RUNGS` that cover as much; those that have
   none (under five plain words in each 48) are found with their own slot values only. Items shorter
   than a window have the whole item as their window. An item's first word is tried as it may be read within a text.
3. *Check slots.* Within an occurrence of an item, one slot value of the item must always have become
   the same value. Windows that agree with this count towards the item's coverage. Windows of one
   occurrence lie at one shift, or at near ones where words were put in or left out: single shifts,
   bins of shifts and the whole text are tried, and the best one counts.

A pair is reported when windows cover at least `COVER` of the item's words. Null and empty texts,
items and benchmarks match nothing. Repeated rows are reported once each doc_id and item; other
columns are ignored. The benchmark side is broadcast up to `SMALL` windows and shuffled beyond.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import load, stage

WIDTH, LITERALS, COVER, SMALL = 8, 5, 0.5, 200_000
#: Wider windows for items of many slots.
RUNGS = (9, 10, 12, 16, 24, 32, 48)
#: Widths of the bins of shifts (place in the text less place in the item) that may be one occurrence.
BINS = (4, 16, 64, 256)

#: Unit words (fixed values).
UNITS = ("kg", "g", "mg", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "mile", "miles", "ft", "feet", "inch", "inches", "l", "ml", "litre", "litres", "liter", "liters", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "%", "$", "€", "°c", "°f", "kmh", "mph")


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _template(words: Column) -> Column:
    """The canonical word for each word of an array column."""
    marks = F.lit("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$%") + "«»„“”‚‘’…¿¡–—")

    def one(w: Column, i: Column) -> Column:
        before = F.try_element_at(words, F.when(i > 0, i))
        low = F.lower(w)
        b = F.btrim(low, marks)
        inside = (i > 0) & ~before.rlike("[.!?:][\"')\\]]*$")
        return (
            F.when(w.rlike("[0-9]"), F.when(w.rlike("[0-9][\\p{L}%°€$]+[.,;:!?]*$|^[$€]"), "<n><u>").otherwise("<n>"))
            .when((w != low) & inside & w.rlike("^[^\\p{L}\\p{N}]*\\p{Lu}\\p{Ll}"), "<p>")  # the cheap test first
            .when(b.isin(*UNITS) & (i > 0) & before.rlike("[0-9]"), "<u>")
            .otherwise(b)
        )

    return F.transform(words, one)


def _hashes(template: Column) -> Column:
    return F.transform(template, lambda w: F.xxhash64(w))


def _heavy(n: Column, at: Column, width: Column) -> Column:
    """The places whose window has too few plain words, from the sorted places of the slots."""
    most = width - F.least(width, F.lit(LITERALS)) + 1  # slots that make a window heavy
    ends = F.transform(F.sequence(F.lit(0), F.size(at) - most), lambda k: F.struct(F.get(at, k).alias("first"), F.get(at, k + most - 1).alias("last")))
    dense = F.filter(ends, lambda e: e["last"] - e["first"] < width)
    places = F.transform(dense, lambda e: F.sequence(F.greatest(e["last"] - width + 1, F.lit(0)), F.least(e["first"], n - width)))
    return F.when((n >= width) & (F.size(at) >= most), F.array_distinct(F.flatten(places))).otherwise(F.array().cast("array<int>"))


def _windows(df: DataFrame, widths: list[Column]) -> DataFrame:
    """df (words, t) with n, the count of words, and x: (at, w, light, h, slots) of all windows of the widths, at every place; t is the template."""
    df = df.withColumn("n", F.size("words")).withColumn("hashes", _hashes(F.col("t")))
    df = df.withColumn("slots_at", F.filter(F.transform("t", lambda t, i: F.when(t.startswith("<"), i)), lambda i: i.isNotNull()))
    df = df.withColumns({f"heavy{k}": _heavy(F.col("n"), F.col("slots_at"), w) for k, w in enumerate(widths)})
    df = df.withColumn("slots", F.when(F.size("slots_at") > 0, _slots(F.col("words"), F.col("t"))))
    some = functools.reduce(Column.__or__, [F.size(f"heavy{k}") > 0 for k in range(len(widths))])
    df = df.withColumn("own", F.when(some, _hashes(F.zip_with("slots", "t", lambda s, t: F.coalesce(s, t)))))

    def of(places: Column, w: Column, light: bool) -> Column:
        def one(p: Column) -> Column:
            h = F.xxhash64(F.slice("hashes", p + 1, w)) if light else F.xxhash64(F.slice("own", p + 1, w), F.lit("own"))
            return F.struct(p.alias("at"), w.alias("w"), F.lit(light).alias("light"), h.alias("h"), F.slice("slots", p + 1, w).alias("slots"))

        return F.transform(places, one)

    parts = []
    for k, w in enumerate(widths):
        every = F.when(F.col("n") >= w, F.sequence(F.lit(0), F.col("n") - w)).otherwise(F.array().cast("array<int>"))
        heavy = F.col(f"heavy{k}")
        parts += [of(F.when(F.size(heavy) > 0, F.array_except(every, heavy)).otherwise(every), w, True), of(heavy, w, False)]
    return df.withColumn("x", F.explode(F.concat(*parts))).drop("hashes", "slots_at", "slots", "own", *(f"heavy{k}" for k in range(len(widths))))


def _slots(words: Column, template: Column) -> Column:
    """Each word where its template is a placeholder, else null."""
    return F.zip_with(words, template, lambda w, t: F.when(t.startswith("<") & t.endswith(">"), F.lower(F.regexp_replace(w, "[.,;:!?\"')\\]]+$", ""))))


def _item_keys(bench: DataFrame, width: int, cover: float) -> DataFrame:
    """item_id, n, w, item_at, h and item_slots for each window that stands for an item."""
    items = bench.where(F.col("item_id").isNotNull()).select("item_id", _words("text").alias("words")).where(F.size("words") > 0).withColumn("n", F.size("words")).withColumn("t", _template(F.col("words")))
    # within a text, an item's first word may be read as a name or a unit
    first, rest = F.get("t", F.lit(0)), F.slice("t", 2, F.greatest(F.col("n") - 1, F.lit(0)))
    name = F.get("words", F.lit(0)).rlike("^[^\\p{L}\\p{N}]*\\p{Lu}\\p{Ll}") & ~first.startswith("<")
    heads = F.filter(F.array(first, F.when(name, "<p>"), F.when(first.isin(*UNITS), "<u>")), lambda h: h.isNotNull())
    items = items.select("item_id", "words", F.explode(F.transform(heads, lambda h: F.concat(F.array(h), rest))).alias("t")).dropDuplicates(["item_id", "words", "t"])
    rungs = F.array(*map(F.lit, (width, *(r for r in RUNGS if r > width))))
    items = items.withColumn("w", F.explode(F.when(F.size("words") < width, F.array(F.size("words"))).otherwise(F.filter(rungs, lambda r: r <= F.size("words")))))
    keys = stage(_windows(items, [F.col("w")]).drop("w"), "windows")
    # the narrowest windows that are plain enough in half of the item
    reach = keys.where("x.light").select("item_id", "words", "t", "n", "x.w", F.explode(F.sequence(F.col("x.at"), F.col("x.at") + F.col("x.w") - 1)).alias("k")).groupBy("item_id", "words", "t", "n", "w").agg(F.countDistinct("k").alias("k"))
    most = reach.where(F.col("k") >= F.ceil(F.col("n") * cover)).groupBy("item_id", "words", "t").agg(F.min("w").alias("most"))
    keys = keys.join(most, ["item_id", "words", "t"], "left").where((F.col("x.w") <= width) | F.col("x.light") & (F.col("x.w") == F.col("most")))
    return keys.select("item_id", "n", "x.w", F.col("x.at").alias("item_at"), "x.h", F.coalesce("x.slots", F.array().cast("array<string>")).alias("item_slots")).dropDuplicates()


def decontaminate(docs: DataFrame, bench: DataFrame, width: int = WIDTH, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, covered and item_words (words of the item covered, and all) for each contaminated pair."""
    keys = stage(_item_keys(bench, width, cover), "bench")
    count = keys.groupBy("w").count().collect()  # at most `width` rows and one for each rung
    small = sum(r["count"] for r in count) <= SMALL
    if not count:
        return docs.where("1 = 0").select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("item_words"))
    t = docs.where(F.col("text").isNotNull()).select("doc_id", _words("text").alias("words")).withColumn("t", _template(F.col("words")))
    windows = _windows(t, [F.lit(w) for w in sorted(r["w"] for r in count)]).select("doc_id", F.col("x.at").alias("at"), F.col("x.w").alias("w"), F.col("x.h").alias("h"), F.col("x.slots").alias("slots"))
    own = keys.drop("n")
    found = windows.join(F.broadcast(own) if small else own, ["h", "w"]).drop("h")
    # the slots come with the windows: a second look at the texts would shuffle them
    zipped = F.arrays_zip(F.col("item_slots").alias("item"), F.coalesce("slots", F.array().cast("array<string>")).alias("doc"))
    pair = F.array_distinct(F.filter(zipped, lambda p: p["item"].isNotNull())).alias("pair")
    both = stage(found.select("doc_id", "item_id", "item_at", "w", (F.col("at") - F.col("item_at")).alias("shift"), pair).dropDuplicates(), "hits")
    # each occurrence on its own: hits of one shift, of shifts in a bin (two bins' borders lie apart), and of the whole text
    span = both.groupBy("doc_id", "item_id").agg((F.min("shift") < F.max("shift")).alias("many"))
    bins = [F.struct(F.lit(0).alias("size"), F.col("shift").cast("long").alias("bin"))]
    for size in BINS:
        bins += [F.struct(F.lit(s).alias("size"), F.floor((F.col("shift") + off) / F.lit(size)).alias("bin")) for s, off in ((size, 0), (-size, size // 2))]
    bins.append(F.struct(F.lit(1).alias("size"), F.lit(0).cast("long").alias("bin")))
    by = ["doc_id", "item_id", "part"]
    both = both.join(span, ["doc_id", "item_id"]).withColumn("part", F.explode(F.when(F.col("many"), F.array(*bins)).otherwise(F.array(bins[0]))))
    # an item's slot value takes the value that most windows give it; windows that say otherwise don't count
    votes = both.select(*by, F.explode("pair").alias("p")).groupBy(*by, F.col("p.item").alias("item"), F.col("p.doc").alias("doc")).agg(F.count("*").alias("n"))
    said = votes.groupBy(*by, "item").agg(F.max_by("doc", F.struct("n", "doc")).alias("doc"))
    map_of = said.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("item", "doc"))).alias("value"))  # as many as an item has slots
    agree = both.join(map_of, by, "left").where(F.forall("pair", lambda p: p["doc"].eqNullSafe(F.col("value")[p["item"]])))
    words = agree.select(*by, F.explode(F.sequence(F.col("item_at"), F.col("item_at") + F.col("w") - 1)).alias("k")).groupBy(*by).agg(F.countDistinct("k").alias("covered"))
    words = words.groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))
    sizes = keys.groupBy("item_id").agg(F.max("n").cast("long").alias("item_words"))
    return words.join(sizes, "item_id").where(F.col("covered") >= F.ceil(F.col("item_words") * cover)).select("doc_id", "item_id", "covered", "item_words")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))

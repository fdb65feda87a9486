"""Aggregates over the engine's own logs: turns, spend, counters, sessions, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.order import total_order

HOOKS = ("prompt", "stop")


def log_summary(lines: DataFrame) -> DataFrame:
    """Counts of hook lines by event, outcome, host, silent reason and error in one pass: (dimension, value, n)."""
    hook = lines.where(F.col("event").isin(*HOOKS))
    reason = F.when((F.col("outcome") == "silent") & F.col("reason").isNotNull(), F.col("reason"))
    error = F.when(F.col("level") == "error", F.coalesce("reason", F.lit("error")))
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("value")) for n, c in (("event", F.col("event")), ("outcome", F.coalesce("outcome", F.lit("?"))), ("host", F.col("host")), ("silent", reason), ("error", error))])
    return hook.select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def gate_totals(lines: DataFrame) -> DataFrame:
    """Turns where the second gate ran, and sums of what it saw, passed, picked and got no answer for."""
    ran = lines.where((F.col("event") == "prompt") & F.col("survivors").isNotNull())
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return ran.agg(F.count("*").alias("turns"), s("survivors").alias("survivors"), s("passed").alias("passed"), s("selected").alias("injected"), s("refused").alias("no_answer"))


def excluded_totals(lines: DataFrame) -> DataFrame:
    """Per rule of the map `excluded`: turns, and statements summed over turns."""
    return lines.select(F.explode("excluded").alias("reason", "count")).groupBy("reason").agg(F.count("*").alias("turns"), F.sum("count").alias("statements"))


def span(lines: DataFrame) -> DataFrame:
    """First and last time in file order."""
    return lines.agg(F.min_by("ts", F.struct("day", "line")).alias("first"), F.max_by("ts", F.struct("day", "line")).alias("last"))


def spend_daily(ledger: DataFrame) -> DataFrame:
    """Cost of each UTC day and of all; rows without a number or a time count as skipped."""
    ok = F.col("cost").isNotNull() & ~F.isnan("cost") & F.col("ts").isNotNull()
    day = F.when(ok, F.date_format("ts", "yyyy-MM-dd"))
    return ledger.groupBy(day.alias("day")).agg(F.round(F.sum(F.when(ok, F.col("cost"))), 6).alias("usd"), F.count_if(ok).alias("entries"), F.count_if(~ok).alias("skipped"))


def spend_hourly(ledger: DataFrame) -> DataFrame:
    """24 rows for every day of the ledger, hours without cost at 0."""
    spent = ledger.where(F.col("cost").isNotNull() & F.col("ts").isNotNull()).groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.sum("cost").alias("usd"))
    dense = spent.select("day").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return dense.join(spent, ["day", "hour"], "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "hour", F.round(F.coalesce("usd", F.lit(0.0)), 6).alias("usd"))


def day_counters(lines: DataFrame) -> DataFrame:
    """Per day: hook firings by what they did, and their cost."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out, ev = F.col("outcome"), F.col("event")
    return lines.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("fired"), n(ev == "prompt").alias("prompts"), n(ev == "stop").alias("stops"), n(F.col("candidates") > 0).alias("searched"),
        n(out == "injected").alias("injected_turns"), F.coalesce(F.sum(F.when(out == "injected", F.col("injected"))), F.lit(0)).cast("long").alias("injected_statements"),
        n(out == "blocked").alias("blocked"), n((out == "silent") & (F.col("reason") == "cap-reached")).alias("capped"), n(F.col("level") == "error").alias("errors"),
        n((out == "silent") & F.col("reason").startswith("skip:")).alias("skipped"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost"),
    )


def reason_counts(lines: DataFrame, since: object) -> DataFrame:
    """Reasons at or after a time, most frequent first, with their place."""
    kept = lines.where((F.col("ts") >= F.lit(since)) & F.col("reason").isNotNull() & ~F.coalesce(F.col("outcome") == "blocked", F.lit(False)))
    n = kept.groupBy("event", "reason").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "reason", "event")))  # a handful of reasons


def active_sessions(lines: DataFrame, now: object, minutes: int = 30) -> DataFrame:
    """Sessions with a line in the last minutes and any line a person caused; their newest non-null attributes."""
    person = ~F.coalesce(F.col("reason").rlike("^(headless:|unknown:|child$)"), F.lit(False))
    at = F.struct("ts", "at")
    s = lines.groupBy("session_id").agg(F.max("ts").alias("last"), F.count("*").alias("lines"), F.max_by("host", F.when(F.col("host").isNotNull(), at)).alias("host"), F.max_by("project", F.when(F.col("project").isNotNull(), at)).alias("project"), F.bool_or(person).alias("person"))
    return s.where(F.col("person") & (F.col("last") >= F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))).drop("person")


def cap_replay(ledger: DataFrame, daily: float, total: float) -> DataFrame:
    """What had been spent before each call, that day and in all, and whether a cap stops it.

    Running sums are taken per day; the days before enter through their totals, so no task sees the whole ledger.
    """
    day = F.to_date("ts")
    w = Window.partitionBy("day").orderBy("ts", "at").rowsBetween(Window.unboundedPreceding, -1)
    t = ledger.withColumn("day", day)
    days = t.groupBy("day").agg(F.sum("cost").alias("cost"))
    prior = days.withColumn("before_day", F.coalesce(F.sum("cost").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("day", "before_day")  # a row a day
    r = t.withColumn("day_spent", F.coalesce(F.sum("cost").over(w), F.lit(0.0))).join(F.broadcast(prior), "day")
    r = r.withColumn("all_spent", F.col("before_day") + F.col("day_spent"))
    scope = F.when(F.round("day_spent", 6) >= daily, "daily").when(F.round("all_spent", 6) >= total, "total")
    return r.select("at", F.round("day_spent", 6).alias("day_spent"), F.round("all_spent", 6).alias("all_spent"), scope.alias("capped"))


def reserved(reservations: DataFrame, now: object, minutes: int = 10) -> DataFrame:
    """Sum of reservations that are still live."""
    live = (F.col("ts") > F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= F.lit(now))
    return reservations.where(live).agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 6).alias("usd"))


def multiset(rows: DataFrame, by: list[str], name: str, order: str, most: int = 8) -> DataFrame:
    """Names with their counts in first-seen order, at most `most` of them and how many more there are: `a x2, b, +1`."""
    n = rows.groupBy(*by, name).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    k = n.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("first", name)))
    text = F.concat(F.col(name), F.when(F.col("n") > 1, F.concat(F.lit(" x"), F.col("n").cast("string"))).otherwise(""))
    shown = F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= most, F.struct("k", text.alias("t"))))), lambda x: x["t"])
    rest = F.count_if(F.col("k") > most)
    return k.groupBy(*by).agg(F.concat(F.array_join(shown, ", "), F.when(rest > 0, F.concat(F.lit(", +"), rest.cast("string"))).otherwise("")).alias("marker"))


def index_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids of two indexes (id, hash): added, removed, changed, kept, with counts."""
    j = before.select("id", F.col("hash").alias("old")).join(after.select("id", F.col("hash").alias("new")), "id", "full_outer")
    action = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("kept")
    return j.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


def dry_run(found: DataFrame, indexed: DataFrame, embedded: DataFrame, files: DataFrame) -> DataFrame:
    """What an index pass would do, without doing it: (section, key, statements, added).

    found (id, hash, source, peeled, chars): what the scan makes; indexed (id, hash, file): what is held; embedded (hash);
    files (file): those that are there. Sections: source and peel (found, and of them not indexed), index (kept, added, changed,
    removed), gone (removed whose file is gone, or still there), embed (distinct texts to embed, and their characters).
    """
    new = found.join(indexed.select("id", F.col("hash").alias("held")), "id", "left").withColumn("new", F.col("held").isNull())
    line = lambda section, key, n, added=None: [F.lit(section).alias("section"), key.alias("key"), n.cast("long").alias("statements"), (F.lit(None) if added is None else added).cast("long").alias("added")]
    counted = lambda rows, section, key: rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.count_if("new").alias("a")).select(*line(section, F.col("key"), F.col("n"), F.col("a")))
    by_source = counted(new, "source", F.col("source"))
    by_peel = counted(new.select("new", F.explode("peeled").alias("peel")), "peel", F.col("peel"))
    diff = index_diff(indexed, found).select(*line("index", F.col("action"), F.col("n")))
    removed = indexed.join(found.select("id"), "id", "left_anti").join(files.select("file").distinct().withColumn("there", F.lit(True)), "file", "left")
    gone = removed.groupBy(F.when(F.col("there"), "file-present").otherwise("file-gone").alias("key")).agg(F.count("*").alias("n")).select(*line("gone", F.col("key"), F.col("n")))
    todo = found.join(embedded.select("hash").distinct(), "hash", "left_anti").groupBy("hash").agg(F.max("chars").alias("chars")).agg(F.count("*").alias("texts"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"))
    embed = todo.select(F.explode(F.array(F.struct(F.lit("texts").alias("key"), F.col("texts").alias("n")), F.struct(F.lit("chars").alias("key"), F.col("chars").alias("n")))).alias("x")).select(*line("embed", F.col("x.key"), F.col("x.n")))
    return by_source.union(by_peel).union(diff).union(gone).union(embed)


#: Prices per million tokens, and those beyond the long threshold (our defaults; a parameter).
PRICES = {"embed": (0.02, 0.02), "judge": (0.05, 0.10)}


def estimate_tokens(s: Column, overhead: int = 0) -> Column:
    return F.ceil(F.length(s) / 3) + overhead


def cost_usd(endpoint: Column, tokens: Column, long_from: int = 200_000, prices: dict | None = None) -> Column:
    out = F.lit(None).cast("double")
    for name, (short, long) in (prices or PRICES).items():
        out = F.when(endpoint == name, tokens * F.when(tokens > long_from, long).otherwise(short) / 1e6).otherwise(out)
    return out


def usage_order(homes: DataFrame, usage: DataFrame) -> DataFrame:
    """Homes by headroom: the worst window's used share, then pace, then path; homes without a row last."""
    worst = usage.groupBy("home").agg(F.max("used").alias("used"), F.max_by("label", F.struct("used", "label")).alias("window"), F.max(F.col("used") / F.greatest("elapsed", F.lit(1.0))).alias("pace"))
    return total_order(homes.join(worst, "home", "left"), [], F.asc_nulls_last("used"), F.asc_nulls_last("pace"), F.asc("home"), name="place")


def busiest_hour(hourly: DataFrame) -> DataFrame:
    """The hour with the most, the first on a tie, for each day."""
    return hourly.groupBy("day").agg(F.max_by("hour", F.struct(F.col("usd"), -F.col("hour"))).cast("int").alias("hour"), F.max("usd").alias("usd"))


def island_label(runs: DataFrame, by: list[str], reason: str = "reason", top: int = 3) -> DataFrame:
    """For each run its rows, and its most frequent reasons as `reason xN`."""
    n = runs.groupBy(*by, reason).agg(F.count("*").alias("n"))
    k = n.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), reason)))
    text = F.concat(F.col(reason), F.lit(" x"), F.col("n").cast("string"))
    labels = F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= top, F.struct("k", text.alias("t"))))), lambda x: x["t"])
    return k.groupBy(*by).agg(F.sum("n").alias("rows"), F.array_join(labels, ", ").alias("label"))

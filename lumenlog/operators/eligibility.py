"""Which statements a query may see: time, exclusions, cards, precision rules. Filters come before any rank or statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.repo import same_repo
from lumenlog.functions.text import cites_location

EXCLUDED_KINDS, CROSS_REPO_KINDS, DIRECTIVES = ("question", "status"), ("rule", "preference"), ("rule", "preference")
CROSS_REPO_CHARS, RULE_CHARS = 300, 500
REASONS = ("gist-placeholder", "cites-location", "cross-repo-long", "long-directive")


def point_in_time(pairs: DataFrame) -> DataFrame:
    """Rows (micros, decision, session_id, exclude_session) strictly before the decision and not of the excluded session."""
    other = F.col("exclude_session").isNull() | (F.col("session_id") != F.col("exclude_session")) | F.col("session_id").isNull()
    return pairs.where((F.col("micros") < F.col("decision")) & other)


#: Cases that are sent to every task at once; a larger batch is dealt over blocks of about as many.
BATCH = 10_000


def in_batches(cases: DataFrame, rows: DataFrame, on: Column, most: int = BATCH) -> DataFrame:
    """rows joined to cases by a condition without equal keys: cases are sent to all tasks where they are counted and few,
    else rows are repeated once a block of cases and meet one block each."""
    n = cases.count()
    if n <= most:
        return rows.join(F.broadcast(cases), on)
    blocks = -(-n // most)
    numbered = cases.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    repeated = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return repeated.join(numbered, "_block").where(on).drop("_block")


def visible(cases: DataFrame, statements: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Each case (query_id, decision, exclude_session, ...) with the statements it may see; excluded: (query_id, id)."""
    both = point_in_time(in_batches(cases, statements, F.col("micros") < F.col("decision")))
    return both if excluded is None else both.join(excluded, ["query_id", "id"], "left_anti")


def card_allowed(exclude: tuple[str, ...] = EXCLUDED_KINDS, scope: bool = True, aliases: dict[str, str] | None = None) -> Column:
    """Of rows with kind, scope, repo, current_repo: no card is never allowed; another repo's only if global and a rule or preference."""
    if not exclude and not scope:
        return F.lit(True)
    ok = F.col("kind").isNotNull()
    if exclude:
        ok = ok & ~F.col("kind").isin(*exclude)
    if scope:
        crosses = (F.col("scope") == "global") & F.col("kind").isin(*CROSS_REPO_KINDS)
        ok = ok & (same_repo(F.col("repo"), F.col("current_repo"), aliases) | F.coalesce(crosses, F.lit(False)))
    return F.coalesce(ok, F.lit(False))


def precision_reason(placeholder: bool = True, citations: bool = True, cross_repo_chars: int = CROSS_REPO_CHARS, rule_chars: int = RULE_CHARS, aliases: dict[str, str] | None = None, cites: Column | None = None, chars: Column | None = None) -> Column:
    """The first precision rule that keeps a row (gist_source, text, kind, repo, current_repo) out, or null.

    cites and chars: what cites_location and length give for the text, where rows no longer have it.
    """
    cites = cites_location(F.col("text")) if cites is None else cites
    chars = F.length("text") if chars is None else chars
    rules: list[tuple[Column, str]] = []
    if placeholder:
        rules.append((F.col("gist_source") == "none", REASONS[0]))
    if citations:
        rules.append((cites, REASONS[1]))
    if cross_repo_chars > 0:
        rules.append(((chars >= cross_repo_chars) & ~same_repo(F.col("repo"), F.col("current_repo"), aliases), REASONS[2]))
    if rule_chars > 0:
        rules.append((F.col("kind").isin(*DIRECTIVES) & (chars >= rule_chars), REASONS[3]))
    out = F.lit(None).cast("string")
    for hit, reason in reversed(rules):
        out = F.when(hit, reason).otherwise(out)
    return out


def tally(rows: DataFrame, by: list[str], reason: str = "reason", order: tuple[str, ...] = ("micros", "id"), newest: int = 50) -> DataFrame:
    """How many rows each reason kept out, and the newest ids, oldest of them first.

    The list is cut before it is collected, so it never holds more than `newest` ids.
    """
    w = Window.partitionBy(*by, reason).orderBy(*[F.desc(c) for c in order])
    counts = rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("n"))
    last = rows.where(F.col(reason).isNotNull()).withColumn("k", F.row_number().over(w)).where(F.col("k") <= newest)
    ids = last.groupBy(*by, reason).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col("k"), F.col("id"))), False), lambda x: x["id"]).alias("ids"))
    return counts.join(ids, [*by, reason])


def latest(rows: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """The last row of each key: later cards replace earlier ones."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(*keys, "x.*")


def card_problems(kinds: tuple[str, ...], scopes: tuple[str, ...], max_words: int = 20) -> Column:
    """What is wrong with a card row (id, kind, scope, scope_repo, gist)."""
    gist = F.trim(F.regexp_replace(F.coalesce("gist", F.lit("")), r"\s+", " "))
    checks = [
        (F.coalesce(F.col("id") == "", F.lit(True)), "id is missing"), (~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "kind is unknown"),
        (~F.coalesce(F.col("scope").isin(*scopes), F.lit(False)), "scope is unknown"), ((F.col("scope") == "global") & F.col("scope_repo").isNotNull(), "a global card names a repo"),
        (gist == "", "gist is empty"), (F.size(F.split(gist, " ")) > max_words, "gist is too long"),
    ]
    return F.filter(F.array(*[F.when(hit, text) for hit, text in checks]), lambda x: x.isNotNull())


def checked_answers(entries: DataFrame, batches: DataFrame) -> DataFrame:
    """Answers (batch, n, ok) of batches (batch, size): one row a number with its verdict.

    stray: not a number of its batch; repeated: answered more than once, whatever the answers; bad: not ok; else good.
    """
    seen = entries.groupBy("batch", "n").agg(F.count("*").alias("times"), F.bool_and("ok").alias("ok")).join(batches, "batch")
    inside = F.coalesce(F.col("n").between(1, F.col("size")), F.lit(False))
    verdict = F.when(~inside, "stray").when(F.col("times") > 1, "repeated").when(F.col("ok"), "good").otherwise("bad")
    return seen.select("batch", "n", "times", verdict.alias("verdict"))


def attended(kind: Column, scheduled: Column, attended: Column, entrypoint: Column, origin: Column, human: Column) -> Column:
    """The verdict on a session of the host that says itself whether a person is there: interactive only on positive evidence.

    kind, scheduled, attended: the host's settings; entrypoint, origin, human (origin kind): of the newest user record, or null.
    """
    told = lambda why, x: F.concat(F.lit(why), x)
    return (
        F.when(kind.isin("bg", "daemon", "daemon-worker"), told("headless:claude-session-kind-", kind)).when(scheduled.isNotNull() & ~scheduled.isin("", "0"), "headless:claude-scheduled-run")
        .when(attended == "0", "headless:claude-unattended").when(entrypoint.startswith("sdk-"), told("headless:claude-transcript-entrypoint-", entrypoint))
        .when((origin == "sdk") & ~F.coalesce(human == "human", F.lit(False)), "headless:claude-transcript-turn-origin-sdk").when(attended == "1", "interactive:claude-attended")
        .when(attended.isNotNull(), "unknown:claude-attended-value").when(human == "human", "interactive:claude-transcript-human").otherwise("unknown:claude-no-attendance-signal")
    )

"""Queries over conversations: excerpts, the live index, what is still visible, who drives a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.functions import feed
from lumenlog.functions.text import norm, ts_micros
from lumenlog.operators import analytics
from lumenlog.operators import excerpts as X
from lumenlog.plans import stand_ins as T
from lumenlog.plans.catalog import query
from lumenlog.sources import transcripts


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a host's transcript: each turn twice, as an event and as a plain copy, and tool groups between some."""
    c = T.table(spark, sf, "conversations").where("text is not null")
    turn = lambda at, kind: c.select(F.col("conv_id").alias("file"), (F.col("turn") * 10 + at).alias("line"), F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), F.lit(kind).alias("kind"), "text", F.lit(None).cast("array<string>").alias("tools"))
    none = F.lit(None).cast("string")
    tools = lambda at, every, name: c.where(F.col("turn") % every == 0).select(F.col("conv_id").alias("file"), (F.col("turn") * 10 + at).alias("line"), none.alias("role"), none.alias("kind"), none.alias("text"), F.array(name).alias("tools"))
    return turn(0, "event").union(turn(1, "fallback")).union(tools(1, 2, F.concat(F.lit("t"), (F.col("turn") % 4).cast("string")))).union(tools(3, 3, F.lit("u")))


_ITEMS_SQL = """c AS (SELECT conv_id AS file, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations WHERE text IS NOT NULL),
it AS (SELECT file, turn * 10 AS line, 0 AS tool, role, 'event' AS kind, text, NULL AS name FROM c UNION ALL SELECT file, turn * 10 + 1, 0, role, 'fallback', text, NULL FROM c
  UNION ALL SELECT file, turn * 10 + 1, 1, NULL, NULL, NULL, 't' || (turn % 4) FROM c WHERE turn % 2 = 0 UNION ALL SELECT file, turn * 10 + 3, 1, NULL, NULL, NULL, 'u' FROM c WHERE turn % 3 = 0),
tu AS (SELECT *, row_number() OVER (PARTITION BY file, kind ORDER BY line) AS place FROM it WHERE tool = 0),
tg AS (SELECT file * 100000 + line AS target_id, file, line, kind, place FROM tu WHERE role = 'user' AND (line % 20 IN (0, 11)))"""


@query(
    "excerpts",
    f"""WITH {_ITEMS_SQL}, w AS (SELECT tg.*, lo.line AS from_line, hi.line AS to_line FROM tg JOIN tu lo ON lo.file = tg.file AND lo.kind = tg.kind AND lo.place = greatest(1, tg.place - 2) LEFT JOIN tu hi ON hi.file = tg.file AND hi.kind = tg.kind AND hi.place = tg.place + 1),
  n AS (SELECT target_id, it.line * 2 + tool AS o, it.line, tool, it.role, name, it.line = w.line AND tool = 0 AS recalled, text FROM w JOIN it ON it.file = w.file AND it.line >= from_line AND (to_line IS NULL OR it.line <= to_line) AND (tool = 1 OR it.kind = w.kind)),
  g AS (SELECT *, CASE WHEN tool = 1 AND lag(tool) OVER (PARTITION BY target_id ORDER BY o) = 1 THEN 0 ELSE 1 END AS opens FROM n), r AS (SELECT *, sum(opens) OVER (PARTITION BY target_id ORDER BY o) AS run FROM g)
SELECT target_id, run::INT AS pos, max(role) AS role, min(line) AS line, max(length(text)) AS chars, string_agg(name, ',' ORDER BY o) AS tools, bool_or(recalled) AS recalled FROM r GROUP BY target_id, run""",
)
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Two turns before and one after each owner's turn, in one copy of each turn, with tool groups merged."""
    items = _items(spark, sf)
    t = items.where("role = 'user' and line % 20 in (0, 11)").select((F.col("file") * 100000 + F.col("line")).alias("target_id"), "file", "line", F.col("text").alias("statement"))
    return X.excerpts(items, t, 2, 1).select("target_id", "pos", "role", "line", F.length("text").alias("chars"), F.array_join("tools", ",").alias("tools"), "recalled")


@query(
    "corpus_to_live_index",
    f"""WITH {T.STATEMENTS}, l AS (SELECT id, host, micros, {T.norm_sql('text')} AS said, 'f' || (id % 9) || ':L' || id AS src FROM s WHERE id % 4 > 0 UNION ALL SELECT id + 1000000, host, micros, {T.norm_sql('text')}, 'g:L' || id FROM s WHERE id % 8 = 3),
  k AS (SELECT host, micros, said, max_by(src, id) AS live FROM l GROUP BY ALL), o AS (SELECT id, host, micros, {T.norm_sql("text || '  '")} AS said, CASE WHEN id % 5 = 0 THEN 'own:L' || id END AS own FROM s)
SELECT id, coalesce(own, live) AS src, CASE WHEN own IS NOT NULL THEN 'transcript' WHEN live IS NOT NULL THEN 'index' END AS via FROM o LEFT JOIN k USING (host, micros, said)""",
)
def corpus_to_live_index(spark: SparkSession, sf: str) -> DataFrame:
    """Statements of an older corpus found in the index by host, text and time; some name their line themselves."""
    s = T.statements(spark, sf)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    id_ = F.col("id").cast("string")
    live = s.where("id % 4 > 0").select("id", "host", "micros", "text", text("f", (F.col("id") % 9).cast("string"), ":L", id_).alias("src"))
    live = live.union(s.where("id % 8 = 3").select(F.col("id") + 1000000, "host", "micros", "text", text("g:L", id_)))
    old = s.select("id", "host", "micros", text(F.col("text"), "  ").alias("text"), F.when(F.col("id") % 5 == 0, text("own:L", id_)).alias("src"))
    return X.in_live_index(old, live).select("id", "src", "via")


@query(
    "visible_set",
    f"""WITH {T.STATEMENTS}, n AS (SELECT *, {T.norm_sql('text')} AS said FROM s), q AS (SELECT item_id AS query_id, item_id % 61 AS session_id, CASE WHEN item_id % 3 > 0 THEN 300 + item_id END AS boundary_line, CASE WHEN item_id % 3 > 0 THEN {T.EPOCH} + (item_id * 5 + 60) * {T.MINUTE} END AS boundary_micros FROM benchmark),
  p AS (SELECT q.*, n.said AS prompt FROM q LEFT JOIN n ON n.id = q.query_id), t AS (SELECT session_id, id, (id * 7) % 600 AS line FROM s WHERE id % 2 = 0),
  pl AS (SELECT query_id, t.id, bool_or(line < boundary_line) AS hidden, bool_or(line >= boundary_line) AS shown FROM t JOIN p ON p.session_id = t.session_id WHERE boundary_line IS NOT NULL GROUP BY ALL),
  ca AS (SELECT DISTINCT session_id, sha256(text) AS h FROM s WHERE id % 7 = 1),
  o AS (SELECT p.query_id, n.id FROM n JOIN p USING (session_id) LEFT JOIN pl ON pl.query_id = p.query_id AND pl.id = n.id LEFT JOIN ca ON ca.session_id = n.session_id AND ca.h = sha256(n.text)
    WHERE boundary_line IS NULL OR ca.h IS NOT NULL OR (NOT coalesce(hidden, false) AND micros >= boundary_micros))
SELECT query_id, id FROM o UNION SELECT query_id, id FROM pl WHERE shown UNION SELECT query_id, n.id FROM n JOIN p ON p.prompt = n.said WHERE p.prompt <> ''""",
)
def visible_set(spark: SparkSession, sf: str) -> DataFrame:
    """What each case's session still sees after a compaction: by place, else by time, carried over, or said by the prompt."""
    s = T.statements(spark, sf).withColumn("said", norm(F.col("text"))).withColumn("text_hash", F.sha2("text", 256))
    i, known = F.col("item_id"), F.col("item_id") % 3 > 0
    q = T.table(spark, sf, "benchmark").select(i.alias("query_id"), (i % 61).alias("session_id"), F.when(known, 300 + i).alias("boundary_line"), F.when(known, F.lit(T.EPOCH) + (i * 5 + 60) * T.MINUTE).alias("boundary_micros"))
    q = q.join(s.select(F.col("id").alias("query_id"), "said"), "query_id", "left")
    turns = s.where("id % 2 = 0").select("session_id", "id", (F.col("id") * 7 % 600).alias("line"))
    return X.still_visible(s, q, turns, s.where("id % 7 = 1").select("session_id", "text_hash"))


@query(
    "session_verdicts",
    """WITH e AS (SELECT event_id AS id, (['codex', 'code', 'other'])[event_id % 3 + 1] AS host, CASE WHEN event_id % 11 > 0 THEN 'p' END AS path, event_id % 13 > 0 AS meta, (['app', 'my_exec', 'cli'])[event_id % 5 + 1] AS originator, (['cli', 'vscode', 'exec', 'mcp'])[event_id % 6 + 1] AS source,
  CASE WHEN event_id % 17 = 0 THEN 'subagent' END AS keys, (['user', 'subagent', 'user', 'user', 'other'])[user_id % 6 + 1] AS thread FROM events),
v AS (SELECT CASE WHEN host = 'other' THEN 'unknown:host-other' WHEN path IS NULL THEN 'unknown:' || host || '-no-rollout' WHEN NOT meta THEN 'unknown:' || host || '-no-session-meta' WHEN thread = 'subagent' OR keys IS NOT NULL THEN 'headless:rollout-subagent'
  WHEN source = 'exec' OR originator = 'my_exec' THEN 'headless:rollout-exec' WHEN (host = 'codex' AND coalesce(thread, '') <> 'user') OR (thread IS NOT NULL AND thread <> 'user') THEN 'headless:rollout-thread-source-' || coalesce(thread, 'none')
  WHEN source IN ('cli', 'vscode') THEN 'interactive:rollout-' || source ELSE 'unknown:rollout-source-' || coalesce(source, 'none') END AS verdict FROM e) SELECT verdict, count(*) AS n FROM v GROUP BY verdict""",
)
def session_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as sessions of hosts with rollouts, by who drives them."""
    e = F.col("event_id")
    at = lambda n, by, *values: F.get(F.array(*map(F.lit, values)), (by % n).cast("int"))
    host = at(3, e, "codex", "code", "other")
    verdict = X.rollout_verdict(host, F.when(e % 11 > 0, "p"), e % 13 > 0, at(5, e, "app", "my_exec", "cli"), at(6, e, "cli", "vscode", "exec", "mcp"), F.when(e % 17 == 0, "subagent"), at(6, F.col("user_id"), "user", "subagent", "user", "user", "other"))
    return T.table(spark, sf, "events").select(X.session_verdict(host, F.lit(None).cast("string"), verdict).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


#: Reasons of every sort, dealt over the events by number.
_REASONS = ("disabled", "nothing-above-threshold", "cap-reached", "not-owner-text:harness", "not-owner-text:agent-completion", "headless:rollout-exec", "headless:rollout-subagent", "unknown:rollout-source-none", "retrieval-failed", "stop-hook-active", "no-violation-above-threshold", "something-new", "headless:")
_FEED = f"""f AS (SELECT event_id, user_id, event_id // 40 AS turn, CASE WHEN event_id % 2 = 0 THEN 'prompt' ELSE 'stop' END AS event, CASE WHEN event_id % 19 = 0 THEN 'injected' WHEN event_id % 23 = 0 THEN 'blocked' END AS outcome,
  CASE WHEN event_id % 7 > 0 THEN ({list(_REASONS)!r})[event_id % {len(_REASONS)} + 1] END AS reason, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'info' END AS level, event_id % 17 = 3 AS audited FROM events),
k AS (SELECT *, CASE WHEN outcome IS NOT NULL THEN outcome WHEN event = 'stop' AND audited THEN 'audited' WHEN reason IN ('nothing-above-threshold') THEN 'empty' WHEN reason = 'cap-reached' THEN 'capped' WHEN reason = 'retrieval-failed' THEN 'error'
  WHEN reason = 'no-violation-above-threshold' THEN 'audited' WHEN reason IS NOT NULL THEN 'skip' WHEN level = 'error' THEN 'error' ELSE 'skip' END AS kind FROM f)"""


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    reason = F.when(e % 7 > 0, F.get(F.array(*map(F.lit, _REASONS)), (e % len(_REASONS)).cast("int")))
    rows = T.table(spark, sf, "events").select(
        "event_id", "user_id", F.floor(e / 40).alias("turn"), F.when(e % 2 == 0, "prompt").otherwise("stop").alias("event"), F.when(e % 19 == 0, "injected").when(e % 23 == 0, "blocked").alias("outcome"),
        reason.alias("reason"), F.when(e % 5 == 0, "error").otherwise("info").alias("level"), (e % 17 == 3).alias("audited"),
    )
    return rows.withColumn("kind", feed.half_kind(*map(F.col, ("event", "outcome", "reason", "level", "audited"))))


@query(
    "reason_kinds",
    f"""WITH {_FEED} SELECT reason, CASE WHEN reason IN ('disabled') THEN 'off' WHEN reason IN ('not-owner-text:agent-completion', 'headless:rollout-subagent') THEN 'subagent' WHEN reason LIKE 'not-owner-text:_%' THEN 'not-owner' WHEN reason LIKE 'headless:_%' THEN 'automated'
  WHEN reason LIKE 'unknown:_%' THEN 'unclassified' WHEN reason = 'stop-hook-active' THEN 'followup' ELSE 'other' END AS "group", count(*) AS n, count_if(kind = 'skip')::BIGINT AS skips FROM k WHERE reason IS NOT NULL GROUP BY ALL""",
)
def reason_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons by the published table and families, with the kinds of their lines."""
    return _feed(spark, sf).where("reason is not null").groupBy("reason", feed.reason_info(F.col("reason"))["group"].alias("group")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "skip").alias("skips"))


@query(
    "shown_stops",
    f"""WITH {_FEED}, s AS (SELECT turn, user_id, event_id, kind, row_number() OVER (PARTITION BY turn, user_id ORDER BY CASE WHEN reason = 'stop-hook-active' THEN 9 ELSE CASE kind WHEN 'blocked' THEN 0 WHEN 'audited' THEN 1 WHEN 'error' THEN 2 WHEN 'capped' THEN 3 WHEN 'empty' THEN 4 WHEN 'injected' THEN 4 WHEN 'skip' THEN 5 ELSE 6 END END, event_id) AS nth
  FROM k WHERE event = 'stop') SELECT turn, user_id, event_id, kind FROM s WHERE nth = 1""",
)
def shown_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Of each turn's stops the one that its card shows."""
    stop = feed.shown_stop(F.col("kind"), F.col("reason"), F.col("event_id"), F.struct("event_id", "kind"))
    return _feed(spark, sf).where("event = 'stop'").groupBy("turn", "user_id").agg(stop.alias("s")).select("turn", "user_id", "s.event_id", "s.kind")


@query(
    "dry_run_report",
    f"""WITH {T.STATEMENTS}, x AS (SELECT id, sha256(text) AS hash, 'f' || (id % 40) AS file FROM s WHERE id % 5 > 0), f AS (SELECT id, sha256(CASE WHEN id % 7 = 0 THEN text || '!' ELSE text END) AS hash, host AS source, length(text) AS chars FROM s WHERE id % 4 > 0),
  n AS (SELECT f.*, x.id IS NULL AS new FROM f LEFT JOIN x USING (id)), p AS (SELECT new, 'app' AS peel FROM n WHERE id % 3 = 0 UNION ALL SELECT new, 'quote' FROM n WHERE id % 2 = 0),
  i AS (SELECT CASE WHEN x.id IS NULL THEN 'added' WHEN f.id IS NULL THEN 'removed' WHEN x.hash <> f.hash THEN 'changed' ELSE 'kept' END AS key FROM x FULL JOIN f ON f.id = x.id),
  g AS (SELECT CASE WHEN (x.id % 40) < 25 THEN 'file-present' ELSE 'file-gone' END AS key FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = x.id)),
  t AS (SELECT hash, max(chars) AS chars FROM f WHERE hash NOT IN (SELECT sha256(text) FROM s WHERE id % 6 > 0) GROUP BY hash)
SELECT 'source' AS section, source AS key, count(*) AS statements, count_if(new)::BIGINT AS added FROM n GROUP BY source UNION ALL SELECT 'peel', peel, count(*), count_if(new)::BIGINT FROM p GROUP BY peel
UNION ALL SELECT 'index', key, count(*), NULL FROM i GROUP BY key UNION ALL SELECT 'gone', key, count(*), NULL FROM g GROUP BY key UNION ALL SELECT 'embed', 'texts', count(*), NULL FROM t UNION ALL SELECT 'embed', 'chars', coalesce(sum(chars), 0)::BIGINT, NULL FROM t""",
)
def dry_run_report(spark: SparkSession, sf: str) -> DataFrame:
    """An index pass told beforehand: statements per source and peel, what is kept, changed and removed, what to embed."""
    s, i = T.statements(spark, sf), F.col("id")
    indexed = s.where(i % 5 > 0).select("id", F.sha2("text", 256).alias("hash"), F.concat(F.lit("f"), (i % 40).cast("string")).alias("file"))
    peeled = F.filter(F.array(F.when(i % 3 == 0, "app"), F.when(i % 2 == 0, "quote")), lambda x: x.isNotNull())
    found = s.where(i % 4 > 0).select("id", F.sha2(F.when(i % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"), F.col("host").alias("source"), peeled.alias("peeled"), F.length("text").alias("chars"))
    files = indexed.where(F.substring("file", 2, 9).cast("int") < 25).select("file")
    return analytics.dry_run(found, indexed, s.where(i % 6 > 0).select(F.sha2("text", 256).alias("hash")), files)


@query(
    "transcript_corpus",
    """WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 9 = 4 THEN 'sidechain' WHEN turn % 7 = 3 THEN 'harness' WHEN conv_id % 5 = 2 THEN 'origin-peer' WHEN conv_id % 5 <> 1 AND turn % 4 = 1 THEN 'programmatic' END AS reason FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT reason, count(*) AS n, coalesce(sum(CASE WHEN reason IS NULL THEN length(text) END), 0)::BIGINT AS chars, count(DISTINCT conv_id) AS files FROM c WHERE reason IS NOT NULL OR text <> '' GROUP BY reason""",
)
def transcript_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a host's transcript lines, texts plain or in blocks, judged line by line: what is kept, and why the rest is not."""
    c = T.table(spark, sf, "conversations").where("text is not null")
    i, t = F.col("conv_id"), F.col("turn")
    record = lambda content: F.to_json(F.struct(
        F.when(F.col("role") == "user", "user").otherwise("assistant").alias("type"), (t % 9 == 4).alias("isSidechain"), (t % 7 == 3).alias("isMeta"), F.when(i % 5 == 2, F.struct(F.lit("peer").alias("kind"))).when(i % 5 == 1, F.struct(F.lit("human").alias("kind"))).alias("origin"),
        F.when(t % 4 == 1, "sdk-cli").otherwise("cli").alias("entrypoint"), i.cast("string").alias("sessionId"), F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"), F.struct("role", content.alias("content")).alias("message"),
    ))
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    lines = c.select(i.cast("string").alias("file"), t.cast("int").alias("line_no"), F.when(t % 2 == 0, record(F.col("text"))).otherwise(record(blocks)).alias("value"))
    turns = transcripts.host_a(lines)
    return turns.groupBy(F.col("drop_reason").alias("reason")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("chars"), F.countDistinct("file").alias("files"))


@query("iso_stamps", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) // 1000 * 1000 ELSE epoch_us(ts) END AS micros FROM events WHERE ts IS NOT NULL")
def iso_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """Times written as ISO stamps, in UTC or two hours east of it, to the millisecond or beyond the microsecond, and read back."""
    ts, e = F.col("ts"), F.col("event_id")
    shown = lambda x, digits: F.date_format(x, f"yyyy-MM-dd'T'HH:mm:ss.{digits}")
    east = F.expr("ts + interval 2 hours")
    stamp = F.when(e % 3 == 0, F.concat(shown(ts, "SSS"), F.lit("Z"))).when(e % 3 == 1, F.concat(shown(east, "SSSSSS"), F.lit("+02:00"))).otherwise(F.concat(shown(ts, "SSSSSS"), F.lit("789Z")))
    return T.table(spark, sf, "events").where("ts is not null").select("event_id", ts_micros(stamp).alias("micros"))

"""What is shown, carried over and checked, as queries, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.functions import owner, paths, render, text
from lumenlog.functions import scoring as S
from lumenlog.operators import eligibility, selection
from lumenlog.plans import retrieval
from lumenlog.plans import stand_ins as T
from lumenlog.plans.catalog import query
from lumenlog.plans.logs import _sql_values, _values
from lumenlog.sources import transcripts

_N = text.norm


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _lined(column: str, label: str) -> str:
    return f"CASE WHEN {column}_role IS NOT NULL THEN CASE WHEN {column}_role = 'user' THEN 'OWNER: ' ELSE 'ASSISTANT: ' END || {T.clip_sql(column, render.TURN_CLIP)} END AS {label}"


@query(
    "situation_layouts",
    f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, ''), 2) OVER w AS a, lag(role, 2) OVER w AS a_role, lag(coalesce(text, '')) OVER w AS b, lag(role) OVER w AS b_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  l AS (SELECT *, {_lined('a', 'first')}, {_lined('b', 'second')} FROM t)
SELECT conv_id, turn, {_sql(render.PROMPT_HEAD)} || chr(10) || chr(10) || 'OWNER: ' || {T.clip_sql('text', render.LATEST_CLIP)} AS prompt,
  concat_ws(chr(10) || chr(10), {_sql(render.STOP_HEAD)}, first, second, 'ASSISTANT (latest message): ' || {T.clip_sql('text', render.LATEST_CLIP)}) AS stop FROM l""",
)
def situation_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Both situations of every turn, as if it were the newest; a conversation's turns are one window."""
    t = T.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    line = t.withColumn("line", render.turn_line(F.col("role"), F.col("text")))
    line = line.withColumn("lines", F.array_compact(F.array(F.lag("line", 2).over(w), F.lag("line").over(w))))
    return line.select("conv_id", "turn", render.prompt_situation(F.col("text")).alias("prompt"), render.stop_situation(F.col("lines"), F.col("text")).alias("stop"))


_LABEL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in render.KIND_LABELS.items()) + " END"
_GIST = "'item ' || id"


@query(
    "card_rendering",
    f"""WITH {T.STATEMENTS}, {T.CARDS}, x AS (SELECT s.*, kind, scope, {T.norm_sql('text')} AS t, make_timestamp(micros) AS ts FROM s JOIN cards USING (id))
SELECT id, '\u2022 ' || {_LABEL} || ', ' || CASE WHEN scope = 'global' THEN 'all projects' WHEN repo = 'src3' THEN 'this repo (src3)' ELSE 'repo ' || coalesce(repo, 'unknown') END || ' (said ' || strftime(ts, '%-d %b') || ', ' || {_GIST} || '):' || chr(10) || '  "' || {T.clip_sql('t', render.CARD_CLIP)} || '"' AS card,
  '- ' || CASE WHEN session_id = 7 THEN '(earlier in this session, before context compaction)' ELSE strftime(ts, '%Y-%m-%d') || ' (repo: ' || coalesce(repo, 'unknown') || ')' END || ': "' || {T.clip_sql('t', render.QUOTE_CLIP)} || '"' AS quote,
  'Past owner statement (said while ' || {_GIST} || '): "' || {T.clip_sql('text', 260)} || '"' AS question FROM x""".replace("\\u2022", "\u2022"),
)
def card_rendering(spark: SparkSession, sf: str) -> DataFrame:
    """Card, quote and question line of every statement that has a card."""
    s = T.statements(spark, sf).join(T.cards(spark, sf), "id").withColumn("ts", F.timestamp_micros("micros")).withColumn("gist", F.concat(F.lit("item "), F.col("id")))
    c = F.col
    return s.select(
        "id", render.card_lines(c("text"), c("ts"), c("repo"), c("kind"), c("scope"), c("gist"), F.lit("src3")).alias("card"), render.quote_line(c("text"), c("ts"), c("repo"), c("session_id") == 7).alias("quote"),
        render.question_line(c("text"), c("gist")).alias("question"),
    )


_FILE = "'/home/jo/.' || host || '/sessions/' || repo || '/rollout-' || lpad(id::VARCHAR, 36, '0') || CASE WHEN id % 2 = 0 THEN '.jsonl' ELSE '.jsonl.zst' END"


@query(
    "transcript_paths",
    f"""WITH {T.STATEMENTS}, f AS (SELECT id, host, repo, {_FILE} AS file FROM s)
SELECT id, file, CASE WHEN id % 5 > 0 THEN id % 900 END AS line, lpad(id::VARCHAR, 36, '0') AS session, '~/.' || host AS home, '-home-jo-' || regexp_replace(repo, '[^a-zA-Z0-9]', '-', 'g') AS folder FROM f WHERE file IS NOT NULL""",
)
def transcript_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of all statements taken apart: file, line, session, home, project folder."""
    name = F.concat(F.lit("/rollout-"), F.lpad(F.col("id").cast("string"), 36, "0"), F.when(F.col("id") % 2 == 0, ".jsonl").otherwise(".jsonl.zst"))
    s = T.statements(spark, sf).select("id", "repo", F.concat(F.lit("/home/jo/."), "host", F.lit("/sessions/"), "repo", name).alias("file")).where("file is not null")
    src = paths.parse_src(F.concat("file", F.when(F.col("id") % 5 > 0, F.concat(F.lit(":L"), F.col("id") % 900)).otherwise(":Lx")))
    return s.select("id", "file", src["line"].alias("line"), paths.rollout_session(F.col("file")).alias("session"), paths.home_of(F.col("file"), "/home/jo").alias("home"), paths.project_folder(F.concat(F.lit("/home/jo/"), "repo")).alias("folder"))


_TOLD = f"""told AS (SELECT DISTINCT query_id AS session, (query_id * 3 + 7) AS id FROM c), {T.LOG},
  hubs AS (SELECT k AS id FROM log WHERE outcome = 'injected' AND k IS NOT NULL AND ts > {retrieval._HUB_NOW} - INTERVAL 14 DAY AND ts < {retrieval._HUB_NOW} GROUP BY k HAVING count(DISTINCT session_id) >= 3)"""


@query(
    "survivors_plan",
    f"""WITH {retrieval.FUSED}, {_TOLD}, k AS (SELECT DISTINCT session, lower({T.norm_sql('text')}) AS key FROM told JOIN s USING (id)),
  g AS (SELECT query_id, fr.id, rrf, rank, lower({T.norm_sql('s.text')}) AS key FROM fr JOIN s ON s.id = fr.id WHERE rank <= 50 AND p >= 0.95),
  n AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM told WHERE session = query_id AND told.id = g.id) AND NOT EXISTS (SELECT 1 FROM k WHERE session = query_id AND k.key = g.key) AND id NOT IN (SELECT id FROM hubs)),
  d AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rrf DESC, rank) AS copy FROM n),
  a AS (SELECT query_id, id, ((id * 7 + query_id) % 100) / 100.0::DOUBLE AS apply_p, rank FROM d WHERE copy = 1 AND id % 9 <> 0),
  p AS (SELECT query_id, id, apply_p, row_number() OVER (PARTITION BY query_id ORDER BY apply_p DESC, rank)::INT AS place FROM a WHERE apply_p >= 0.2)
SELECT * FROM p WHERE place <= 3""",
)
def survivors_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The default plan to what is told: gate, repeats, hubs, copies, second gate, three."""
    fused, _, cases = retrieval._fused(spark, sf)
    s = T.statements(spark, sf)
    told = cases.select(F.col("query_id").alias("session"), (F.col("query_id") * 3 + 7).alias("id"))
    log = T.turn_log(spark, sf).where("outcome = 'injected' and k is not null").select(F.col("k").alias("id"), F.col("session_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    hubs = selection.hub_ids(log, retrieval.HUB_NOW, 14, 3)
    ranked = fused.where(F.col("rank") <= S.TOP_N).select("query_id", F.col("query_id").alias("session"), "id", "p", F.col("rrf").alias("score"), "rank")
    left = selection.survivors(ranked, "p", S.PROMPT_GATE, told, s, hubs)
    asked = left.withColumn("apply_p", F.when(F.col("id") % 9 != 0, ((F.col("id") * 7 + F.col("query_id")) % 100) / 100.0))
    return selection.apply_gate(asked, 3).select("query_id", "id", "apply_p", "place")


@query(
    "carry_over",
    f"WITH {T.STATEMENTS}, t AS (SELECT session_id AS session, id, sha256({T.norm_sql('text')}) AS h FROM s) SELECT session, id FROM t WHERE EXISTS (SELECT 1 FROM t b WHERE b.session = t.session AND b.h = t.h AND b.id % 4 = 0) OR id % 6 = 1",
)
def carry_over(spark: SparkSession, sf: str) -> DataFrame:
    """Statements that a compaction kept, by their text's hash or by their own number."""
    t = T.statements(spark, sf).select(F.col("session_id").alias("session"), "id", text.sha256_hex(_N(F.col("text"))).alias("text_hash"), F.col("id").cast("string").alias("uuid"))
    return selection.carried(t, t.where("id % 4 = 0"), t.where("id % 6 = 1"))


@query(
    "answer_check",
    "WITH e AS (SELECT event_id // 20 AS batch, (event_id * 7 + user_id) % 23 AS n, event_type <> 'signup' AS ok FROM events), g AS (SELECT batch, n, count(*) AS times, bool_and(ok) AS ok FROM e GROUP BY ALL) SELECT batch, n, times, CASE WHEN n < 1 OR n > 20 THEN 'stray' WHEN times > 1 THEN 'repeated' WHEN ok THEN 'good' ELSE 'bad' END AS verdict FROM g",
)
def answer_check(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered answers held against their batches."""
    e = T.table(spark, sf, "events").select(F.floor(F.col("event_id") / 20).alias("batch"), ((F.col("event_id") * 7 + F.col("user_id")) % 23).alias("n"), (F.col("event_type") != "signup").alias("ok"))
    return eligibility.checked_answers(e, e.select("batch", F.lit(20).alias("size")).distinct())


@query(
    "rollout_copies",
    "WITH f AS (SELECT page_id % 2 AS home, '/h/' || CASE WHEN page_id % 3 = 0 THEN 'archived_sessions' ELSE 'sessions' END || '/' || page_id || '/r' || (page_id // 4) || '.jsonl' AS file, 'r' || (page_id // 4) || '.jsonl' AS name, (page_id % 5) // 2 AS size, page_id % 11 = 0 AS known, page_id FROM pages) SELECT page_id, name, row_number() OVER (PARTITION BY home, name ORDER BY known DESC, size DESC, contains(file, '/archived_sessions/'), file) = 1 AS kept FROM f",
)
def rollout_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Of the copies of a rollout, the one to read."""
    i = F.col("page_id")
    place = F.when(i % 3 == 0, "archived_sessions").otherwise("sessions")
    f = T.table(spark, sf, "pages").select("page_id", (i % 2).alias("home"), F.concat(F.lit("/h/"), place, F.lit("/"), i, F.lit("/r"), F.floor(i / 4), F.lit(".jsonl")).alias("file"), F.floor((i % 5) / 2).alias("size"))
    return transcripts.rollout_copies(f, f.where(i % 11 == 0)).select("page_id", "name", "kept")


@query(
    "attended_sessions",
    "WITH x AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'bg' END AS kind, CASE event_id % 7 WHEN 0 THEN '1' WHEN 1 THEN '0' END AS scheduled, CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN 'x' END AS attended, CASE WHEN event_type = 'view' THEN 'sdk-py' WHEN event_type = 'click' THEN 'cli' END AS entry, CASE WHEN user_id % 3 = 0 THEN 'sdk' END AS origin, CASE WHEN user_id % 2 = 0 THEN 'human' END AS human FROM events) SELECT event_id, CASE WHEN kind IS NOT NULL THEN 'headless:claude-session-kind-' || kind WHEN scheduled = '1' THEN 'headless:claude-scheduled-run' WHEN attended = '0' THEN 'headless:claude-unattended' WHEN entry LIKE 'sdk-%' THEN 'headless:claude-transcript-entrypoint-' || entry WHEN origin = 'sdk' AND human IS NULL THEN 'headless:claude-transcript-turn-origin-sdk' WHEN attended = '1' THEN 'interactive:claude-attended' WHEN attended = 'x' THEN 'unknown:claude-attended-value' WHEN human = 'human' THEN 'interactive:claude-transcript-human' ELSE 'unknown:claude-no-attendance-signal' END AS verdict FROM x",
)
def attended_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a person is at a session's keyboard, and why."""
    e, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    signals = (
        F.when(e % 13 == 0, "bg"), F.when(e % 7 == 0, "1").when(e % 7 == 1, "0"), F.when(e % 4 == 0, "0").when(e % 4 == 1, "1").when(e % 4 == 2, "x"),
        F.when(t == "view", "sdk-py").when(t == "click", "cli"), F.when(u % 3 == 0, "sdk"), F.when(u % 2 == 0, "human"),
    )
    return T.table(spark, sf, "events").select("event_id", eligibility.attended(*signals).alias("verdict"))


@query("question_packs", f"WITH {T.STATEMENTS} SELECT session_id, pack, count(*) AS n, min(id) AS first FROM (SELECT session_id, id, ((row_number() OVER (PARTITION BY session_id ORDER BY micros, id) - 1) // 72)::INT AS pack FROM s) GROUP BY ALL")
def question_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Questions in packs of 72."""
    return selection.packs(T.statements(spark, sf), ["session_id"], ["micros", "id"], 72).groupBy("session_id", "pack").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("latest_lookups", f"WITH {T.STATEMENTS}, l AS (SELECT event_id, user_id * 5 AS id FROM events ORDER BY ts DESC, event_id DESC LIMIT 8) SELECT event_id, l.id, length(text) AS chars, repo FROM l LEFT JOIN s ON s.id = l.id")
def latest_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """The newest eight lookups, with their statement where the index has it."""
    l = T.table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("event_id", (F.col("user_id") * 5).alias("id"))  # noqa: E741
    return l.join(T.statements(spark, sf), "id", "left").select("event_id", "id", F.length("text").cast("bigint").alias("chars"), "repo")


#: Turns of a desktop app and what their owner typed (fixed values).
_APP = [
    (1, "## My request for Codex:\nShip the export behind a flag first", "Ship the export behind a flag first"),
    (2, "# Diff comments:\n\n## Comment 1\nFile: a.ts\nComment:\nrename this\n\n## My request for Codex:\nAlso add a comment: the limit is per user", "rename this\nAlso add a comment: the limit is per user"),
    (3, "# Browser comments:\n\n## User Comment 1\nTarget: button.checkout\nComment: make the pay button blue\n\n## My request for Codex:\nAnd put the coupon field under the order total", "make the pay button blue\nAnd put the coupon field under the order total"),
    (4, "# Files mentioned by the user:\n\n## report.ts: /home/sam/projects/shop/src/report.ts\n\n## My request for Codex:\nUse the totals helper from report.ts instead of summing the rows inline", "Use the totals helper from report.ts instead of summing the rows inline"),
    (5, "Please add the export button to the invoices table and keep the order of the columns", "Please add the export button to the invoices table and keep the order of the columns"),
    (6, "# Selected text:\n\n## Selection 1\nnothing typed", "# Selected text:\n\n## Selection 1\nnothing typed"),
]


@query("app_envelope", "SELECT id, text, reason FROM " + _sql_values([(i, t, "envelope" if i == 6 else None if len(t) >= owner.MIN_TEXT else "too-short") for i, _, t in _APP], "id, text, reason"))
def app_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """A desktop app's turns without its envelope, and the verdict on each."""
    return _values(spark, [(i, raw) for i, raw, _ in _APP], "id int, raw string").select("id", owner.peel_app_envelope(F.col("raw")).alias("text"), owner.judge(F.col("raw"))["reason"].alias("reason"))

"""Raw transcript lines of three hosts as turns, each rejected line with its reason.

Union-typed fields (content: text or blocks; source: text or object) are read as VARIANT. Substring
tests come before the parse, so most lines are never decoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.functions.paths import base_name
from lumenlog.functions.text import norm


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def text_of(content: Column) -> Column:
    """A text, or the texts of its text blocks by line; null for anything else."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: F.try_variant_get(b, "$.text", "string"))
    is_array = F.schema_of_variant(content).startswith("ARRAY")
    return F.when(is_array, F.array_join(texts, "\n")).when(F.schema_of_variant(content) == "STRING", F.try_variant_get(content, "$", "string"))


def is_temp_project(name: Column) -> Column:
    return name.rlike(r"^-(private-)?(var-folders|tmp)-")


def host_a(rows: DataFrame) -> DataFrame:
    """Lines (file, line_no, value) of host A: raw, ts, via, cwd, uuid and drop_reason; lines that are no candidates are left out."""
    queued = F.col("value").contains('"queued_command"')
    candidate = queued | F.col("value").contains('"type":"user"')
    early = ~queued & F.col("value").contains('"type":"tool_result"')
    v = rows.where(candidate).withColumn("v", F.when(~early, F.try_parse_json("value"))).withColumn("early", early)
    r = F.col("v")
    s = lambda p: _get(r, p)
    blocks = F.try_variant_get(r, "$.message.content", "array<variant>")
    result = F.coalesce(F.exists(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "tool_result"), F.lit(False))
    attached = s("$.type") == "attachment"
    origin = s("$.origin.kind")
    drop = (
        F.when(F.col("early"), "tool-result").when(r.isNull(), "unparsable").when(_get(r, "$.isSidechain", "boolean"), "sidechain")
        .when(attached & (s("$.attachment.type") == "queued_command") & ~F.coalesce(s("$.attachment.origin.kind") == "human", F.lit(False)), F.concat(F.lit("queued-"), F.coalesce(s("$.attachment.origin.kind"), F.lit("no-origin"))))
        .when(attached, None).when(s("$.type") != "user", None).when(_get(r, "$.isCompactSummary", "boolean"), "compact-summary").when(_get(r, "$.isMeta", "boolean"), "harness")
        .when(result, "tool-result").when(origin.isNotNull() & (origin != "human"), F.concat(F.lit("origin-"), origin))
        .when(origin.isNull() & ((s("$.entrypoint") == "sdk-cli") | (s("$.promptSource") == "system") | (s("$.turnOrigin") == "sdk")), "programmatic")
    )
    raw = F.when(attached & (s("$.attachment.type") == "queued_command"), text_of(F.variant_get(r, "$.attachment.prompt", "variant"))).when(s("$.type") == "user", text_of(F.variant_get(r, "$.message.content", "variant")))
    out = v.select("file", "line_no", F.when(drop.isNull(), F.nullif(raw, F.lit(""))).alias("raw"), F.coalesce(s("$.timestamp"), s("$.attachment.timestamp")).alias("ts"), F.when(attached, "queued").otherwise("typed").alias("via"), s("$.cwd").alias("cwd"), s("$.uuid").alias("uuid"), s("$.sessionId").alias("session_id"), drop.alias("drop_reason"))
    return out.where("raw is not null or drop_reason is not null")


def session_verdict(headers: DataFrame) -> DataFrame:
    """First lines (file, header) of rollouts: interactive, or why a session isn't one."""
    h = headers.withColumn("v", F.try_parse_json("header"))
    v = F.col("v")
    sub = F.schema_of_variant(F.variant_get(v, "$.payload.source", "variant")).startswith("OBJECT") | (_get(v, "$.payload.thread_source") == "subagent")
    legacy = _get(v, "$.type").isNull() & _get(v, "$.id").isNotNull() & _get(v, "$.timestamp").isNotNull()
    verdict = F.when(legacy, "legacy").when(~F.coalesce(_get(v, "$.type") == "session_meta", F.lit(False)), "no-meta").when(F.coalesce(sub, F.lit(False)), "subagent").when(_get(v, "$.payload.source") == "exec", "exec").otherwise("interactive")
    at = F.when(legacy, _get(v, "$.timestamp")).otherwise(_get(v, "$.payload.timestamp"))
    return h.select("file", verdict.alias("verdict"), F.coalesce(_get(v, "$.payload.id"), _get(v, "$.id")).alias("session_id"), at.alias("started"), _get(v, "$.payload.cwd").alias("cwd"), _get(v, "$.payload.git.repository_url").alias("git_url"))


def host_b(rows: DataFrame) -> DataFrame:
    """Lines of rollouts: owner turns as event or fallback kind. A file with any event turn keeps those alone (event_precedence)."""
    maybe = F.col("value").contains("UserMessage") | F.col("value").contains('"role":"user"')
    v = rows.where(maybe).withColumn("v", F.try_parse_json("value"))
    r = F.col("v")
    event = (_get(r, "$.type") == "event_msg") & (_get(r, "$.payload.type") == "item_completed") & (_get(r, "$.payload.item.type") == "UserMessage")
    item = (_get(r, "$.type") == "response_item") & (_get(r, "$.payload.type") == "message") & (_get(r, "$.payload.role") == "user")
    bare = _get(r, "$.payload.type").isNull() & (_get(r, "$.type") == "message") & (_get(r, "$.role") == "user")

    def texts(path: str) -> Column:
        blocks = F.filter(F.try_variant_get(r, path, "array<variant>"), lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string"), F.lit("text")).isin("input_text", "text"))
        return F.array_join(F.transform(blocks, lambda b: F.try_variant_get(b, "$.text", "string")), "\n")

    kind = F.when(event, "event").when(item, "fallback").when(bare, "legacy")
    raw = F.when(event, texts("$.payload.item.content")).when(item, texts("$.payload.content")).when(bare, texts("$.content"))
    return v.select("file", "line_no", kind.alias("kind"), raw.alias("raw"), _get(r, "$.timestamp").alias("ts")).where("kind is not null and raw <> ''")


def typed_log(rows: DataFrame) -> DataFrame:
    """Rows of typed-prompt logs, both shapes: session_id, micros, raw with pastes expanded, command."""
    v = rows.withColumn("v", F.try_parse_json("value")).where("v is not null")
    r = F.col("v")
    text = F.coalesce(_get(r, "$.text"), _get(r, "$.display"))
    pastes = F.map_entries(F.coalesce(F.try_variant_get(r, "$.pastedContents", "map<string,struct<type:string,content:string>>"), F.create_map().cast("map<string,struct<type:string,content:string>>")))
    expanded = F.aggregate(pastes, text, lambda acc, e: F.when(e["value"]["content"].isNull(), acc).otherwise(F.regexp_replace(acc, F.concat(F.lit(r"\[Pasted text #"), e["key"], F.lit(r"[^\]]*\]")), F.regexp_replace(e["value"]["content"], r"([\\$])", r"\\$1"))))
    micros = F.coalesce(_get(r, "$.ts", "double") * 1e6, _get(r, "$.timestamp", "double") * 1e3).cast("long")
    command = F.nullif(F.regexp_extract(F.trim(text), r"^(/[\w:-]+)(?:\s|$)", 1), F.lit(""))
    return v.select("file", "line_no", F.coalesce(_get(r, "$.session_id"), _get(r, "$.sessionId")).alias("session_id"), micros.alias("micros"), F.regexp_replace(expanded, r"^\s*/[\w:-]+(?:\s+|$)", "").alias("raw"), command.alias("command"), _get(r, "$.project").alias("project"))


def compaction(rows: DataFrame) -> DataFrame:
    """Boundary, summary and compacted markers."""
    v = rows.where(F.col("value").rlike("(?i)compact")).withColumn("v", F.try_parse_json("value"))
    r = F.col("v")
    kind = F.when((_get(r, "$.type") == "system") & (_get(r, "$.subtype") == "compact_boundary"), "boundary").when(_get(r, "$.isCompactSummary", "boolean"), "summary").when(_get(r, "$.type") == "compacted", "compacted")
    return v.select("file", "line_no", kind.alias("marker")).where("marker is not null")


def tool_calls(rows: DataFrame) -> DataFrame:
    """(file, line_no, tools): names of the tools a record calls, in order."""
    v = rows.where(F.col("value").contains("tool_use")).withColumn("v", F.try_parse_json("value"))
    uses = F.filter(F.try_variant_get(F.col("v"), "$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")
    return v.select("file", "line_no", F.transform(uses, lambda b: F.try_variant_get(b, "$.name", "string")).alias("tools")).where(F.size("tools") > 0)


def counted_drops(turns: DataFrame) -> DataFrame:
    return turns.where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))


def history_without_transcripts(typed: DataFrame, rollouts: DataFrame, turns: DataFrame, goal: Column | None = None) -> DataFrame:
    """Typed rows whose session has no rollout, and whose text the project's transcripts don't hold.

    goal: which rows started an automatic run; those stay though their session has a rollout, as that doesn't hold them.
    """
    has = rollouts.select("session_id").distinct().withColumn("in_rollout", F.lit(True))
    goal = F.lit(False) if goal is None else F.coalesce(goal, F.lit(False))
    left = typed.join(has, "session_id", "left").where(F.col("in_rollout").isNull() | goal).select(typed.columns)
    seen = turns.select(F.col("project"), norm(F.col("raw")).alias("key")).distinct()
    return left.withColumn("key", norm(F.col("raw"))).join(seen, ["project", "key"], "left_anti").drop("key")


def rollout_copies(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (home, file, size) with kept, one a rollout's name: the copy known (file, perhaps nth) already, else the larger, else the one not archived.

    Of known copies the first listed is kept, where known says by nth how they are listed.
    """
    nth = F.min("nth") if "nth" in known.columns else F.lit(0)
    f = files.join(known.groupBy("file").agg(nth.alias("known")), "file", "left").withColumn("name", base_name(F.col("file")))
    order = (F.col("known").asc_nulls_last(), F.desc("size"), F.col("file").contains("/archived_sessions/"), "file")
    return f.withColumn("kept", F.row_number().over(Window.partitionBy("home", "name").orderBy(*order)) == 1).drop("known")


def of_sessions(rows: DataFrame, verdicts: DataFrame, wanted: str = "interactive") -> DataFrame:
    """Rows of files whose session got the verdict."""
    return rows.join(verdicts.where(F.col("verdict") == wanted).select("file").distinct(), "file", "left_semi")

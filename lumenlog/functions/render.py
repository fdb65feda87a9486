"""What is shown to a judge or an agent: situations, question lines, cards and quotes. Columns in, Columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenlog.functions.repo import same_repo
from lumenlog.functions.text import ITEM_CLIP, clip, norm, plain_prose

#: Heads, labels and clips (fixed values).
STOP_HEAD = "SITUATION (conversation so far, newest last):"
PROMPT_HEAD = "SITUATION (the owner's latest message, before the agent has acted):"
TURN_CLIP, LATEST_CLIP, EARLIER_CLIP, REPLY_CLIP, QUOTE_CLIP, CARD_CLIP = 500, 1500, 300, 400, 500, 300
KIND_LABELS = {"rule": "Rule", "preference": "Preference", "decision": "Decision", "correction": "Correction", "question": "Question", "status": "Status", "other": "Fact/task"}


def prompt_situation(said: Column) -> Column:
    return F.concat(F.lit(f"{PROMPT_HEAD}\n\nOWNER: "), clip(said, LATEST_CLIP))


def _part(label: str, text: Column) -> Column:
    """A labelled part, null where there is no text: concat_ws leaves it out."""
    return F.when(text != "", F.concat(F.lit(label), text))


def context_situation(said: Column, project: Column, earlier: Column, reply: Column) -> Column:
    """The project, the prose of the owner's message and the reply before, then the new message; what doesn't exist is left out."""
    parts = (_part("PROJECT: ", project), _part("OWNER (earlier): ", clip(plain_prose(earlier), EARLIER_CLIP)), _part("ASSISTANT: ", clip(plain_prose(reply), REPLY_CLIP)))
    return F.concat_ws("\n\n", F.lit(STOP_HEAD), *parts, F.concat(F.lit("OWNER (latest message, before the agent has acted): "), clip(said, LATEST_CLIP)))


def turn_line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "user", "OWNER").otherwise("ASSISTANT"), F.lit(": "), clip(text, TURN_CLIP))


def stop_situation(lines: Column, last: Column) -> Column:
    """lines: turn_line of the one or two turns before the agent's last message, older first."""
    return F.concat_ws("\n\n", F.lit(STOP_HEAD), lines, F.concat(F.lit("ASSISTANT (latest message): "), clip(last, LATEST_CLIP)))


def question_line(text: Column, gist: Column | None = None) -> Column:
    """How a judge is shown a statement; with gist, what was going on when it was said (null where it has none)."""
    said = F.lit("Past owner statement: \"") if gist is None else F.concat(F.lit("Past owner statement (said while "), gist, F.lit("): \""))
    return F.concat(said, clip(text, ITEM_CLIP), F.lit("\""))


def quote_line(text: Column, ts: Column, repo: Column, same_session: Column) -> Column:
    where = F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(" (repo: "), F.coalesce(repo, F.lit("unknown")), F.lit(")"))
    told = F.when(F.coalesce(same_session, F.lit(False)), "(earlier in this session, before context compaction)").otherwise(where)
    return F.concat(F.lit("- "), told, F.lit(": \""), clip(norm(text), QUOTE_CLIP), F.lit("\""))


def card_lines(text: Column, ts: Column, repo: Column, kind: Column, scope: Column, gist: Column, current: Column, aliases: dict[str, str] | None = None) -> Column:
    """A card's two lines; null without a kind, since a statement without a card is never shown as one."""
    labels = F.create_map(*[F.lit(x) for pair in KIND_LABELS.items() for x in pair])
    ours = F.concat(F.lit("this repo ("), repo, F.lit(")"))
    place = F.when(scope == "global", "all projects").when(same_repo(repo, current, aliases), ours).otherwise(F.concat(F.lit("repo "), F.coalesce(repo, F.lit("unknown"))))
    head = F.concat(F.lit("\u2022 "), F.try_element_at(labels, kind), F.lit(", "), place, F.lit(" (said "), F.date_format(ts, "d MMM"), F.lit(", "), gist, F.lit("):"))
    return F.concat(head, F.lit("\n  \""), clip(norm(text), CARD_CLIP), F.lit("\""))

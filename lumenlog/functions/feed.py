"""What a line of the turn log means in a feed: the kind and group of its reason, the kind of a half, the stop that is shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reasons by name: kind and group (fixed values).
EXACT = {
    "disabled": ("skip", "off"), "child": ("skip", "internal"), "subagent": ("skip", "subagent"), "no-prompt": ("skip", "not-owner"), "short-or-missing-message": ("skip", "short"),
    "no-eligible-prompt-state": ("skip", "not-owner"), "already-blocked-this-turn": ("skip", "followup"), "stop-hook-active": ("skip", "followup"),
    "nothing-above-threshold": ("empty", "other"), "no-violation-above-threshold": ("audited", "other"), "nominated-hits-not-confirmed": ("audited", "other"), "cap-reached": ("capped", "other"),
    "empty-index": ("error", "other"), "no-cards": ("error", "other"), "retrieval-failed": ("error", "other"), "apply-gate-failed": ("error", "other"), "audit-failed": ("error", "other"),
    "verify-unavailable": ("error", "other"), "config-invalid": ("error", "other"), "hook-crashed": ("error", "other"),
    "not-owner-text:agent-completion": ("skip", "subagent"), "headless:rollout-subagent": ("skip", "subagent"),
}
#: Families of reasons, by how they begin, with something after it: kind and group (fixed values).
FAMILIES = {"not-owner-text:": ("skip", "not-owner"), "headless:": ("skip", "automated"), "unknown:": ("skip", "unclassified")}
#: The order in which stops are shown, best first (fixed values); a stop that only follows a block comes last.
STOP_RANK = {"blocked": 0, "audited": 1, "error": 2, "capped": 3, "empty": 4, "injected": 4, "skip": 5}
FOLLOW_UP, FOLLOW_UP_RANK, OTHER_RANK = "stop-hook-active", 9, 6


def reason_info(reason: Column) -> Column:
    """Struct (kind, group) of a reason; one that nobody has named is a skip of the group other. Null has none."""
    pair = lambda x: F.struct(F.lit(x[0]).alias("kind"), F.lit(x[1]).alias("group"))
    named = F.create_map(*[y for name, x in EXACT.items() for y in (F.lit(name), pair(x))])
    family = F.when(reason.isNull(), None)
    for begin, x in FAMILIES.items():
        family = family.when(reason.startswith(begin) & (F.length(reason) > len(begin)), pair(x))
    return F.when(reason.isNotNull(), F.coalesce(F.try_element_at(named, reason), family.otherwise(pair(("skip", "other")))))


def half_kind(event: Column, outcome: Column, reason: Column, level: Column, audited: Column) -> Column:
    """The kind of one hook firing: what was done, else what its reason means. A block's reason is its feedback and means nothing here.

    audited: whether a stop's audit looked at anything.
    """
    known = reason_info(reason)["kind"]
    return (
        F.when(outcome == "injected", "injected").when(outcome == "blocked", "blocked").when((event == "stop") & F.coalesce(audited, F.lit(False)), "audited")
        .when(reason.isNotNull(), known).when(level == "error", "error").otherwise("skip")
    )


def shown_stop(kind: Column, reason: Column, order: Column, row: Column) -> Column:
    """Aggregate: the row of the stop that a turn's card shows, the first of the best rank."""
    ranks = F.create_map(*[F.lit(x) for pair in STOP_RANK.items() for x in pair])
    rank = F.when(reason == FOLLOW_UP, FOLLOW_UP_RANK).otherwise(F.coalesce(F.try_element_at(ranks, kind), F.lit(OTHER_RANK)))
    return F.min_by(row, F.struct(rank.alias("rank"), order.alias("order")))

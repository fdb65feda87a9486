"""Prompt and stop pairing, batch and stream, over one fold."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIR_SCHEMA = "session_id long, at long, event string, prompt_at long"


def pair(lines: list[tuple[int, str, str | None]], open_: list[list], keys: dict[str, int | None]) -> list[tuple[int, str, int | None]]:
    """Fold lines (at, event, turn_key) into the state: (at, event, at of the prompt it belongs to).

    open_: waiting prompts [at, key], oldest first; keys: the prompt of each turn key, None where only a stop has come.
    """
    out = []
    for at, event, key in lines:
        if event == "prompt":
            late = key is not None and key in keys and keys[key] is None  # its stop came first
            if key is not None:
                keys[key] = at
            open_.append([at, key])
            out.append((at, event, at))
            if late:
                continue
        else:
            found = keys.get(key) if key is not None else None
            known = key is not None and key in keys
            if found is not None:
                open_[:] = [p for p in open_ if p[0] != found]
            elif not known:
                for i in range(len(open_) - 1, -1, -1):
                    if key is not None and open_[i][1] is not None:
                        continue
                    found = open_[i][0]
                    del open_[: i + 1]  # older waiting prompts were interrupted
                    break
                if found is None and key is not None:
                    keys[key] = None
            out.append((at, event, found))
    return out


def _lines(x: pd.DataFrame) -> list[tuple[int, str, str | None]]:
    x = x.sort_values("at")
    return [(int(a), e, None if pd.isna(k) else str(k)) for a, e, k in zip(x["at"], x["event"], x["turn_key"], strict=True)]


def pair_stream(lines: DataFrame, idle: str = "1 day") -> DataFrame:
    """The same over a stream: the state of a session (open prompts, keys) goes after a day without lines.

    lines need an event time column ts besides (session_id, at, event, turn_key).
    """
    millis = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else ([], [], [], [])
        open_ = [[a, k] for a, k in zip(held[0], held[1], strict=True)]
        keys = dict(zip(held[2], [None if a < 0 else a for a in held[3]], strict=True))
        rows = pair(_lines(pd.concat(list(batches))), open_, keys)
        state.update(([p[0] for p in open_], [p[1] for p in open_], list(keys), [-1 if a is None else a for a in keys.values()]))
        state.setTimeoutDuration(millis)
        out = pd.DataFrame(rows, columns=["at", "event", "prompt_at"]).astype({"prompt_at": "Int64"})
        out.insert(0, "session_id", key[0])
        yield out

    state = "open_at array<long>, open_key array<string>, keys array<string>, key_at array<long>"
    return lines.groupBy("session_id").applyInPandasWithState(step, PAIR_SCHEMA, state, "append", GroupStateTimeout.ProcessingTimeTimeout)

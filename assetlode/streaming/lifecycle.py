"""The life of a scan as a fold over its events, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Event: the states that it applies to, and the state that it leads to (None: the same).
GUARDS = {"pause": ({"running"}, "suspended"), "resume": ({"suspended"}, "running"), "complete": ({"running"}, "completed"), "discard": ({"running", "suspended"}, "discarded"), "advance": ({"running"}, None)}


def apply(state: str, applied: int, event: str) -> tuple[str, int]:
    """The next state; an event whose guard doesn't hold is declined."""
    allowed, to = GUARDS.get(event, (set(), None))
    return (to or state, applied + 1) if state in allowed else (state, applied)


def fold(events: DataFrame, order: Sequence[str]) -> DataFrame:
    """scan_id, state, applied and seen after all events (scan_id, event, and the order columns).

    Declarative: states are few, so the events of a scan are folded as an array in one
    expression; the array is bounded by what one scan went through.
    """
    arrived = events.groupBy("scan_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "event"))), lambda x: x["event"]).alias("events"))
    start = F.struct(F.lit("running").alias("state"), F.lit(0).cast("long").alias("applied"))

    def step(acc, event):
        to, ok = acc["state"], F.lit(False)
        for name, (allowed, target) in GUARDS.items():
            hit = (event == name) & acc["state"].isin(*sorted(allowed))
            ok = ok | hit
            to = F.when(hit, target or acc["state"]).otherwise(to)
        return F.struct(to.alias("state"), (acc["applied"] + ok.cast("long")).alias("applied"))

    done = arrived.withColumn("s", F.aggregate("events", start, step))
    return done.select("scan_id", "s.state", "s.applied", F.size("events").cast("long").alias("seen"))


def _update(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, applied, seen = held.get if held.exists else ("running", 0, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"], kind="stable")
    for event in rows["event"]:
        state, applied = apply(state, applied, event)
        seen += 1
    held.update((state, applied, seen))
    yield pd.DataFrame({"scan_id": [key[0]], "state": [state], "applied": [applied], "seen": [seen]})


def stream(events: DataFrame) -> DataFrame:
    """The same fold over a stream of events that arrive in order by micro-batch."""
    return events.groupBy("scan_id").applyInPandasWithState(_update, "scan_id long, state string, applied long, seen long", "state string, applied long, seen long", "update", GroupStateTimeout.NoTimeout)


def should_hold(depth: int, capacity: int = 2048, burst: int = 500, page: int = 20) -> bool:
    """Whether a producer waits: the queue must keep room for a burst and a page."""
    return depth >= capacity - burst - page


def retry(state: str) -> tuple[str, bool]:
    return ("pending", True) if state in ("partial", "failed") else (state, False)


def stop_reason(*, epoch_changed: bool, held: bool, empty: bool, more: bool) -> str | None:
    """Why the producer stops a page here; None: it goes on."""
    if epoch_changed:
        return "epoch_changed"
    if held:
        return "backpressure"
    return "completed" if empty or not more else None


def state_rows(rows: Any) -> list[tuple]:
    return sorted((r.scan_id, r.state, r.applied, r.seen) for r in rows)

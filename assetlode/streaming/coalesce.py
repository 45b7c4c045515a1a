"""What listeners make of bursts of events: reactions at a limited rate, the latest value, a bounded clock."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values of the listener contract.
WINDOW_MS, REACTIONS_PER_SECOND = 500, 2
INTERVAL_MS = 1000 // REACTIONS_PER_SECOND


def reactions(times: Iterable[int], locked: Iterable[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(time, events) of each reaction to events at sorted times.

    The window trails the last event, but a reaction waits no longer than INTERVAL_MS after
    the first one, and none comes sooner than INTERVAL_MS after another. While the view is
    locked, events are only counted; the count goes to the first reaction after it.
    """
    held, waiting, first, last, out, before = list(locked), 0, None, None, [], None

    def due() -> int:
        at = min(last + WINDOW_MS, first + INTERVAL_MS)
        return at if before is None else max(at, before + INTERVAL_MS)

    def react(until: float) -> None:
        nonlocal waiting, first, last, before
        while first is not None and (at := due()) <= until:
            first = last = None
            if not any(lo <= at < hi for lo, hi in held):
                out.append((at, waiting))
                waiting, before = 0, at

    for t in times:
        react(t)
        waiting += 1
        if not any(lo <= t < hi for lo, hi in held):
            first, last = t if first is None else first, t
    react(float("inf"))
    return out


def latest(values: Iterable[tuple[int, str, int]], project: str) -> list[tuple[int, int]]:
    """(time, value) of what is shown of (time, project, value): at once, then at most every INTERVAL_MS; foreign projects are dropped."""
    out: list[tuple[int, int]] = []
    for at, owner, value in values:
        if owner == project and (not out or at - out[-1][0] >= INTERVAL_MS):
            out.append((at, value))
    return out


class EnqueueClock:
    """Arrival times by id; when it is full the id that came in first goes, and a stamp that is renewed keeps its place."""

    def __init__(self, most: int) -> None:
        self.most, self.at = most, {}

    def stamp(self, key: str, now: int) -> None:
        if len(self.at) >= self.most:
            del self.at[next(iter(self.at))]
        self.at[key] = now


def _react(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    pending = list(held.get[0]) if held.exists else []
    times = sorted([*pending, *(int(t) for f in frames for t in f["at"])])
    found = reactions(times)
    closed = [(at, n) for at, n in found if times and at <= times[-1]]  # a window that may still grow stays
    held.update((times[sum(n for _, n in closed) :],))
    yield pd.DataFrame({"project_id": key[0], "at": [at for at, _ in closed], "n": [n for _, n in closed]})


def stream(events: DataFrame) -> DataFrame:
    """Reactions by project_id to a stream of events (project_id, at) that arrive in order by micro-batch."""
    return events.groupBy("project_id").applyInPandasWithState(_react, "project_id string, at long, n long", "pending array<long>", "append", GroupStateTimeout.NoTimeout)


def batch(events: DataFrame) -> DataFrame:
    """The same over a table; a project's times go to one task, eight bytes each."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = reactions(sorted(rows["at"].tolist()))
        return pd.DataFrame({"project_id": key[0], "at": [at for at, _ in found], "n": [n for _, n in found]})

    return events.select("project_id", "at").groupBy("project_id").applyInPandas(each, "project_id string, at long, n long")

"""Keyset pages, bounded candidate windows, latest states and counts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlode.schemas import CANDIDATE_WINDOW, PAGE_MAX

SORTS = {"artifacts": ({"last_seen_at", "first_seen_at"}, "sha256"), "observations": ({"observed_at", "status"}, "request_id")}
FILTERS = {"artifacts": {"kind", "scan_state", "analysis_degraded"}, "observations": {"content_type"}}


def clamp_limit(limit: Any) -> int:
    """Between 1 and PAGE_MAX; what is no finite number gives PAGE_MAX."""
    try:
        return int(max(1, min(PAGE_MAX, int(float(limit)))))
    except (TypeError, ValueError, OverflowError):
        return PAGE_MAX


def after(key: str, tie: str, at: tuple[Any, Any] | None, descending: bool) -> Column:
    """Rows beyond a position in (key, tie) order, spelled out so that the first comparison can be pushed down."""
    if at is None:
        return F.lit(True)
    k, t = F.col(key), F.col(tie)
    return (k < at[0]) | ((k == at[0]) & (t < at[1])) if descending else (k > at[0]) | ((k == at[0]) & (t > at[1]))


def ordered(rows: DataFrame, key: str, tie: str, descending: bool) -> DataFrame:
    return rows.orderBy(F.col(key).desc(), F.col(tie).desc()) if descending else rows.orderBy(F.col(key).asc(), F.col(tie).asc())


def page(rows: DataFrame, key: str, tie: str, limit: int = PAGE_MAX, at: tuple[Any, Any] | None = None, descending: bool = True) -> DataFrame:
    return ordered(rows.where(after(key, tie, at, descending)), key, tie, descending).limit(clamp_limit(limit))


def window(rows: DataFrame, key: str, tie: str, at: tuple[Any, Any] | None = None, descending: bool = True, size: int = CANDIDATE_WINDOW) -> DataFrame:
    """The candidates of a filtered page: a bounded prefix, taken before the filter."""
    return ordered(rows.where(after(key, tie, at, descending)), key, tie, descending).limit(size)


def filtered_page(rows: DataFrame, key: str, tie: str, keep: Column, limit: int = PAGE_MAX, at: tuple[Any, Any] | None = None, descending: bool = True) -> DataFrame:
    """A page that may be short though more rows follow."""
    return ordered(window(rows, key, tie, at, descending).where(keep), key, tie, descending).limit(clamp_limit(limit))


def edge(candidates: DataFrame, key: str, tie: str, descending: bool = True) -> DataFrame:
    """How many candidates were looked at, and the last position among them."""
    pick = F.min if descending else F.max
    return candidates.agg(F.count("*").alias("scanned"), pick(F.struct(key, tie)).alias("last")).select("scanned", F.col(f"last.{key}").alias("last_key"), F.col(f"last.{tie}").alias("last_tie"))


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: tuple[Any, Any] | None
    scanned: int
    exhausted: bool


def read_page(rows: DataFrame, table: str, key: str, limit: Any = PAGE_MAX, at: tuple[Any, Any] | None = None, descending: bool = True, where: dict[str, Any] | None = None) -> Page:
    """One page for a caller: at most PAGE_MAX rows reach the driver. Unknown keys and filters give an empty page."""
    keys, tie = SORTS.get(table, (set(), ""))
    if key not in keys or set(where or {}) - FILTERS.get(table, set()):
        return Page([], None, 0, True)
    n = clamp_limit(limit)
    if not where:
        found = page(rows, key, tie, n, at, descending).collect()
        return Page(found, (found[-1][key], found[-1][tie]) if len(found) == n else None, len(found), len(found) < n)
    keep = F.lit(True)
    for c, v in where.items():
        keep = keep & F.col(c).eqNullSafe(F.lit(v))
    found = filtered_page(rows, key, tie, keep, n, at, descending).collect()
    last = edge(window(rows, key, tie, at, descending), key, tie, descending).first()
    if len(found) == n:
        return Page(found, (found[-1][key], found[-1][tie]), last.scanned, False)
    exhausted = last.scanned < CANDIDATE_WINDOW
    return Page(found, None if exhausted else (last.last_key, last.last_tie), last.scanned, exhausted)


def latest_state(analyses: DataFrame) -> DataFrame:
    """scan_state of the latest analysis of each artifact; of equally late ones the larger detector set counts."""
    return analyses.groupBy("project_id", "sha256").agg(F.max_by("scan_state", F.struct("started_at", "detector_set_hash")).alias("scan_state"))


def with_state(artifacts: DataFrame, analyses: DataFrame) -> DataFrame:
    """Artifacts with their latest state and whether it is a degraded one."""
    joined = artifacts.join(latest_state(analyses), ["project_id", "sha256"], "left")
    return joined.withColumn("analysis_degraded", F.when(F.col("scan_state").isin("partial", "failed"), "yes").otherwise("no"))


def recovered_counts(artifacts: DataFrame, analyses: DataFrame, sightings: DataFrame) -> DataFrame:
    """Sightings of each artifact that has any or a finished analysis; explicit zeros for the latter."""
    n = sightings.groupBy("project_id", F.col("artifact_sha256").alias("sha256")).agg(F.count("*").alias("n"))
    done = analyses.where("scan_state = 'done'").select("project_id", "sha256").distinct()
    known = n.select("project_id", "sha256").union(done).distinct()
    return artifacts.select("project_id", "sha256").join(known, ["project_id", "sha256"], "left_semi").join(n, ["project_id", "sha256"], "left").select("project_id", "sha256", F.coalesce("n", F.lit(0)).cast("long").alias("n_sources"))

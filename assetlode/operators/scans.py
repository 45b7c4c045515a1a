"""Scans over stored history: starting, walking in pages, stopping, and what a project change or retention does to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlode.operators import state
from assetlode.schemas import BURST_RESERVE, QUEUE_CAPACITY, SCAN_PAGE

# Fixed values of the scan contract.
STOP_REASONS = ("completed", "held", "no-scan", "epoch-changed", "busy", "failed")
STATUS_WORDS = ("Suspended", "Finished", "Discarded", "Waiting for queue", "Starting", "Not advancing", "Scanning")
STALL_MS, REARM_MS, SLICE_MS = 30_000, 250, 25


def start(scans: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starts scans: an id that exists is left alone, and a project has one running scan at most.

    wanted: project_id, scan_id, started_at and seq, the order of the requests. Gives the
    scans after it, and each request with its outcome: started, exists or already_running.
    """
    first = Window.partitionBy("project_id", "scan_id").orderBy("seq")
    known = scans.select("project_id", "scan_id", F.lit(True).alias("_known"))
    running = scans.where("state = 'running'").select("project_id", F.lit(True).alias("_running")).distinct()
    asked = wanted.withColumn("_nth", F.row_number().over(first)).join(known, ["project_id", "scan_id"], "left").join(running, "project_id", "left")
    fresh = F.col("_known").isNull() & (F.col("_nth") == 1)
    # of the fresh ones the first of a project starts, if nothing runs there
    earliest = asked.where(fresh).groupBy("project_id").agg(F.min("seq").alias("_first"))
    outcome = F.when(~fresh, "exists").when(F.col("_running") | (F.col("seq") != F.col("_first")), "already_running").otherwise("started")
    outcomes = asked.join(earliest, "project_id", "left").withColumn("outcome", outcome).select(*wanted.columns, "outcome")
    started = outcomes.where("outcome = 'started'").select("project_id", "scan_id", F.lit("running").alias("state"), "started_at")
    return scans.unionByName(started, allowMissingColumns=True), outcomes


def suspend_evicted(scans: DataFrame, evicted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Running scans of projects that retention took artifacts from are suspended, each with an audit row.

    evicted: project_id and n, the artifacts that went. Gives the scans after it and the audit rows.
    """
    n = evicted.where("n > 0").select("project_id", F.col("n").alias("_n"))
    joined = scans.join(n, "project_id", "left")
    hit = (F.col("state") == "running") & F.col("_n").isNotNull()
    after = state.update_where(joined, hit, state=F.lit("suspended"), suspend_reason=F.lit("retention_eviction")).select(*scans.columns)
    detail = F.concat(F.lit("retention row cap evicted "), F.col("_n").cast("string"), F.lit(" artifacts; scan suspended at its position"))
    audit = joined.where(hit).select("project_id", F.concat(F.lit("retention-"), F.col("scan_id").cast("string")).alias("event_id"), now.alias("at"), F.lit("scan_suspended_by_retention").alias("kind"), F.col("scan_id").cast("string").alias("subject"), detail.alias("detail"))
    return after, audit


def epochs(events: DataFrame, session: Sequence[str], order: Sequence[str], changed: Column) -> DataFrame:
    """Events with the epoch that they fall into: the project changes of their session up to them."""
    return events.withColumn("epoch", F.sum(F.when(changed, 1).otherwise(0)).over(Window.partitionBy(*session).orderBy(*order)).cast("long"))


def fenced(work: DataFrame, changes: DataFrame, session: Sequence[str]) -> DataFrame:
    """Work (started_at, finished_at) with whether it may be written: no project change of its session came between.

    The next change after the start is found by one window over work and changes together.
    """
    both = work.withColumn("_change", F.lit(None).cast("long")).unionByName(changes.select(*session, F.col("at").alias("started_at"), F.col("at").alias("_change")), allowMissingColumns=True)
    after = Window.partitionBy(*session).orderBy(F.col("started_at").desc(), F.col("_change").desc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = F.min(F.when(F.col("_change") > F.col("started_at") - 1, F.col("_change"))).over(after)
    return both.withColumn("_next", following).where("_change IS NULL").withColumn("written", ~F.coalesce(F.col("_next") <= F.col("finished_at"), F.lit(False))).drop("_change", "_next")


def held(depth: Column, capacity: int = QUEUE_CAPACITY, burst: int = BURST_RESERVE, page: int = SCAN_PAGE) -> Column:
    """Whether a producer waits: the queue must keep room for a burst and a page."""
    return depth >= capacity - burst - page


def stop_reason(*, busy: Column, running: Column, epoch_changed: Column, depth: Column, failed: Column, items: Column, more: Column) -> Column:
    """Why the producer stops here; null where it goes on."""
    return (
        F.when(busy, "busy").when(~running, "no-scan").when(epoch_changed, "epoch-changed").when(held(depth), "held").when(failed, "failed")
        .when((items == 0) | ~more, "completed")
    )


def status_word(*, state: Column, waiting: Column, pages: Column, last_change: Column, now: Column) -> Column:
    """The word for a scan; what holds it outranks a stall, and a stall is strictly past the deadline."""
    return (
        F.when(state == "suspended", STATUS_WORDS[0]).when(state == "completed", STATUS_WORDS[1]).when(state == "discarded", STATUS_WORDS[2])
        .when(waiting, STATUS_WORDS[3]).when(pages == 0, STATUS_WORDS[4]).when(now - last_change > STALL_MS, STATUS_WORDS[5]).otherwise(STATUS_WORDS[6])
    )


def last_changes(snapshots: DataFrame, scan: Sequence[str], at: str, counters: Sequence[str]) -> DataFrame:
    """Progress snapshots with last_change: when any counter of the scan moved last, a null counter included."""
    fingerprint = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in counters))
    ordered = Window.partitionBy(*scan).orderBy(at, *counters)
    marked = snapshots.withColumn("_f", fingerprint).withColumn("_moved", F.when(~F.col("_f").eqNullSafe(F.lag("_f").over(ordered)), F.col(at)))
    return marked.withColumn("last_change", F.max("_moved").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_f", "_moved")


def walked(n_windows: Column, window_ms: Column, deadline_ms: int, n_bytes: Column, size: int, overlap: int) -> dict[str, Column]:
    """What a walk over overlapping windows covers if each takes window_ms: it stops before a window once the deadline has passed.

    visited, bytes_walked (the end of the last window), partial, and yields, after each SLICE_MS of work.
    """
    visited = F.least(n_windows, F.ceil(deadline_ms / window_ms)).cast("long")
    end = F.when(visited == 0, F.lit(0)).otherwise(F.least(n_bytes, (visited - 1) * (size - overlap) + size)).cast("long")
    return {"visited": visited, "bytes_walked": end, "partial": visited < n_windows, "yields": F.floor(visited / F.ceil(SLICE_MS / window_ms)).cast("long")}


class Backfill:
    """A walk over history by descending id that can be taken up again: each page is a table, and so is the position after it.

    A page is written under the position that it starts from, so a repeated one overwrites
    itself; the position moves only after the page is there.
    """

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "seq", page: int = SCAN_PAGE) -> None:
        self.spark, self.folder, self.id_col, self.page = spark, folder, id_col, page

    def _positions(self) -> DataFrame | None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/positions")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.schema("step long, last long, seen long").parquet(f"{self.folder}/positions")

    def position(self) -> tuple[int, int | None, int]:
        """Steps done, the last id walked and the rows seen."""
        found = self._positions()
        last = found.orderBy(F.desc("step")).first() if found is not None else None
        return (last.step, last.last, last.seen) if last else (0, None, 0)

    def step(self, history: DataFrame) -> bool:
        """Walks one page; false if there was nothing left."""
        step, last, seen = self.position()
        rows = history if last is None else history.where(F.col(self.id_col) < last)
        rows.orderBy(F.col(self.id_col).desc()).limit(self.page).write.mode("overwrite").parquet(f"{self.folder}/pages/page={step}")
        low = self.spark.read.parquet(f"{self.folder}/pages/page={step}").agg(F.min(self.id_col).alias("low"), F.count("*").alias("n")).first()
        if not low.n:
            return False
        row = self.spark.range(1).select(F.lit(step + 1).cast("long").alias("step"), F.lit(low.low).cast("long").alias("last"), F.lit(seen + low.n).cast("long").alias("seen"))
        row.write.mode("overwrite").parquet(f"{self.folder}/positions/at={step + 1}")
        return low.n == self.page

    def run(self, history: DataFrame, pages: int | None = None) -> int:
        """Walks on from the position, to the end or so many pages; gives the rows seen in all."""
        done = 0
        while (pages is None or done < pages) and self.step(history):
            done += 1
        return self.position()[2]

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/pages").drop("page")

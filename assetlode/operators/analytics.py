"""Rates, percentiles, fits and as-of joins over logs and traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_pick(rows: DataFrame, by: Sequence[str], value: str, place: Column) -> DataFrame:
    """The value at a zero-based place in each group's order; place may use n, the group's size.

    Equal values are counted before they are ranked, so a large group reaches its
    window as its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    ranked = counts.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place)).select(*by, F.col(value).alias("picked"))


def nearest_rank(q: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))


def floor_p95() -> Column:
    return F.greatest(F.lit(0), F.floor(F.col("n") * 0.95) - 1)


def ols(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of each group; null for fewer than two points or one x."""
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def slope_through_origin(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Without points whose x is 0 or null or whose y is null."""
    fit = rows.where((F.col(x) != 0) & F.col(y).isNotNull())
    return fit.groupBy(*by).agg((F.sum(F.col(x) * F.col(y)) / F.sum(F.col(x) * F.col(x))).alias("slope"))


def within_gap(log: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Rows, and hits: rows no more than gap after the one before them of their key."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, "id"))
    return log.select((F.col(at) - before <= gap).alias("hit")).agg(F.count("*").alias("n_rows"), F.count_if("hit").alias("n_hits"))


def session_starts(log: DataFrame, at: str, gap: int) -> DataFrame:
    """Begin and end of each session: times with no longer gap than `gap` between them.

    Sessions are cut from one row for each bucket of `gap`, as times that share a
    bucket are never a session's end apart; only buckets meet in the global window.
    """
    buckets = log.groupBy(F.floor(F.col(at) / gap).alias("bucket")).agg(F.min(at).alias("lo"), F.max(at).alias("hi"))
    w = Window.orderBy("bucket")
    starts = (F.col("lo") - F.lag("hi").over(w) > gap) | F.lag("hi").over(w).isNull()
    return buckets.withColumn("session", F.sum(starts.cast("int")).over(w)).select("bucket", "session")


def session_hits(log: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """Rows, hits (rows whose key came before in the session) and sessions."""
    s = log.withColumn("bucket", F.floor(F.col(at) / gap)).join(session_starts(log, at, gap), "bucket")
    each = s.groupBy("session", key).agg(F.count("*").alias("n"))
    return each.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_hits"), F.count_distinct("session").alias("n_sessions"))


def cross_day(log: DataFrame, key: str, day: Column) -> DataFrame:
    """The share of rows on another day than their key's first; null if no key has two days."""
    d = log.groupBy(key, day.alias("day")).agg(F.count("*").alias("n"))
    first = d.groupBy(key).agg(F.min("day").alias("first"), F.count("*").alias("days"))
    j = d.join(first, key)
    return j.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("day") != F.col("first"), F.col("n"))), F.lit(0)).alias("n_hits"), F.count_distinct(F.when(F.col("days") > 1, F.col(key))).alias("n_multi")).select(
        "n_rows", "n_hits", "n_multi", F.when(F.col("n_multi") > 0, F.round(F.col("n_hits") / F.col("n_rows"), 4)).alias("rate"))


def cumulative_rates(log: DataFrame, key: str, day: Column) -> DataFrame:
    """cross_day of all rows up to each day, and the change from the day before."""
    d = log.groupBy(key, day.alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("day")
    d = d.withColumn("nth", F.row_number().over(w))
    per = d.groupBy("day").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("nth") > 1, F.col("n")).otherwise(0)).alias("hits"), F.count_if(F.col("nth") == 2).alias("multi"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    r = per.select("day", F.sum("n").over(upto).alias("n_rows"), F.sum("hits").over(upto).alias("n_hits"), F.sum("multi").over(upto).alias("n_multi"))
    r = r.withColumn("rate", F.when(F.col("n_multi") > 0, F.round(F.col("n_hits") / F.col("n_rows"), 4)))
    delta = F.round(F.abs(F.col("rate") - F.lag("rate").over(Window.orderBy("day"))), 4)
    return r.withColumn("delta", delta).withColumn("stable", F.col("delta") < 0.05)


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """left with the value of the last right row at or before its time."""
    cols = [c for c in left.columns]
    r = right.where(F.col(value).isNotNull()).select(*by, F.col(at), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols if c not in (*by, at)), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    l = left.select(*by, F.col(at), *(c for c in cols if c not in (*by, at)), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return r.union(l).withColumn(f"asof_{value}", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*cols, f"asof_{value}")


def interval_peak(marks: DataFrame, trace: DataFrame, by: Sequence[str], lo: str, hi: str, at: str, value: str, width: int) -> DataFrame:
    """The largest value of the trace in [lo, hi] of each mark, by buckets of `width` of the time."""
    m = marks.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    t = trace.select(*by, F.floor(F.col(at) / width).alias("_b"), F.col(at).alias("_at"), F.col(value).alias("_v"))
    hit = m.join(t, [*by, "_b"]).where(F.col("_at").between(F.col(lo), F.col(hi)))
    peaks = hit.groupBy(*marks.columns).agg(F.max("_v").alias("peak"))
    return marks.join(peaks, marks.columns, "left")

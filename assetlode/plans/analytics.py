"""Offline analytics over event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlode.operators import analytics
from assetlode.plans.registry import query
from assetlode.sources import adapters as a

C = F.col
DAY = "CAST(ts // 86400000 AS BIGINT)"


def _day():
    return F.floor(C("ts") / 86_400_000)


@query("SELECT event_type, v AS picked FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = least(n - 1, CAST(floor(0.95 * n) AS BIGINT))")
def percentile_nearest(spark, d):
    return analytics.rank_pick(a.table(spark, d, "events"), ["event_type"], "value", analytics.nearest_rank(0.95))


@query("SELECT event_type, v AS picked FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE r = greatest(0, CAST(floor(n * 0.95) AS BIGINT) - 1)")
def percentile_floor(spark, d):
    """The other rule for the 95th percentile: one place lower."""
    return analytics.rank_pick(a.table(spark, d, "events"), ["event_type"], "value", analytics.floor_p95())


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1")
def medians(spark, d):
    return a.table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("SELECT event_type, round(regr_slope(value, user_id), 6) AS slope, round(regr_intercept(value, user_id), 6) AS intercept FROM events GROUP BY 1")
def linear_fit(spark, d):
    return analytics.ols(a.table(spark, d, "events"), ["event_type"], "user_id", "value").select("event_type", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("SELECT event_type, round(sum(user_id * value) / sum(user_id * user_id), 6) AS slope FROM events WHERE user_id <> 0 AND value IS NOT NULL GROUP BY 1")
def origin_slope(spark, d):
    return analytics.slope_through_origin(a.table(spark, d, "events"), ["event_type"], "user_id", "value").select("event_type", F.round("slope", 6).alias("slope"))


@query("SELECT count(*) AS n_rows, count(*) FILTER (ts - before <= 600000) AS n_hits FROM (SELECT ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, id) AS before FROM cache_log)")
def hits_within_gap(spark, d):
    return analytics.within_gap(a.cache_log(spark, d), "event_type", "ts", 600_000)


@query("""SELECT count(*) AS n_rows, count(*) - count(DISTINCT (session, sha256)) AS n_hits, count(DISTINCT session) AS n_sessions FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000 THEN 1 ELSE 0 END) OVER (ORDER BY ts, id) AS session FROM (SELECT *, ts - lag(ts) OVER (ORDER BY ts, id) AS gap FROM cache_log))""")
def hits_within_session(spark, d):
    """Sessions end at gaps of more than half an hour."""
    return analytics.session_hits(a.cache_log(spark, d), "sha256", "ts", 1_800_000)


@query(f"""WITH f AS (SELECT sha256, {DAY} AS day FROM cache_log), g AS (SELECT sha256, min(day) AS first, count(DISTINCT day) AS days FROM f GROUP BY 1)
 SELECT count(*) AS n_rows, count(*) FILTER (day <> first) AS n_hits, count(DISTINCT CASE WHEN days > 1 THEN sha256 END) AS n_multi, CASE WHEN count(DISTINCT CASE WHEN days > 1 THEN sha256 END) > 0 THEN round(count(*) FILTER (day <> first) / count(*), 4) END AS rate FROM f JOIN g USING (sha256)""")
def hits_across_days(spark, d):
    return analytics.cross_day(a.cache_log(spark, d), "sha256", _day())


@query(f"""WITH f AS (SELECT sha256, {DAY} AS day, count(*) AS n FROM cache_log GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY day) AS nth FROM f), p AS (SELECT day, sum(n) AS n, sum(CASE WHEN nth > 1 THEN n ELSE 0 END) AS hits, count(*) FILTER (nth = 2) AS multi FROM g GROUP BY 1),
 q AS (SELECT day, CAST(sum(n) OVER w AS BIGINT) AS n_rows, CAST(sum(hits) OVER w AS BIGINT) AS n_hits, CAST(sum(multi) OVER w AS BIGINT) AS n_multi FROM p WINDOW w AS (ORDER BY day)), r AS (SELECT *, CASE WHEN n_multi > 0 THEN round(n_hits / n_rows, 4) END AS rate FROM q)
 SELECT *, round(abs(rate - lag(rate) OVER (ORDER BY day)), 4) AS delta, round(abs(rate - lag(rate) OVER (ORDER BY day)), 4) < 0.05 AS stable FROM r""")
def rates_by_day(spark, d):
    """The rate of all rows up to each day, and whether it has settled."""
    return analytics.cumulative_rates(a.cache_log(spark, d), "sha256", _day())


@query("""SELECT user_id, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(*) FILTER (event_type = 'error') AS n_errors FROM cache_log GROUP BY 1""")
def session_rollup(spark, d):
    return a.cache_log(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(C("event_type") == "error").alias("n_errors"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, id) AS up, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, id DESC) AS down FROM cache_log)
 SELECT event_type, round(median(value) FILTER (down <= 10) / median(value) FILTER (up <= 10), 6) AS drift FROM r GROUP BY 1""")
def median_drift(spark, d):
    """The median of the last ten over that of the first ten."""
    rows = a.cache_log(spark, d)
    up = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "id"))
    down = F.row_number().over(Window.partitionBy("event_type").orderBy(C("ts").desc(), C("id").desc()))
    first = rows.withColumn("r", up).where("r <= 10").groupBy("event_type").agg(F.median("value").alias("f"))
    last = rows.withColumn("r", down).where("r <= 10").groupBy("event_type").agg(F.median("value").alias("l"))
    return first.join(last, "event_type").select("event_type", F.round(C("l") / C("f"), 6).alias("drift"))


@query("SELECT user_id, CASE WHEN bool_and(event_type = 'click') THEN 'all_click' WHEN bool_and(event_type <> 'click') THEN 'none' ELSE 'not_measured' END AS verdict, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def unanimity(spark, d):
    """A verdict only where all measurements agree."""
    click = C("event_type") == "click"
    return a.table(spark, d, "events").groupBy("user_id").agg(F.when(F.bool_and(click), "all_click").when(F.bool_and(~click), "none").otherwise("not_measured").alias("verdict"), F.count("*").alias("n"))


@query("SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS verdicts, round(min(value) / max(value), 6) AS ratio FROM events GROUP BY 1")
def verdict_sets(spark, d):
    return a.table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("verdicts"), F.round(F.min("value") / F.max("value"), 6).alias("ratio"))


@query("SELECT user_id, count(DISTINCT event_type) AS n_values FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def threshold_conflicts(spark, d):
    """Names that several runs give different values."""
    return a.table(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n_values")).where("n_values > 1")


@query("SELECT max(value) AS max_value, max(epoch_us(ts) // 1000) AS last_at, count(*) AS n FROM events")
def running_gauges(spark, d):
    return a.cache_log(spark, d).agg(F.max("value").alias("max_value"), F.max("ts").alias("last_at"), F.count("*").alias("n"))


_TRACE = "trace AS (SELECT CAST(user_id % 20 AS VARCHAR) AS run, ts AS \"at\", max(value) AS rss FROM cache_log WHERE event_type <> 'purchase' GROUP BY ALL), marks AS (SELECT DISTINCT CAST(user_id % 20 AS VARCHAR) AS run, ts AS \"at\", ts + 3600000 AS until FROM cache_log WHERE event_type = 'purchase')"


def _run():
    """Twenty runs; purchases stand for the marks of a run and all other events for its samples."""
    return (C("user_id") % 20).cast("string").alias("run")


def _trace(spark, d):
    return a.cache_log(spark, d).where("event_type <> 'purchase'").groupBy(_run(), C("ts").alias("at")).agg(F.max("value").alias("rss"))


def _marks(spark, d):
    return a.cache_log(spark, d).where("event_type = 'purchase'").select(_run(), C("ts").alias("at"), (C("ts") + 3_600_000).alias("until")).distinct()


@query(f"WITH {_TRACE} SELECT m.run, m.at, m.until, t.rss AS asof_rss FROM marks m ASOF LEFT JOIN trace t ON m.run = t.run AND m.at >= t.at")
def rss_as_of(spark, d):
    """The last sample at or before each mark."""
    return analytics.as_of(_marks(spark, d), _trace(spark, d), ["run"], "at", "rss")


@query(f"WITH {_TRACE} SELECT m.run, m.at, m.until, max(t.rss) AS peak FROM marks m LEFT JOIN trace t ON m.run = t.run AND t.at BETWEEN m.at AND m.until GROUP BY ALL")
def rss_peaks(spark, d):
    """The highest sample within an hour of each mark."""
    return analytics.interval_peak(_marks(spark, d), _trace(spark, d).withColumnRenamed("at", "t"), ["run"], "at", "until", "t", "rss", 3_600_000)


@query(f"WITH {_TRACE}, base AS (SELECT m.run, m.at, m.until, t.rss AS b FROM marks m ASOF LEFT JOIN trace t ON m.run = t.run AND m.at >= t.at), peak AS (SELECT m.run, m.at, max(t.rss) AS p FROM marks m LEFT JOIN trace t ON m.run = t.run AND t.at BETWEEN m.at AND m.until GROUP BY ALL) SELECT run, \"at\", round(p - b, 6) AS step FROM base JOIN peak USING (run, \"at\")")
def rss_steps(spark, d):
    """Peak less baseline; null where either has no sample."""
    t = _trace(spark, d)
    base = analytics.as_of(_marks(spark, d), t, ["run"], "at", "rss")
    peak = analytics.interval_peak(_marks(spark, d), t.withColumnRenamed("at", "t"), ["run"], "at", "until", "t", "rss", 3_600_000)
    return base.join(peak, ["run", "at", "until"]).select("run", "at", F.round(C("peak") - C("asof_rss"), 6).alias("step"))


@query("SELECT event_type, id, ts - before > 7200000 AS stalled FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, id) AS before FROM cache_log) WHERE before IS NOT NULL")
def stalls(spark, d):
    """Progress that stood still for longer than allowed."""
    before = F.lag("ts").over(Window.partitionBy("event_type").orderBy("ts", "id"))
    return a.cache_log(spark, d).withColumn("before", before).where("before IS NOT NULL").select("event_type", "id", (C("ts") - C("before") > 7_200_000).alias("stalled"))

"""Readers of the offline logs: latency tables, memory traces, JSON results and plain log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.schemas import LOG_SIGNALS


def latencies(spark: SparkSession, path: str) -> DataFrame:
    """code and seconds, separated by tabs; malformed lines are left out."""
    return spark.read.schema("code string, seconds double").option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def memory_trace(spark: SparkSession, path: str) -> DataFrame:
    """unix_ms and rss_kb; lines that aren't two numbers are left out."""
    return spark.read.schema("unix_ms long, rss_kb long").option("mode", "DROPMALFORMED").csv(path).where("unix_ms IS NOT NULL AND rss_kb IS NOT NULL")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema that the caller knows."""
    return spark.read.schema(schema).json(path)


def signals(spark: SparkSession, path: str, samples: int = 3) -> DataFrame:
    """For each known signal the number of lines that show it and the first few of them."""
    lines = spark.read.text(path)
    out = None
    for name, pattern in LOG_SIGNALS.items():
        hit = lines.where(F.col("value").rlike(pattern))
        part = hit.agg(F.count("*").alias("n")).select(F.lit(name).alias("signal"), "n").crossJoin(hit.limit(samples).agg(F.collect_list("value").alias("samples")))  # one row and one row
        out = part if out is None else out.union(part)
    return out

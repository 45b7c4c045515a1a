"""Keyed state without MERGE: a snapshot and a batch give the next snapshot in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: str, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """Columns in first keep their earliest value, those in last take the latest, by arrival order; old rows arrived before."""
    cols = [*keys, *first, *last]
    rows = batch.select(*cols, F.col(order).alias("_order"), F.lit(1).alias("_age"))
    if old is not None:
        rows = old.select(*cols, F.lit(None).cast(batch.schema[order].dataType).alias("_order"), F.lit(0).alias("_age")).union(rows)
    by = F.struct("_age", "_order")
    return rows.groupBy(*keys).agg(*(F.min_by(c, by).alias(c) for c in first), *(F.max_by(c, by).alias(c) for c in last))


def upsert_artifacts(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """batch: project_id, sha256, seq, byte_len, kind, at. seen_count grows by the batch's distinct arrivals."""
    rows = batch.select("project_id", "sha256", "byte_len", "kind", F.col("at").alias("first_seen_at"), F.col("at").alias("last_seen_at"), F.lit(1).cast("long").alias("seen_count"), F.struct(F.lit(1).alias("age"), F.col("seq").cast("long").alias("seq")).alias("o"))
    if old is not None:
        rows = old.select("project_id", "sha256", "byte_len", "kind", "first_seen_at", "last_seen_at", "seen_count", F.struct(F.lit(0).alias("age"), F.lit(0).cast("long").alias("seq")).alias("o")).union(rows)
    return rows.groupBy("project_id", "sha256").agg(F.min_by("byte_len", "o").alias("byte_len"), F.min_by("kind", "o").alias("kind"), F.min_by("first_seen_at", "o").alias("first_seen_at"), F.max_by("last_seen_at", "o").alias("last_seen_at"), F.sum("seen_count").alias("seen_count"))


def claim(old: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose key isn't taken yet, the earliest claim of each; with the old rows, if given."""
    rest = [c for c in batch.columns if c not in keys]
    by = F.struct(*order)
    won = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_won")).select(*keys, *(F.col(f"_won.{c}").alias(c) for c in rest)).select(*batch.columns)
    if old is None:
        return won
    return old.unionByName(won.join(old.select(*keys), list(keys), "left_anti"))


def update_where(rows: DataFrame, guard: Column, **values: Column) -> DataFrame:
    """Sets columns where the guard holds; a guard that isn't true leaves the row as it is."""
    hit = F.coalesce(guard, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def finish(rows: DataFrame, results: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Sets columns of the rows that have a result; results has one row for a key at most."""
    r = results.select(*keys, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    return rows.join(r, list(keys), "left").select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def delete(rows: DataFrame, victims: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.join(victims.select(*keys).distinct(), list(keys), "left_anti")

"""Captures as a stream: admission, then idempotent appends by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assetlode.functions import admission, text
from assetlode.operators import state


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def admit(captures: DataFrame) -> DataFrame:
    """project_id, request_id, seq, url, status, content_type, body, observed_at with the digest of what is admitted."""
    n = F.octet_length("body").cast("long")
    reason = admission.reject_reason(F.col("status"), n, F.col("content_type"), F.col("url"))
    return captures.where(reason.isNull()).select("project_id", "request_id", "seq", "url", "status", "content_type", "observed_at", text.sha256(F.col("body")).alias("sha256"), n.alias("byte_len"))


def start(captures: DataFrame, folder: str, epoch: int = 0) -> StreamingQuery:
    """Appends admitted observations under one folder for each batch and epoch.

    A batch that is run again overwrites its own folder, so counts that are taken
    from the observations don't grow by a repetition.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/observations/epoch={epoch}/batch={batch_id}")

    return admit(captures).writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_progress/{epoch}").trigger(availableNow=True).start()


def observations(spark: SparkSession, folder: str, epoch: int | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/observations")
    return rows if epoch is None else rows.where(F.col("epoch") == epoch)


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """The assets of all batches; a request that was delivered twice counts once."""
    rows = state.claim(None, observations(spark, folder), ("project_id", "sha256", "request_id"), ("batch", "seq"))
    return state.upsert_artifacts(None, rows.select("project_id", "sha256", "seq", "byte_len", F.lit("js").alias("kind"), F.col("observed_at").alias("at")))

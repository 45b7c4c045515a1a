"""Arrow batches for the operators that read whole texts in Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a batch. Texts are not cut, so this bounds what a worker holds at once.
ROWS = 256
#: Rows for which a task is worth a Python worker.
TASK_ROWS = 8192


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies fn to each batch of a few hundred rows; a batch that gives None gives no rows."""
    return map_stream(df, lambda batches: (out for b in batches if (out := fn(b)) is not None), schema)


def map_stream(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies fn to the batches of each partition."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df without a shuffle in as many partitions as its rows need, rows at most, and no fewer than there are cores.

    What Python reads after a shuffle should pass through here: a task costs the executor some 0.2 MB of direct memory,
    empty partition or not, that it gets back only by a collection of old garbage, which a heap with little in use puts off.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def map_groups(df: DataFrame, rows: int, key: str, fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """As groupBy(key).applyInPandas(fn, schema), in gathered() partitions; df has rows at most, and no null key."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for value, part in batch.groupby(key, sort=False):
                if held and value != now:
                    yield fn((now,), pd.concat(held, ignore_index=True))
                    held = []
                now = value
                held.append(part)
        if held:
            yield fn((now,), pd.concat(held, ignore_index=True))

    return gathered(df.repartition(key).sortWithinPartitions(key), rows).mapInPandas(each, schema)


def small_batches(spark: SparkSession) -> None:
    """The operators' results are lazy and read this setting when they run, so it stays lowered in the session."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text, by position, whatever other columns there are; a null text is empty."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def columns(batch: pa.RecordBatch) -> tuple[pa.Array, list[str]]:
    """Ids and texts of a batch that has the columns of texts_of()."""
    return batch.column(0), batch.column(1).to_pylist()


def column_bytes(batch: pa.RecordBatch) -> tuple[pa.Array, list[bytes]]:
    """As columns(), with the texts in UTF-8."""
    return batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()


_INVALID = re.compile("[\ud800-\udfff]")


def utf8(text: str) -> bytes:
    """UTF-8; a lone surrogate, which no Parquet string holds, becomes U+FFFD."""
    try:
        return text.encode()
    except UnicodeEncodeError:
        return _INVALID.sub("�", text).encode()

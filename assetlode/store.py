"""A versioned store of tables: snapshots that readers never see half written, and steps from an old schema to the next."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.operators import state


def copied(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows as an insert into a stricter table takes them: no null or empty key, and the first of each key."""
    whole = rows
    for k in keys:
        whole = whole.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    return state.claim(None, whole, keys, (order,))


class Store:
    """Tables below a folder, each as numbered snapshots; a snapshot counts once its writer's success mark is there.

    steps[i] takes the tables from schema version i to i + 1, by name; versions only go up.
    """

    def __init__(self, spark: SparkSession, folder: str, steps: Sequence[dict[str, Callable[[DataFrame], DataFrame]]] = ()) -> None:
        self.spark, self.folder, self.steps = spark, folder, list(steps)

    def _fs(self, path: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _numbers(self, path: str, prefix: str) -> list[int]:
        fs, at = self._fs(path)
        if not fs.exists(at):
            return []
        found = [s.getPath() for s in fs.listStatus(at)]
        done = [p for p in found if fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix(prefix)) for p in done if p.getName().startswith(prefix))

    def version(self) -> int:
        return max(self._numbers(f"{self.folder}/_versions", "v"), default=0)

    def tables(self) -> list[str]:
        fs, at = self._fs(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if not s.getPath().getName().startswith("_")) if fs.exists(at) else []

    def read(self, name: str) -> DataFrame | None:
        """The latest whole snapshot."""
        numbers = self._numbers(f"{self.folder}/{name}", "s")
        return self.spark.read.parquet(f"{self.folder}/{name}/s{numbers[-1]}") if numbers else None

    def write(self, name: str, rows: DataFrame) -> None:
        """A new snapshot; rows may be derived from the one before, which stays."""
        numbers = self._numbers(f"{self.folder}/{name}", "s")
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/s{max(numbers, default=-1) + 1}")

    def migrate(self) -> int:
        """Takes the steps that the store hasn't taken; gives its version. A version beyond the known steps is refused."""
        at = self.version()
        if at > len(self.steps):
            raise ValueError(f"the store has version {at}, newer than {len(self.steps)}")
        for step in range(at, len(self.steps)):
            for name, change in self.steps[step].items():
                if (rows := self.read(name)) is not None:
                    self.write(name, change(rows))
            self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/_versions/v{step + 1}")
        return self.version()

"""Tables between the steps of a job, kept where every executor can read them."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Percent of the driver's heap that may stay free after a collection, unless its JVM was started with another figure.
MOST_FREE = 50
_OPEN: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where the setting is absent in local mode (tests), a temporary folder is chosen once
    for the session; on a cluster that is an error, as executors don't share such a folder.
    """
    at = spark.conf.get(CHECKPOINT_DIR, None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        at = spark.conf.get("spark.assetlode.localDir", None)
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="assetlode-")
            spark.conf.set("spark.assetlode.localDir", at)
    return at.rstrip("/")


def clean_up(spark: SparkSession) -> None:
    """Removes the folders of this process's jobs; their results can't be read any more."""
    while _OPEN:
        ws = _OPEN.pop()
        if ws.spark.sparkContext is spark.sparkContext:
            ws.drop()


def _at_exit() -> None:
    from pyspark import SparkContext

    spark = SparkSession.getActiveSession()
    if spark is not None and SparkContext._active_spark_context is not None:
        with contextlib.suppress(Exception):  # the cluster may be gone by then
            clean_up(spark)


def release(spark: SparkSession) -> None:
    """Frees what steps of a loop left in the driver: their plans and heap, and by Spark's cleaner their broadcasts and shuffles.

    Without it the driver's heap grows to its limit in a long job, since little of it is in use at a time. What is free goes
    back to the system: by itself the JVM keeps a heap of 3.3 times what is in use, and malloc the pages of threads that ended.
    """
    gc.collect()
    with contextlib.suppress(Py4JError):  # another JVM may lack the setting
        if _managed(spark, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("origin") == "DEFAULT":
            _managed(spark, "HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", str(MOST_FREE))
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(Py4JError):  # since Java 17.0.9, on Linux
        _managed(spark, "DiagnosticCommand", "systemTrimNativeHeap")


def _managed(spark: SparkSession, bean: str, operation: str, *args: str) -> object:
    """What an operation of the driver's JVM gives, by its management interface; the class behind it isn't open to Py4J."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array

    def filled(kind: object, values: Iterable[object]) -> object:
        values = list(values)
        out = array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    named = jvm.java.lang.Class.forName
    call = named("javax.management.MBeanServer").getMethod("invoke", filled(jvm.java.lang.Class, map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))))
    given = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), operation, filled(jvm.java.lang.Object, args), filled(jvm.java.lang.String, ["java.lang.String"] * len(args))
    return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), filled(jvm.java.lang.Object, given))


class Workspace:
    """A folder of Parquet tables for one run of a job; each save cuts the lineage.

    Results are read from it lazily, so it stays until the process ends or clean_up() is called.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not _OPEN:
            atexit.unregister(_at_exit)
            atexit.register(_at_exit)  # after Spark's own, so it runs before it
        _OPEN.append(self)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Removes tables that no later step reads; with no name, the whole folder."""
        jvm = self.spark.sparkContext._jvm
        for at in [self.path(n) for n in names] or [self.base]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

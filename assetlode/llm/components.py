"""Connected components by alternating large-star and small-star, and joins on keys that may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetlode.llm.batches import gathered
from assetlode.workspace import Workspace, release

#: A key with more than this share of all rows is hot; there are 1 / HOT such keys at most.
HOT = 1 / 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, total: int, gather: bool = False) -> DataFrame:
    """Inner join with right, which has one row a key and n, left's rows of that key; total are left's rows.

    The rows of right for hot keys, 1 / HOT at most, are broadcast, so their rows of left stay where they are.
    gather is for results that Python reads next: rows of other keys are then gathered().
    """
    most = max(1, int(total * HOT))
    hot = right.where(F.col("n") > most)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= most).hint("merge"), key)
    return left.join(F.broadcast(hot), key).unionByName(gathered(rest, total) if gather else rest)


def large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the least node that it knows; edges have a < b, and so have the results.

    A node without smaller neighbours keeps its links, so only the others need a look-up.
    moved tells whether a row has changed.
    """
    least = edges.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("m"))
    linked = edges.select("a", "b").join(least.hint("merge"), "a", "left")
    return linked.select(F.coalesce("m", "a").alias("a"), "b", F.col("m").isNotNull().alias("moved"))


def small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them; edges have a < b and moved.

    One row comes out for each distinct row of a node, so rows never grow from step to step;
    equal rows of different nodes meet in the next step.
    """
    once = edges.repartition("b").groupBy("b", "a").agg(F.max("moved").alias("moved"))
    known = once.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    stays = F.col("a") == F.col("m")
    return known.select(F.col("m").alias("a"), F.when(stays, F.col("b")).otherwise(F.col("a")).alias("b"), (F.col("moved") | ~stays).alias("moved"))


def components(ws: Workspace, edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component, its least node, for each node of an edge; edges are (a, b) in any order.

    A step that moves no row has found stars only: no centre has a smaller neighbour, and each
    other node has one centre. A step shuffles three times, the first time one row a node and task;
    whether a row moved is looked up without a shuffle.
    """
    now = ws.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-0")
    moved, step = True, 0
    while moved:
        step += 1
        now = ws.save(small_star(large_star(now)), f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}")
        moved = bool(now.where("moved").take(1))
        release(ws.spark)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()

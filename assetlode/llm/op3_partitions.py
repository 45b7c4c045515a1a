"""Nearest neighbours by learned partitions.

On a bounded sample (SAMPLE vectors, by a hash of the id) the exact neighbour
graph is built and cut into balanced partitions: the sample is halved along its
main directions, then vertices move to the partition that holds most of their
neighbours, most gain first, while no partition outgrows BALANCE times its share.
A small network with one hidden layer learns the partition of a vector. Every row
is put into its most probable partition, a query goes to several most probable
ones, and their rows are ranked by cosine in double precision. There is a partition for
PART_ROWS rows, but LEARNT vectors of the sample for each at least, so beyond
SAMPLE / LEARNT partitions these grow with the table. How many are visited is the
least number that finds RECALL of the sample's own neighbours: few where the
vectors form clusters, and most of them where they fill the space evenly, as no
partition can tell then where the neighbours are.

Of rows with equal vectors only the K + 1 with the smallest ids can be among the
K nearest of anything, as ties go to the smaller id; the others aren't indexed
twice over. Equal queries are searched once. A partition is dealt out in blocks of
BLOCK rows by BLOCK queries, so a large one is searched by many tasks.

Defined results: vectors that are null, zero, hold null or non-finite components,
or haven't the table's most frequent length (the shorter one of equally frequent)
take no part; rows with a null id take no part; of rows that share an id the one with
the least digest of its vector is taken, as one query and one candidate; a query's own
id is no candidate of it; with a single partition every row is searched; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlode.llm.batches import documents, map_batches, map_stream
from assetlode.workspace import Workspace

SAMPLE, NEIGHBOURS, BALANCE = 8_192, 10, 1.1
#: Rows that a partition is planned for, and vectors of the sample that it is learned from at least.
PART_ROWS, LEARNT = 400, 32
#: Recall that the number of probes is chosen for, on the sample; queries that it is measured with.
RECALL, TRIALS, LEAST_PROBES = 0.95, 1_024, 4
HIDDEN, EPOCHS, RATE = 128, 25, 0.004
BLOCK = 2048
K = 5
_SEED = 77


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, the components as bytes of doubles, and a digest of them."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    d = sizes.orderBy(F.desc("n"), "d").select("d").head()
    width = d[0] if d else 1

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, vectors = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = v.values
            if x.null_count == 0:
                x = x.to_numpy()
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vectors.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array([xxhash.xxh3_128_digest(v) for v in vectors], pa.binary())], ["vec_id", "vec", "digest"])

    return map_batches(rows.where(F.size("v") == width), each, "vec_id long, vec binary, digest binary")


def _rows(column: pa.Array) -> np.ndarray:
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), np.float64).reshape(len(data), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither too large nor too small to square
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """The k nearest of each row, itself left out."""
    out = np.empty((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        out[i : i + 512] = np.argpartition(-s, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
    return out


def _halve(x: np.ndarray, rows: np.ndarray, parts: int, first: int, out: np.ndarray) -> None:
    if parts == 1 or len(rows) < 2:
        out[rows] = first
        return
    centred = x[rows] - x[rows].mean(axis=0)
    direction = centred[int(np.argmax((centred**2).sum(axis=1)))]
    for _ in range(12):
        direction = centred.T @ (centred @ direction)
        direction /= np.linalg.norm(direction) or 1.0
    order = rows[np.argsort(centred @ direction, kind="stable")]
    left = parts // 2
    cut = len(rows) * left // parts
    _halve(x, order[:cut], left, first, out)
    _halve(x, order[cut:], parts - left, first + left, out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A partition of each row, cutting few edges of the graph."""
    part = np.zeros(len(x), np.int64)
    _halve(x, np.arange(len(x)), parts, 0, part)
    most = int(np.ceil(len(x) / parts * BALANCE))
    sizes = np.bincount(part, minlength=parts)
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    ends = np.concatenate([source, target]), np.concatenate([target, source])
    for _ in range(rounds):
        links = np.zeros((len(x), parts), np.int32)
        np.add.at(links, (ends[0], part[ends[1]]), 1)
        best = links.argmax(axis=1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            if sizes[best[v]] < most:
                sizes[part[v]] -= 1
                sizes[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Probabilities of the partitions of a vector, by a network with one hidden layer."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int) -> None:
        rng = np.random.default_rng(_SEED)
        d = x.shape[1]
        w = [rng.normal(0, (2 / d) ** 0.5 * d**0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
        m, s, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                h = np.maximum(x[rows] @ w[0] + w[1], 0)
                q = _softmax(h @ w[2] + w[3])
                q[np.arange(len(rows)), part[rows]] -= 1
                q /= len(rows)
                back = (q @ w[2].T) * (h > 0)
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for j, g in enumerate((x[rows].T @ back, back.sum(axis=0), h.T @ q, q.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * g
                    s[j] = 0.999 * s[j] + 0.001 * g * g
                    w[j] -= rate * (m[j] / (1 - 0.9**step)) / (np.sqrt(s[j] / (1 - 0.999**step)) + 1e-8)
        self.w = w

    def probable(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable partitions of each row, most probable first."""
        z = np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]
        return np.argsort(-z, axis=1, kind="stable")[:, :n]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: DataFrame, n_rows: int) -> tuple[Router, int]:
    """The router, learned on a bounded sample of distinct vectors, and the number of partitions that a query goes to."""
    few = rows.dropDuplicates(["digest"]).orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vec").collect()
    parts = max(1, min(n_rows // PART_ROWS, len(few) // LEARNT))
    x = unit(np.frombuffer(b"".join(bytes(r.vec) for r in few), np.float64).reshape(len(few), -1))
    if len(x) < 2:
        return Router(x, np.zeros(len(x), np.int64), 1), 1
    graph = neighbour_graph(x)
    router = Router(x, balanced_partition(x, graph, parts), parts)
    return router, _probes(router, x, graph, parts)


def _probes(router: Router, x: np.ndarray, graph: np.ndarray, parts: int) -> int:
    own = router.probable(x, 1)[:, 0]
    trials = np.arange(0, len(x), max(1, len(x) // TRIALS))
    s = x[trials] @ x.T
    s[np.arange(len(trials)), trials] = -2
    nearest = np.argpartition(-s, min(K, len(x) - 1), axis=1)[:, :K]
    place = router.probable(x[trials], parts).argsort(axis=1)
    reached = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    return min(parts, max(LEAST_PROBES, int(reached[int(np.ceil(RECALL * len(reached))) - 1]) + 1))


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the rows of the k largest cosines, ties to smaller ids, and the cosines."""
    xu, qu = unit(x), unit(q)
    rough = qu @ xu.T
    for i in range(len(q)):
        s = rough[i]
        rows = np.arange(len(s))
        if len(s) > k:
            rows = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9)
        exact = cosine(x[rows], q[i])  # row by row, so equal vectors get equal scores
        order = np.lexsort((ids[rows], -exact))[:k]
        yield rows[order], exact[order]


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        c = (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
    if np.isfinite(c).all():
        return c
    scaled, other = x / np.abs(x).max(axis=1, keepdims=True), q / np.abs(q).max()
    return (scaled * other).sum(axis=1) / (np.sqrt((scaled * scaled).sum(axis=1)) * np.sqrt((other * other).sum()))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition and block, the indexed ones (role 0) before the queries."""
    at, index, queries = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if not index or not queries:
            return
        ids = np.concatenate([b.column("vec_id").to_numpy() for b in index])
        x = np.concatenate([_rows(b.column("vec")) for b in index])
        q = np.concatenate([_rows(b.column("vec")) for b in queries])
        digests = [d for b in queries for d in b.column("digest").to_pylist()]
        for lo in range(0, len(q), 256):
            found = list(_nearest(x, ids, q[lo : lo + 256], K + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, (rows, _) in zip(digests[lo : lo + 256], found, strict=True) for _ in rows], pa.binary()), pa.array(np.concatenate([ids[rows] for rows, _ in found])), pa.array(np.concatenate([s for _, s in found]))],
                ["digest", "vec_id", "score"])

    for batch in batches:
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(keys[lo][:3])
            if key != at:
                yield from flush()
                at, index, queries = key, [], []
            (queries if keys[lo][3] else index).append(batch.slice(lo, hi - lo))
    yield from flush()


def neighbours(table: DataFrame, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the K nearest found of each row whose id is divisible by `every`."""
    spark = table.sparkSession
    ws = Workspace(spark, "partitions")
    found = usable(table, id_col, vector_col).groupBy("vec_id").agg(F.min(F.struct("digest", "vec")).alias("v"))
    rows = ws.save(found.select("vec_id", "v.vec", "v.digest"), "rows")
    n_rows = rows.count()
    if not n_rows:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router, probes = fit(rows, n_rows)
    shared = spark.sparkContext.broadcast(router)

    def routed(df: DataFrame, n: int) -> DataFrame:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            to = shared.value.probable(unit(_rows(batch.column(1))), n) if batch.num_rows else np.zeros((0, 1), np.int64)
            return batch.append_column("parts", pa.array(to.tolist(), pa.list_(pa.int64())))

        return map_batches(df.select("vec_id", "vec", "digest"), each, "vec_id long, vec binary, digest binary, parts array<long>").withColumn("part", F.explode("parts")).drop("parts")

    # row_number up to a limit is cut before the shuffle too, so copies of one vector don't meet in one task
    copies = Window.partitionBy("digest").orderBy("vec_id")
    indexed = ws.save(routed(rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= K + 1), 1), "indexed")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = ws.save(routed(asked.groupBy("digest").agg(F.min("vec_id").alias("vec_id"), F.first("vec").alias("vec")), probes), "queries")
    blocks = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    plan = ws.save(blocks(indexed, "n_x").join(blocks(queries, "n_q"), "part"), "plan")  # a row for each partition, SAMPLE / LEARNT at most
    own = lambda n: F.pmod(F.xxhash64("digest", "vec_id"), F.col(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("vec_id", "vec", "digest")
    x = indexed.join(F.broadcast(plan), "part").select("part", own("n_x").alias("bx"), every_block("n_q").alias("bq"), F.lit(0).alias("role"), *cols)
    q = queries.join(F.broadcast(plan), "part").select("part", every_block("n_x").alias("bx"), own("n_q").alias("bq"), F.lit(1).alias("role"), *cols)
    dealt = x.union(q).repartition("part", "bx", "bq").sortWithinPartitions("part", "bx", "bq", "role")
    found = map_stream(dealt, _search, "digest binary, vec_id long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= K + 1)
    each_query = asked.select("digest", F.col("vec_id").alias("query_id")).join(best, "digest").where("query_id <> vec_id")
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return each_query.select("query_id", ranks.alias("rank"), "vec_id", "score").where(F.col("rank") <= K)


def op3_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir, "embeddings"))

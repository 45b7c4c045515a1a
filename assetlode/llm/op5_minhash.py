"""Near-duplicate documents by MinHash, banding, verification and connected components.

A document's set is its distinct shingles of WORDS words as 64-bit hashes. Rows
with equal sets form a class, known by the 128-bit digest of the set; the classes are
the nodes.

1. BANDS * ROWS minima of multiply-shift hash functions are cut into bands; nodes
   that share a band share a bucket. A pair of similarity s shares none with
   probability (1 - s**ROWS)**BANDS: 2e-5 at 0.75, and less above.
2. Each member of a bucket is paired with the bucket's least node only, so a
   bucket of n members makes n - 1 pairs. The signatures of a pair are held against
   each other, on one byte of each minimum; a pair passes unless the estimate falls
   below ESTIMATE (4.9 standard errors under the threshold). Pairs that pass join
   their nodes to clusters.
3. These pairs are verified on the full sets, which joins most nodes of a cluster to
   groups, in a number of steps that is linear in the nodes.
4. In clusters of several groups the nodes outside the largest one are held against
   all nodes of the cluster on full sets, in tasks of BLOCK by BLOCK nodes. A task skips
   what is joined already and gives only the links that join something, so rows don't
   grow with the pairs, and sets are copied only as often as outsiders fill blocks.
5. Buckets whose members lie in several clusters are gone through too: members
   outside the cluster of the bucket's least node against all members, on the
   signatures, in blocks; what passes is verified on full sets.
6. The links are joined to components. No pair that shares a bucket is left out.

A bucket, class, star or cluster of any size is dealt out: minima are taken before rows
are shuffled, and what a key with more than HOT of all rows needs goes by broadcast
(1 / HOT such keys at most) or in copies, so no task gets such a key's rows. The star
steps of step 6 don't split a node's links: there the least node of a large component
meets all of its links in one task. The
tables between the steps are in the shared folder and are removed as soon as they
aren't needed.

Joins of large tables are sort-merge joins at every size, as a broadcast that only
small inputs get would hide what large ones shuffle.

Defined results: a null or empty text, or one of white space only, has an empty
set and is linked with nothing. Rows that share an id are one document: the classes of
their texts are linked, and each is held against all others. A row with
a null id gets the component of its text, null if no id is in it, and isn't kept. An
empty table gives no rows; other columns are not read. In deduplicated() a row with a
null id stays if no row with an id is in its component, and rows without a set stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlode.llm.batches import column_bytes, documents, map_batches, map_stream, texts_of
from assetlode.llm.components import components, hot_join
from assetlode.workspace import Workspace

WORDS, PERCENT = 5, 75
ROWS, BANDS = 5, 40
ESTIMATE = 0.60
BLOCK, BUCKET_BLOCK = 256, 1024
#: Pairs of one node that a task takes at most.
STAR = 1024
_SEED = 20_240_229
#: Shingles that meet all hash functions at once; bounds the memory of a long text.
_AT_ONCE = 4096

_random = np.random.default_rng(_SEED)
_A = _random.integers(1, 2**63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 2**63, ROWS * BANDS, np.uint64)
_M = _random.integers(1, 2**63, max(WORDS, ROWS) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _random.integers(0, 2**63, BANDS, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _M[-1]
    return x ^ x >> np.uint64(29)


def shingles(text: bytes) -> np.ndarray:
    """The set, as sorted hashes; ASCII letters are taken in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < WORDS:
        return _mix(np.array([(_mix(h + np.arange(len(h), dtype=np.uint64)) * _M[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += _mix(h[i : i + n] + np.uint64(i)) * _M[i]
    return np.unique(_mix(total))


def minima(found: np.ndarray) -> np.ndarray:
    """Of each hash function the least value over the set; the upper 32 bits count."""
    out = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), _AT_ONCE // 8):
        part = found[i : i + _AT_ONCE // 8]
        np.minimum(out, (part[:, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands(least: np.ndarray) -> np.ndarray:
    return _mix((_mix(least.astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)) * _M[:ROWS]).sum(axis=1) + _BAND_SALT).view(np.int64)


def digest_of(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a hash of the text; for a set that isn't empty its digest, bands and the low byte of each minimum."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = column_bytes(batch)
        n, digests, keys, sketches = [], [], [], []
        for text in texts:
            found = shingles(text)
            n.append(len(found))
            if not len(found):
                for col in (digests, keys, sketches):
                    col.append(None)
                continue
            least = minima(found)
            digests.append(digest_of(found))
            keys.append(bands(least))
            sketches.append((least & np.uint32(255)).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), batch.column(2), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "text_hash", "digest", "bands", "sketch"])

    return map_batches(texts_of(docs).withColumn("text_hash", F.xxhash64("text")), each, "doc_id long, n_shingles long, text_hash long, digest binary, bands array<long>, sketch binary")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its set as bytes, for the nodes given; the rows that stand for a class are read again."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in column_bytes(batch)[1]]
        return pa.RecordBatch.from_arrays([pa.array(map(digest_of, found), pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], ["node", "found"])

    some = classes.join(nodes.select("node").distinct().hint("merge"), "node", "left_semi")
    key = F.coalesce(F.col("doc_id"), F.xxhash64("text"))  # of a class without ids its text stands for it
    wanted = some.select(F.coalesce("doc_id", "text_hash").alias("key")).distinct().hint("merge")
    return map_batches(texts_of(docs).withColumn("key", key).join(wanted, "key", "left_semi").select("doc_id", "text"), each, "node binary, found binary").groupBy("node").agg(F.min("found").alias("found"))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from equal bytes; a byte is equal by chance once in 256."""
    share = (a == b).mean(axis=-1)
    return (share - 1 / 256) / (1 - 1 / 256)


def _near_size(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs with n, the pairs that have the same a; pairs is a table."""
    return hot_join(pairs, pairs.groupBy("a").agg(F.count("*").alias("n")), "a", pairs.count())


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches let pass; pairs and nodes are tables."""
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    tally = pairs.groupBy("a").agg(F.count("*").alias("n"))
    joined = hot_join(pairs.join(of("b").hint("merge"), "b"), of("a").join(tally.hint("merge"), "a"), "a", pairs.count()).select("a", "b", "na", "nb", "sa", "sb")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = _near_size(batch.column(2).to_numpy(), batch.column(3).to_numpy())
        if batch.num_rows:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (4, 5))
            near &= estimate(sa, sb) >= ESTIMATE
        return batch.select(["a", "b"]).filter(pa.array(near))

    return map_batches(joined, each, "a binary, b binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold; a set that meets more than STAR others goes to several tasks. pairs and sets are tables."""
    dealt = _dealt(pairs).withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / STAR)).cast("int"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    first = parts.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")).hint("merge"), "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    joined = dealt.join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")).hint("merge"), "b").join(first.hint("merge"), ["a", "part"]).select("a", "b", "fa", "fb")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for fa, fb in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(fa.as_buffer(), np.uint64), np.frombuffer(fb.as_buffer(), np.uint64)
            keep.append(_linked(x, y))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(joined, each, "a binary, b binary")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of equal leading columns, from rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        keys = np.column_stack([batch.column(i).to_numpy() for i in range(n_keys)])
        if not len(keys):
            continue
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(keys[lo])
            if key != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of the values."""
    values = column.to_pylist()
    rank = {v: i for i, v in enumerate(sorted(set(values)))}
    return np.array([rank[v] for v in values], np.int64)


class _Block:
    """A block of outsiders (role 0) and a block of members (role 1) of one key."""

    def __init__(self, table: pa.Table) -> None:
        self.names = table.column("node").to_pylist()
        self.node, self.group = _codes(table.column("node")), _codes(table.column("own"))
        self.n, outside, role = (table.column(c).to_numpy() for c in ("n_shingles", "outside", "role"))
        self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(role), -1)
        self.out, self.members = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        self.inside = outside == 0

    def likely(self, o: int, root: np.ndarray) -> np.ndarray:
        """Members that outsider o may be linked with; two outsiders meet twice and count where the smaller one is the outsider."""
        other = self.members
        other = other[(root[other] != root[o]) & _near_size(self.n[other], self.n[o]) & (self.inside[other] | (self.node[other] > self.node[o]))]
        return other[estimate(self.sketch[other], self.sketch[o]) >= ESTIMATE] if len(other) else other


def _pairs_of(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.binary()), pa.array([max(p) for p in found], pa.binary())], ["a", "b"])


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links that join two groups; rows come sorted by block."""
    for table in _groups(batches, 3):
        block = _Block(table)
        root, links = block.group.copy(), []
        sets = [np.frombuffer(f, np.uint64) for f in table.column("found").to_pylist()]
        for o in block.out.tolist():
            for y in block.likely(o, root).tolist():
                if root[o] != root[y] and _linked(sets[o], sets[y]):
                    links.append((block.names[o], block.names[y]))
                    root[root == root[y]] = root[o]
        if links:
            yield _pairs_of(links)


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Likely pairs of two groups; rows come sorted by block."""
    for table in _groups(batches, 3):
        block = _Block(table)
        for o in block.out.tolist():
            if len(hit := block.likely(o, block.group)):
                yield _pairs_of([(block.names[o], block.names[y]) for y in hit.tolist()])


def _dealt_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Outsiders and members of each key by blocks; rows has key, node, own, outside, n_all, n_out and more, which go along."""
    blocks = lambda n: F.ceil(F.col(n) / size).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    cols = [c for c in rows.columns if c not in ("key", "n_all", "n_out")]
    outs = rows.where("outside = 1").select("key", own("n_out").alias("i"), every("n_all").alias("j"), F.lit(0).alias("role"), *cols)
    members = rows.select("key", every("n_out").alias("i"), own("n_all").alias("j"), F.lit(1).alias("role"), *cols)
    return outs.union(members).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "role")


def cluster_links(ws: Workspace, clusters: DataFrame, groups: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links between the groups of each cluster."""
    here = ws.save(clusters.join(groups.select("node", F.col("component").alias("own")).hint("merge"), "node", "left").withColumn("own", F.coalesce("own", "node")), "grouped")
    sizes = here.groupBy("component", "own").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("component").agg(F.sum("n").alias("n"), F.max("n").alias("n_main"), F.max(F.struct("n", "own"))["own"].alias("main")).where("n > n_main")
    rows = hot_join(here, mixed, "component", here.count()).select(F.xxhash64("component").alias("key"), "node", "own", (F.col("own") != F.col("main")).cast("int").alias("outside"), F.col("n").alias("n_all"), (F.col("n") - F.col("n_main")).alias("n_out"))
    rows = ws.save(rows, "mixed").join(nodes.select("node", "n_shingles", "sketch").hint("merge"), "node").join(sets.hint("merge"), "node")
    return map_stream(_dealt_blocks(rows, BLOCK), _block_links, "a binary, b binary")


def across_pairs(ws: Workspace, members: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Likely pairs of different clusters within buckets; members has key, node, centre."""
    own = clusters.select("node", F.col("component").alias("own"))
    here = ws.save(members.join(own.hint("merge"), "node", "left").withColumn("own", F.coalesce("own", "node")), "here")
    # the centre is a member of its bucket, so the bucket's aggregate knows its cluster
    mixed = here.groupBy("key").agg(F.count("*").alias("n"), F.min(F.when(F.col("node") == F.col("centre"), F.col("own"))).alias("main"), F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").drop("x", "y")
    outside = hot_join(here, mixed, "key", here.count()).withColumn("outside", (F.col("own") != F.col("main")).cast("int"))
    outside = ws.save(outside.select("key", "node", "own", "outside", F.col("n").alias("n_all")), "outside")
    counts = outside.groupBy("key").agg(F.sum("outside").alias("n_out"), F.count("*").alias("n"))
    rows = hot_join(outside, counts, "key", outside.count()).drop("n").join(nodes.select("node", "n_shingles", "sketch").hint("merge"), "node")
    return map_stream(_dealt_blocks(rows, BUCKET_BLOCK), _block_pairs, "a binary, b binary").distinct()


def _same_id(rows: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id and differ in text."""
    known = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("last")).where("a <> last").select("doc_id", "a")
    return known.select("doc_id", F.col("digest").alias("b")).join(twice.hint("merge"), "doc_id").where("a <> b").select("a", "b").distinct()


def linked(ws: Workspace, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The measured rows, and of each class the digest, its rows n, its component's name, least doc_id and the class that has it."""
    rows = ws.save(measured(docs), "measured")
    classes = rows.where("n_shingles > 0").groupBy(F.col("digest").alias("node")).agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.count("*").alias("n"), F.min("n_shingles").alias("n_shingles"), F.min_by("bands", "doc_id").alias("bands"), F.first("bands").alias("any_bands"), F.min("sketch").alias("sketch"))
    classes = ws.save(classes.withColumn("bands", F.coalesce("bands", "any_bands")).drop("any_bands"), "classes")
    keys = classes.select(F.explode("bands").alias("key"), "node")
    shared = keys.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last"), F.count("*").alias("n")).where("centre <> last").drop("last")
    members = ws.save(hot_join(keys, ws.save(shared, "shared"), "key", classes.count() * BANDS).drop("n"), "members")
    nodes = ws.save(classes.select("node", "n_shingles", "sketch").join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "nodes")
    star = ws.save(members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "star")
    near = ws.save(likely(star, nodes), "near")
    clusters = ws.save(components(ws, near, "clusters"), "clustered")
    across = ws.save(across_pairs(ws, members, nodes, clusters), "across")
    ws.drop("members", "here", "outside", "star", "shared")
    sets = ws.save(full_sets(docs, classes, clusters.select("node").union(across.select("a")).union(across.select("b"))), "sets")
    first = ws.save(confirmed(near, sets), "first")
    groups = ws.save(components(ws, first, "groups"), "grouped_by_stars")
    within = ws.save(cluster_links(ws, clusters, groups, nodes, sets), "within")
    links = first.union(within).union(confirmed(across, sets)).union(_same_id(rows))
    final = ws.save(components(ws, links, "linked"), "final")
    ws.drop("sets", "near", "nodes", "mixed", "grouped", "within", "first", "across", "clustered", "grouped_by_stars")
    named = ws.save(classes.select("node", "doc_id", "n").join(final.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    # nulls last: a class without ids is first only where none has one
    least = named.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "node")).alias("least")).select("component", "n", F.col("least.doc_id").alias("component_id"), F.col("least.node").alias("first_node"))
    labels = hot_join(named.select("component", F.col("node").alias("digest"), F.col("n").alias("rows")), least, "component", classes.count())
    return rows, ws.save(labels.select("digest", F.col("rows").alias("n"), "component_id", "first_node"), "labels")


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    ws = Workspace(docs.sparkSession, "minhash")
    rows, labels = linked(ws, docs)
    ws.drop("classes", "final", "named")
    of = hot_join(rows.where("n_shingles > 0").select("doc_id", "n_shingles", "digest"), labels, "digest", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return of.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each component, with all their columns."""
    ws = Workspace(docs.sparkSession, "minhash")
    labels = linked(ws, docs)[1]
    first = labels.where("digest = first_node").select(F.col("first_node").alias("own_digest"), F.col("component_id").alias("own_id"))
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("own_digest", T.BinaryType())])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles((t or "").encode()) for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest_of(f) if len(f) else None for f in found], pa.binary())], [*batch.schema.names, "own_digest"])

    names = [f"`{c}`" for c in docs.columns]
    marked = map_batches(docs, each, schema)
    alone = marked.where("own_digest IS NULL").select(*names)
    leading = marked.join(first.hint("merge"), "own_digest").where(F.col("doc_id").eqNullSafe(F.col("own_id")))
    return leading.dropDuplicates(["own_digest"]).select(*names).union(alone)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(documents(spark, sf_dir))

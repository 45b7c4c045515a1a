"""Views that stand in for captured traffic, made from the driver's tables.

The test tables hold no captures. Each view is given twice, for Spark and for
DuckDB, and both must give the same rows. They are synthetic adapters: nothing in
the engine depends on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlode.functions import admission, text
from assetlode.operators import state

T0 = 1_700_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.col("lang").alias("project_id"), i.alias("seq"), i.cast("string").alias("request_id"), F.col("text").alias("body"),
        F.when(i % 17 == 0, 304).when(i % 13 == 0, 404).otherwise(200).alias("status"),
        F.element_at(F.array(F.lit("application/javascript; charset=utf-8"), F.lit("text/html"), F.lit("TEXT/JavaScript"), F.lit(None).cast("string"), F.lit("application/json")), (i % 5 + 1).cast("int")).alias("content_type"),
        F.concat(F.lit("https://"), F.when(i % 11 == 0, "user:pw@").otherwise(""), F.col("source"), F.lit(".example.com/assets;v=1/"), (i % 97).cast("string"), F.element_at(F.array(F.lit(".js"), F.lit(".MJS?v=1&token=abc&flag"), F.lit(".css#top")), (i % 3 + 1).cast("int"))).alias("url"),
        F.col("source").alias("host"), (F.lit(T0) + i * 37).alias("observed_at"), F.octet_length("text").cast("long").alias("n_bytes"),
    )


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir)
    return c.withColumn("sha256", text.sha256(F.col("body"))).where(admission.reject_reason(F.col("status"), F.col("n_bytes"), F.col("content_type"), F.col("url")).isNull())


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admitted(spark, sf_dir).select("project_id", "sha256", "request_id", "url", F.col("status").cast("long").alias("status"), "content_type", "observed_at")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.upsert_artifacts(None, admitted(spark, sf_dir).select("project_id", "sha256", "seq", F.col("n_bytes").alias("byte_len"), F.lit("js").alias("kind"), F.col("observed_at").alias("at")))


def analysis_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each admitted capture that isn't divisible by 10; copies claim the same work again."""
    i = F.col("seq")
    states = F.array(*(F.lit(s) for s in ("pending", "running", "partial", "failed", "done", "done", "done")))
    return admitted(spark, sf_dir).where("seq % 10 <> 0").select(
        "project_id", "sha256", F.concat(F.lit("set-"), (i % 3).cast("string")).alias("detector_set_hash"), "seq",
        F.element_at(states, (i % 7 + 1).cast("int")).alias("scan_state"), (i % 29 / 8).alias("max_slice_ms"),
        (F.col("observed_at") + 5).alias("started_at"), F.when(i % 7 >= 2, F.col("observed_at") + 5 + i % 91).alias("finished_at"),
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.claim(None, analysis_claims(spark, sf_dir), ("project_id", "sha256", "detector_set_hash"), ("started_at", "seq")).drop("seq")


def map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of one map for each conversation; every ninth has no content."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project_id"), F.col("conv_id"), F.col("turn").cast("int").alias("source_index"),
        F.concat(F.element_at(F.array(F.lit("webpack:///src/"), F.lit("../lib/"), F.lit("/abs/"), F.lit("C:\\work\\")), (F.col("turn") % 4 + 1).cast("int")), F.col("role"), F.lit("/m"), F.col("turn").cast("string"), F.when(F.col("turn") % 2 == 0, ".ts?x=1").otherwise(".vue")).alias("label"),
        F.when((F.col("conv_id") + F.col("turn")) % 9 != 0, F.col("text")).alias("content"),
    )


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = map_entries(spark, sf_dir)
    return m.select(
        "project_id", F.sha2((F.col("conv_id") % 40).cast("string"), 256).alias("artifact_sha256"), F.sha2(F.col("conv_id").cast("string"), 256).alias("map_sha256"), "source_index",
        F.col("conv_id").cast("string").alias("request_id"), F.sha2(F.col("content"), 256).alias("source_sha256"), F.col("label").alias("sources_verbatim"),
        F.element_at(F.array(F.lit("producible"), F.lit("gone"), F.lit("producible")), (F.col("conv_id") % 3 + 1).cast("int")).alias("producibility"), (F.lit(T0) + F.col("conv_id") * 1000 + F.col("source_index")).alias("recovered_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two thirds of the conversations, so that some sightings lack their source and some sources their sighting."""
    m = map_entries(spark, sf_dir).where("content IS NOT NULL AND conv_id % 4 <> 1")
    extra = m.where("conv_id % 5 = 0").withColumn("content", F.concat(F.lit("orphan "), F.col("content")))
    rows = m.union(extra).select("project_id", F.sha2("content", 256).alias("source_sha256"), F.octet_length("content").cast("long").alias("byte_len"), text.line_count(F.col("content")).alias("line_count"), (F.lit(T0) + F.col("conv_id") * 1000).alias("first_seen_at"), (F.col("conv_id") * 100 + F.col("source_index")).alias("seq"))
    return state.upsert(None, rows, ("project_id", "source_sha256"), "seq", first=("first_seen_at",), last=("byte_len", "line_count"))


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string"), F.lit("-"), F.col("event_type")).alias("sha256"), F.col("event_type"), F.col("user_id"), F.col("value"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of settings in order; project '' is global."""
    e = table(spark, sf_dir, "events")
    return e.select(F.element_at(F.array(F.lit(""), F.lit("p0"), F.lit("p1")), (F.col("user_id") % 3 + 1).cast("int")).alias("project_id"), F.concat(F.lit("key"), (F.col("user_id") % 5).cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("seq"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"), F.concat(F.lit("e"), (F.col("event_id") % 4000).cast("string")).alias("event_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject"), F.col("event_id").alias("seq"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("project_id"), F.col("o_orderkey").alias("scan_id"), F.element_at(F.array(F.lit("running"), F.lit("suspended"), F.lit("completed"), F.lit("discarded"), F.lit("completed")), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("state"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_at"), (F.col("o_custkey") % 7).alias("epoch"))


#: The same views in DuckDB's SQL, in an order in which each uses only those before it.
SQL = {
    "captures": f"""SELECT lang AS project_id, doc_id AS seq, CAST(doc_id AS VARCHAR) AS request_id, text AS body,
        CASE WHEN doc_id % 17 = 0 THEN 304 WHEN doc_id % 13 = 0 THEN 404 ELSE 200 END AS status,
        ['application/javascript; charset=utf-8', 'text/html', 'TEXT/JavaScript', NULL, 'application/json'][doc_id % 5 + 1] AS content_type,
        'https://' || CASE WHEN doc_id % 11 = 0 THEN 'user:pw@' ELSE '' END || source || '.example.com/assets;v=1/' || (doc_id % 97) || ['.js', '.MJS?v=1&token=abc&flag', '.css#top'][doc_id % 3 + 1] AS url,
        source AS host, {T0} + doc_id * 37 AS observed_at, strlen(text) AS n_bytes FROM documents""",
    "judged": """SELECT *, CASE WHEN status = 304 THEN 'revalidation' WHEN status NOT BETWEEN 200 AND 299 THEN 'status' WHEN n_bytes = 0 THEN 'empty' WHEN n_bytes > 8388608 THEN 'too_large'
        WHEN NOT (coalesce(lower(trim(split_part(content_type, ';', 1))) IN ('application/javascript', 'text/javascript'), false) OR regexp_matches(lower(split_part(split_part(url, '#', 1), '?', 1)), '[.]m?js$')) THEN 'not_scriptish' END AS reject_reason FROM captures""",
    "admitted": "SELECT *, sha256(body) AS sha256 FROM judged WHERE reject_reason IS NULL",
    "observations": "SELECT project_id, sha256, request_id, url, CAST(status AS BIGINT) AS status, content_type, observed_at FROM admitted",
    "artifacts": "SELECT project_id, sha256, arg_min(n_bytes, seq) AS byte_len, 'js' AS kind, arg_min(observed_at, seq) AS first_seen_at, arg_max(observed_at, seq) AS last_seen_at, count(*) AS seen_count FROM admitted GROUP BY ALL",
    "analysis_claims": "SELECT project_id, sha256, 'set-' || (seq % 3) AS detector_set_hash, seq, ['pending', 'running', 'partial', 'failed', 'done', 'done', 'done'][seq % 7 + 1] AS scan_state, seq % 29 / 8 AS max_slice_ms, observed_at + 5 AS started_at, CASE WHEN seq % 7 >= 2 THEN observed_at + 5 + seq % 91 END AS finished_at FROM admitted WHERE seq % 10 <> 0",
    "analyses": "SELECT * EXCLUDE (seq, r) FROM (SELECT *, row_number() OVER (PARTITION BY project_id, sha256, detector_set_hash ORDER BY started_at, seq) AS r FROM analysis_claims) WHERE r = 1",
    "map_entries": r"""SELECT 'p' || (conv_id % 3) AS project_id, conv_id, CAST(turn AS INTEGER) AS source_index,
        ['webpack:///src/', '../lib/', '/abs/', 'C:\work\'][turn % 4 + 1] || role || '/m' || turn || CASE WHEN turn % 2 = 0 THEN '.ts?x=1' ELSE '.vue' END AS label,
        CASE WHEN (conv_id + turn) % 9 <> 0 THEN text END AS content FROM conversations""",
    "sightings": f"""SELECT project_id, sha256(CAST(conv_id % 40 AS VARCHAR)) AS artifact_sha256, sha256(CAST(conv_id AS VARCHAR)) AS map_sha256, source_index, CAST(conv_id AS VARCHAR) AS request_id, sha256(content) AS source_sha256, label AS sources_verbatim,
        ['producible', 'gone', 'producible'][conv_id % 3 + 1] AS producibility, {T0} + conv_id * 1000 + source_index AS recovered_at FROM map_entries""",
    "source_rows": "SELECT * FROM map_entries WHERE content IS NOT NULL AND conv_id % 4 <> 1 UNION ALL SELECT project_id, conv_id, source_index, label, 'orphan ' || content FROM map_entries WHERE content IS NOT NULL AND conv_id % 4 <> 1 AND conv_id % 5 = 0",
    "sources": f"""SELECT project_id, sha256(content) AS source_sha256, min({T0} + conv_id * 1000) AS first_seen_at, arg_max(strlen(content), conv_id * 100 + source_index) AS byte_len,
        arg_max(1 + length(content) - length(replace(content, chr(10), '')), conv_id * 100 + source_index) AS line_count FROM source_rows GROUP BY ALL""",
    "cache_log": "SELECT event_id AS id, epoch_us(ts) // 1000 AS ts, 'h' || (user_id % 20) || '-' || event_type AS sha256, event_type, user_id, value FROM events",
    "settings": "SELECT ['', 'p0', 'p1'][user_id % 3 + 1] AS project_id, 'key' || (user_id % 5) AS key, CAST(event_id AS VARCHAR) AS value, event_id AS seq FROM events",
    "audit": "SELECT 'p' || (user_id % 3) AS project_id, 'e' || (event_id % 4000) AS event_id, epoch_us(ts) // 1000 AS \"at\", event_type AS kind, CAST(user_id AS VARCHAR) AS subject, event_id AS seq FROM events",
    "scans": "SELECT 'p' || (o_custkey % 3) AS project_id, o_orderkey AS scan_id, ['running', 'suspended', 'completed', 'discarded', 'completed'][o_orderkey % 5 + 1] AS state, epoch_us(o_orderdate) // 1000 AS started_at, o_custkey % 7 AS epoch FROM orders",
}


def oracle(body: str) -> str:
    """The body after the views it names, directly or through others."""
    import re

    needed: set[str] = set()

    def need(sql: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                need(SQL[name])

    need(body)
    views = [f"{name} AS ({SQL[name]})" for name in SQL if name in needed]
    body = body.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{', '.join(views)}, {body[len(start):]}" if views else body
    return f"WITH {', '.join(views)} {body}" if views else body

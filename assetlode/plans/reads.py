"""Joins, counts, pages and top-k lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlode.functions import text
from assetlode.operators import reads, retention
from assetlode.plans.registry import query
from assetlode.sources import adapters as a

C = F.col
LATEST = "latest AS (SELECT project_id, sha256, arg_max(scan_state, (started_at, detector_set_hash)) AS scan_state FROM analyses GROUP BY ALL)"
STATED = LATEST + ", stated AS (SELECT t.*, l.scan_state, CASE WHEN l.scan_state IN ('partial', 'failed') THEN 'yes' ELSE 'no' END AS analysis_degraded FROM artifacts t LEFT JOIN latest l USING (project_id, sha256))"


def _stated(spark, d):
    return reads.with_state(a.artifacts(spark, d), a.analyses(spark, d))


@query(f"WITH {STATED} SELECT project_id, sha256, byte_len, last_seen_at, seen_count, scan_state, analysis_degraded FROM stated ORDER BY last_seen_at DESC, sha256 DESC LIMIT 100")
def newest_artifacts(spark, d):
    """The newest distinct assets with their latest analysis state."""
    return reads.page(_stated(spark, d), "last_seen_at", "sha256").select("project_id", "sha256", "byte_len", "last_seen_at", "seen_count", "scan_state", "analysis_degraded")


@query(f"WITH {LATEST} SELECT * FROM latest")
def latest_states(spark, d):
    return reads.latest_state(a.analyses(spark, d))


def _register_pages():
    for tbl, cols in (("artifacts", ("last_seen_at", "first_seen_at")), ("observations", ("observed_at", "status"))):
        tie = "sha256" if tbl == "artifacts" else "request_id"
        for key in cols:
            for down in (True, False):
                for at in (None, (200, "3") if key == "status" else (a.T0 + 9000, "8")):
                    cmp, word = ("<", "DESC") if down else (">", "ASC")
                    where = "" if at is None else f" WHERE {key} {cmp} {at[0]} OR ({key} = {at[0]} AND {tie} {cmp} '{at[1]}')"

                    def f(spark, d, tbl=tbl, key=key, tie=tie, down=down, at=at):
                        rows = a.artifacts(spark, d) if tbl == "artifacts" else a.observations(spark, d)
                        return reads.page(rows, key, tie, 50, at, down).select("project_id", key, tie)

                    f.__name__ = f"page_{tbl}_{key}_{word.lower()}_{'first' if at is None else 'next'}"
                    f.__doc__ = "A keyset page."
                    query(f"SELECT project_id, {key}, {tie} FROM {tbl}{where} ORDER BY {key} {word}, {tie} {word} LIMIT 50")(f)


_register_pages()


@query(f"WITH {STATED}, w AS (SELECT * FROM stated ORDER BY last_seen_at DESC, sha256 DESC LIMIT 500) SELECT project_id, sha256, last_seen_at, scan_state FROM w WHERE analysis_degraded = 'yes' ORDER BY last_seen_at DESC, sha256 DESC LIMIT 100")
def filtered_page(spark, d):
    """The filter looks at a bounded window only, so the page may be short."""
    return reads.filtered_page(_stated(spark, d), "last_seen_at", "sha256", C("analysis_degraded") == "yes").select("project_id", "sha256", "last_seen_at", "scan_state")


@query("WITH w AS (SELECT * FROM artifacts ORDER BY last_seen_at DESC, sha256 DESC LIMIT 500) SELECT count(*) AS scanned, min((last_seen_at, sha256))[1] AS last_key, min((last_seen_at, sha256))[2] AS last_tie FROM w")
def window_edge(spark, d):
    return reads.edge(reads.window(a.artifacts(spark, d), "last_seen_at", "sha256"), "last_seen_at", "sha256")


@query("SELECT project_id, sha256, last_seen_at FROM artifacts ORDER BY last_seen_at DESC, sha256 LIMIT 500")
def list_artifacts(spark, d):
    return a.artifacts(spark, d).orderBy(C("last_seen_at").desc(), "sha256").limit(500).select("project_id", "sha256", "last_seen_at")


@query("SELECT project_id, request_id, observed_at FROM observations ORDER BY observed_at DESC, request_id LIMIT 500")
def list_observations(spark, d):
    return a.observations(spark, d).orderBy(C("observed_at").desc(), "request_id").limit(500).select("project_id", "request_id", "observed_at")


@query("SELECT project_id, event_id, \"at\", kind, seq FROM audit ORDER BY \"at\" DESC, event_id DESC, seq DESC LIMIT 500")
def list_audit(spark, d):
    return a.audit(spark, d).orderBy(C("at").desc(), C("event_id").desc(), C("seq").desc()).limit(500).select("project_id", "event_id", "at", "kind", "seq")


@query("SELECT project_id, scan_id, state, started_at FROM scans WHERE project_id = 'p1' ORDER BY (state = 'suspended') DESC, started_at DESC, scan_id DESC LIMIT 200")
def list_scans(spark, d):
    """Suspended scans first, then the newest."""
    return a.scans(spark, d).where("project_id = 'p1'").orderBy((C("state") == "suspended").desc(), C("started_at").desc(), C("scan_id").desc()).limit(200).select("project_id", "scan_id", "state", "started_at")


@query("SELECT project_id, scan_id, state FROM scans WHERE project_id = 'p1' AND state IN ('running', 'suspended') ORDER BY (state = 'running') DESC, started_at DESC, scan_id DESC LIMIT 1")
def active_scan(spark, d):
    return a.scans(spark, d).where("project_id = 'p1' AND state IN ('running', 'suspended')").orderBy((C("state") == "running").desc(), C("started_at").desc(), C("scan_id").desc()).limit(1).select("project_id", "scan_id", "state")


@query("SELECT n.project_id, n.sha256, n.scan_state, t.byte_len FROM analyses n JOIN artifacts t USING (project_id, sha256)")
def analyses_with_artifacts(spark, d):
    return a.analyses(spark, d).join(a.artifacts(spark, d), ["project_id", "sha256"]).select("project_id", "sha256", "scan_state", "byte_len")


@query("SELECT s.map_sha256, s.source_index, s.sources_verbatim, o.byte_len, o.line_count FROM sightings s LEFT JOIN sources o USING (project_id, source_sha256)")
def sightings_with_sources(spark, d):
    """Sizes of recovered sources; null where the source is gone."""
    return a.sightings(spark, d).join(a.sources(spark, d), ["project_id", "source_sha256"], "left").select("map_sha256", "source_index", "sources_verbatim", "byte_len", "line_count")


@query("SELECT s.map_sha256, s.source_index, t.seen FROM sightings s LEFT JOIN (SELECT sha256(CAST(conv_id AS VARCHAR)) AS artifact_sha256, count(*) AS seen FROM conversations WHERE conv_id < 25 GROUP BY 1) t USING (artifact_sha256)")
def sightings_with_artifacts(spark, d):
    """Evicted artifacts leave nulls."""
    t = a.table(spark, d, "conversations").where("conv_id < 25").groupBy(F.sha2(C("conv_id").cast("string"), 256).alias("artifact_sha256")).agg(F.count("*").alias("seen"))
    return a.sightings(spark, d).join(t, "artifact_sha256", "left").select("map_sha256", "source_index", "seen")


@query("SELECT source_index, map_sha256, sources_verbatim FROM sightings WHERE project_id = 'p1' AND (source_index > 1 OR (source_index = 1 AND map_sha256 > '8')) ORDER BY source_index, map_sha256 LIMIT 100")
def page_sources(spark, d):
    return reads.page(a.sightings(spark, d).where("project_id = 'p1'"), "source_index", "map_sha256", 100, (1, "8"), False).select("source_index", "map_sha256", "sources_verbatim")


@query("SELECT source_index, map_sha256, sources_verbatim FROM sightings WHERE artifact_sha256 = sha256('7') ORDER BY source_index, map_sha256 LIMIT 2000")
def tree_rows(spark, d):
    return a.sightings(spark, d).where(C("artifact_sha256") == F.sha2(F.lit("7"), 256)).orderBy("source_index", "map_sha256").limit(2000).select("source_index", "map_sha256", "sources_verbatim")


@query("""WITH arts AS (SELECT DISTINCT project_id, artifact_sha256 AS sha256 FROM sightings UNION SELECT project_id, sha256 FROM artifacts), n AS (SELECT project_id, artifact_sha256 AS sha256, count(*) AS n FROM sightings GROUP BY ALL)
 SELECT x.project_id, x.sha256, coalesce(n.n, 0) AS n_sources FROM arts x LEFT JOIN n USING (project_id, sha256) WHERE n.n IS NOT NULL OR EXISTS (SELECT 1 FROM analyses y WHERE y.project_id = x.project_id AND y.sha256 = x.sha256 AND y.scan_state = 'done')""")
def recovered_counts(spark, d):
    s = a.sightings(spark, d)
    arts = a.artifacts(spark, d).select("project_id", "sha256").union(s.select("project_id", "artifact_sha256")).distinct()
    return reads.recovered_counts(arts, a.analyses(spark, d), s)


@query("SELECT c.request_id FROM admitted c WHERE EXISTS (SELECT 1 FROM analyses n WHERE n.project_id = c.project_id AND n.sha256 = c.sha256 AND n.scan_state = 'done')")
def skip_done(spark, d):
    """Requests whose asset is analysed already."""
    done = a.analyses(spark, d).where("scan_state = 'done'").select("project_id", "sha256").distinct()
    return a.admitted(spark, d).join(done, ["project_id", "sha256"], "left_semi").select("request_id")


@query("SELECT DISTINCT project_id, sha256 FROM analyses WHERE scan_state = 'done'")
def distinct_done(spark, d):
    return a.analyses(spark, d).where("scan_state = 'done'").select("project_id", "sha256").distinct()


@query("""WITH now AS (SELECT project_id, key, arg_max(value, seq) AS value FROM settings GROUP BY ALL), p AS (SELECT unnest(['p0', 'p1', 'p2']) AS project_id), k AS (SELECT unnest(['key0', 'key1', 'key2', 'key3', 'key4', 'key5']) AS key)
 SELECT p.project_id, k.key, coalesce(o.value, g.value, '50000') AS value, CASE WHEN o.value IS NOT NULL THEN 'project' WHEN g.value IS NOT NULL THEN 'global' ELSE 'default' END AS origin
 FROM p CROSS JOIN k LEFT JOIN now o ON o.project_id = p.project_id AND o.key = k.key LEFT JOIN now g ON g.project_id = '' AND g.key = k.key""")
def resolve_settings(spark, d):
    """A project's value, else the global one, else the default."""
    from assetlode.operators import state

    now = state.upsert(None, a.settings(spark, d), ("project_id", "key"), "seq", last=("value",))
    wanted = spark.range(18).select(F.concat(F.lit("p"), (C("id") % 3).cast("string")).alias("project_id"), F.concat(F.lit("key"), F.floor(C("id") / 3).cast("string")).alias("key"))
    everywhere = now.where("project_id = ''").select("key", C("value").alias("global"))
    j = wanted.join(now, ["project_id", "key"], "left").join(everywhere, "key", "left")
    origin = F.when(C("value").isNotNull(), "project").when(C("global").isNotNull(), "global").otherwise("default")
    return j.select("project_id", "key", F.coalesce("value", "global", F.lit("50000")).alias("value"), origin.alias("origin"))


@query("""SELECT 'artifacts' AS tbl, project_id, count(*) AS n FROM artifacts GROUP BY ALL UNION ALL SELECT 'observations', project_id, count(*) FROM observations GROUP BY ALL UNION ALL SELECT 'analyses', project_id, count(*) FROM analyses GROUP BY ALL
 UNION ALL SELECT 'audit', project_id, count(*) FROM audit GROUP BY ALL UNION ALL SELECT 'scans', project_id, count(*) FROM scans GROUP BY ALL UNION ALL SELECT 'sources', project_id, count(*) FROM sources GROUP BY ALL UNION ALL SELECT 'sightings', project_id, count(*) FROM sightings GROUP BY ALL""")
def table_counts(spark, d):
    out = None
    for name in ("artifacts", "observations", "analyses", "audit", "scans", "sources", "sightings"):
        part = getattr(a, name)(spark, d).groupBy("project_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "project_id", "n")
        out = part if out is None else out.union(part)
    return out


@query(f"WITH {STATED} SELECT count(*) AS n, count(*) FILTER (kind = 'js') AS n_js, count(*) FILTER (scan_state = 'done') AS n_done, count(*) FILTER (scan_state IS NULL) AS n_none, count(*) FILTER (analysis_degraded = 'yes') AS n_degraded FROM stated")
def filtered_counts(spark, d):
    return _stated(spark, d).agg(F.count("*").alias("n"), F.count_if(C("kind") == "js").alias("n_js"), F.count_if(C("scan_state") == "done").alias("n_done"), F.count_if(C("scan_state").isNull()).alias("n_none"), F.count_if(C("analysis_degraded") == "yes").alias("n_degraded"))


@query("SELECT content_type, count(*) AS n FROM observations GROUP BY 1")
def content_type_counts(spark, d):
    return a.observations(spark, d).groupBy("content_type").agg(F.count("*").alias("n"))


@query("SELECT artifact_sha256, map_sha256, count(*) AS n FROM sightings GROUP BY ALL")
def sightings_per_map(spark, d):
    return a.sightings(spark, d).groupBy("artifact_sha256", "map_sha256").agg(F.count("*").alias("n"))


@query(f"SELECT project_id, count(*) AS n, greatest(0, CAST(floor(({a.T0} + 86400000 * 3 - min(last_seen_at)) / 86400000) AS BIGINT)) AS oldest_days, count(*) > 100 AS over_cap FROM artifacts GROUP BY ALL")
def storage_footprint(spark, d):
    days = F.floor((F.lit(a.T0 + 86_400_000 * 3) - F.min("last_seen_at")) / 86_400_000)
    return a.artifacts(spark, d).groupBy("project_id").agg(F.count("*").alias("n"), F.greatest(F.lit(0), days).cast("long").alias("oldest_days"), (F.count("*") > 100).alias("over_cap"))


@query("SELECT count(DISTINCT sha256) AS n_assets, count(*) AS n_rows FROM observations")
def distinct_assets(spark, d):
    return a.observations(spark, d).agg(F.count_distinct("sha256").alias("n_assets"), F.count("*").alias("n_rows"))


@query("""SELECT project_id, category, count(*) AS n, arg_max(id, seq) AS newest FROM (SELECT project_id, 'artifacts' AS category, sha256 AS id, seq FROM admitted UNION ALL SELECT project_id, 'observations', request_id, seq FROM admitted UNION ALL SELECT project_id, 'analyses', sha256, seq FROM analysis_claims) GROUP BY ALL""")
def invalidations(spark, d):
    """What changed, by category: how many rows and which is the newest."""
    t = a.admitted(spark, d)
    rows = t.select("project_id", F.lit("artifacts").alias("category"), C("sha256").alias("id"), "seq").union(t.select("project_id", F.lit("observations"), "request_id", "seq")).union(a.analysis_claims(spark, d).select("project_id", F.lit("analyses"), "sha256", "seq"))
    return rows.groupBy("project_id", "category").agg(F.count("*").alias("n"), F.max_by("id", "seq").alias("newest"))


@query(f"WITH {STATED} SELECT project_id, count(*) AS total, count(*) FILTER (analysis_degraded = 'yes') AS degraded, CASE WHEN count(*) FILTER (analysis_degraded = 'yes') = 0 THEN NULL ELSE count(*) FILTER (analysis_degraded = 'yes') || ' of ' || count(*) || ' contributing analyses were cut short; counts are a floor' END AS statement FROM stated GROUP BY 1")
def floor_statement(spark, d):
    g = _stated(spark, d).groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(C("analysis_degraded") == "yes").alias("degraded"))
    return g.withColumn("statement", F.when(C("degraded") > 0, F.format_string("%d of %d contributing analyses were cut short; counts are a floor", "degraded", "total")))


@query(f"WITH {STATED} SELECT max(byte_len) AS max_bytes, max(seen_count) AS max_seen, count(*) FILTER (scan_state IS NOT NULL) AS analysed FROM stated")
def health(spark, d):
    return _stated(spark, d).agg(F.max("byte_len").alias("max_bytes"), F.max("seen_count").alias("max_seen"), F.count_if(C("scan_state").isNotNull()).alias("analysed"))


@query("SELECT (row_number() OVER (ORDER BY observed_at DESC, request_id DESC) - 1) // 200 AS chunk, request_id FROM observations")
def export_chunks(spark, d):
    """Which chunk of an export each row belongs to; ranks are dealt by ranges, not by one task."""
    from assetlode.operators.export import chunked

    return chunked(a.observations(spark, d), "observed_at", "request_id", 200).select("chunk", "request_id")

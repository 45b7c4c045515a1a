"""Retention: victims, orphans, budgets and whole sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlode.operators import retention
from assetlode.plans.registry import query
from assetlode.sources import adapters as a

C = F.col
KEPT = "kept AS (SELECT * FROM artifacts WHERE last_seen_at % 5 <> 0)"


def _kept(spark, d):
    return a.artifacts(spark, d).where("last_seen_at % 5 <> 0")


@query("SELECT project_id, sha256, last_seen_at FROM artifacts ORDER BY last_seen_at, sha256 LIMIT 1024")
def oldest_victims(spark, d):
    return a.artifacts(spark, d).orderBy("last_seen_at", "sha256").limit(1024).select("project_id", "sha256", "last_seen_at")


@query(f"SELECT project_id, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_seen_at DESC, sha256 DESC) AS r FROM artifacts) WHERE last_seen_at < {a.T0 + 9000} OR r > 60")
def age_and_cap_victims(spark, d):
    """Too old, or beyond the cap of the project."""
    return retention.victims(a.artifacts(spark, d), "last_seen_at", ("project_id", "sha256"), a.T0 + 9000, 60)


@query(f"WITH {KEPT} SELECT o.request_id FROM observations o WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.project_id = o.project_id AND k.sha256 = o.sha256)")
def orphan_observations(spark, d):
    on = [("project_id", "project_id"), ("sha256", "sha256")]
    return retention.orphans(a.observations(spark, d), _kept(spark, d), on).select("request_id")


@query(f"WITH {KEPT} SELECT n.project_id, n.sha256, n.detector_set_hash FROM analyses n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.project_id = n.project_id AND k.sha256 = n.sha256)")
def orphan_analyses(spark, d):
    on = [("project_id", "project_id"), ("sha256", "sha256")]
    return retention.orphans(a.analyses(spark, d), _kept(spark, d), on).select("project_id", "sha256", "detector_set_hash")


@query("WITH kept AS (SELECT DISTINCT project_id, artifact_sha256 FROM sightings WHERE CAST(request_id AS BIGINT) % 40 < 30) SELECT s.map_sha256, s.source_index FROM sightings s WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.project_id = s.project_id AND k.artifact_sha256 = s.artifact_sha256)")
def orphan_sightings(spark, d):
    s = a.sightings(spark, d)
    kept = s.where(C("request_id").cast("long") % 40 < 30)
    return retention.orphans(s, kept, [("project_id", "project_id"), ("artifact_sha256", "artifact_sha256")]).select("map_sha256", "source_index")


@query("SELECT o.project_id, o.source_sha256 FROM sources o WHERE NOT EXISTS (SELECT 1 FROM sightings s WHERE s.project_id = o.project_id AND s.source_sha256 = o.source_sha256)")
def unsighted_sources(spark, d):
    """Sources that nothing names any more; sightings without a source don't get in the way."""
    return retention.unsighted(a.sources(spark, d), a.sightings(spark, d)).select("project_id", "source_sha256")


@query("SELECT project_id, sha256, cost, spent FROM (SELECT project_id, sha256, cost, sum(cost) OVER (PARTITION BY project_id ORDER BY last_seen_at, sha256 ROWS UNBOUNDED PRECEDING) AS spent FROM (SELECT *, seen_count + 1 AS cost FROM artifacts)) WHERE spent <= 64")
def budgeted_prefix(spark, d):
    """Victims in order while the deletes of each and its children fit the budget."""
    rows = a.artifacts(spark, d).withColumn("cost", C("seen_count") + 1)
    return retention.within_budget(rows, "cost", ("last_seen_at", "sha256"), 64).select("project_id", "sha256", "cost", "spent")


@query("SELECT o.* FROM observations o WHERE NOT EXISTS (SELECT 1 FROM (SELECT project_id, sha256 FROM artifacts ORDER BY last_seen_at, sha256 LIMIT 40) v WHERE v.project_id = o.project_id AND v.sha256 = o.sha256)")
def cascade_delete(spark, d):
    """Children of the oldest assets go with them."""
    v = a.artifacts(spark, d).orderBy("last_seen_at", "sha256").limit(40)
    return a.observations(spark, d).join(v.select("project_id", "sha256"), ["project_id", "sha256"], "left_anti").select("project_id", "sha256", "request_id", "url", "status", "content_type", "observed_at")


@query("SELECT project_id, sha256, n_children, least(n_children, greatest(0, 40 - before)) AS children_deleted, greatest(0, 40 - before) >= n_children + 1 AS digest_deleted FROM (SELECT *, coalesce(sum(n_children + 1) OVER (PARTITION BY project_id ORDER BY last_seen_at, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT project_id, sha256, last_seen_at, seen_count AS n_children FROM artifacts))")
def cascade_budget(spark, d):
    """Children go first, as many as the budget has left; a digest goes only with all of its children."""
    rows = a.artifacts(spark, d).select("project_id", "sha256", "last_seen_at", C("seen_count").alias("n_children"))
    return retention.cascade(rows, ("last_seen_at", "sha256"), 40).drop("last_seen_at")


NOW, AGE, CAP, AUDIT_CAP = a.T0 + 86_400_000 + 3000, 1, 150, 1000
OLD = a.T0 + 3000
_ALL = """arts AS (SELECT project_id, sha256, last_seen_at FROM artifacts UNION ALL SELECT project_id, artifact_sha256, max(recovered_at) FROM sightings WHERE CAST(request_id AS BIGINT) % 40 < 30 GROUP BY ALL),
 au AS (SELECT project_id, event_id, arg_min("at", seq) AS "at" FROM audit GROUP BY ALL)"""
_SWEEP = f"""WITH {_ALL}, a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_seen_at DESC, sha256 DESC) AS r FROM arts) WHERE last_seen_at >= {OLD} AND r <= {CAP}),
 o1 AS (SELECT o.* FROM observations o WHERE EXISTS (SELECT 1 FROM a1 WHERE a1.project_id = o.project_id AND a1.sha256 = o.sha256)),
 o2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY observed_at DESC, sha256 DESC, request_id DESC) AS r FROM o1) WHERE observed_at >= {OLD} AND r <= {CAP}),
 n1 AS (SELECT n.* FROM analyses n WHERE EXISTS (SELECT 1 FROM a1 WHERE a1.project_id = n.project_id AND a1.sha256 = n.sha256)),
 n2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, sha256 DESC, detector_set_hash DESC) AS r FROM n1) WHERE started_at >= {OLD} AND r <= {CAP}),
 u2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "at" DESC, event_id DESC) AS r FROM au) WHERE r <= {AUDIT_CAP}),
 c1 AS (SELECT * FROM scans WHERE state = 'suspended' OR started_at >= {OLD}), c2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, scan_id DESC) AS r FROM c1) WHERE r <= {CAP}),
 s1 AS (SELECT s.* FROM sightings s WHERE EXISTS (SELECT 1 FROM a1 WHERE a1.project_id = s.project_id AND a1.sha256 = s.artifact_sha256)),
 s2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY recovered_at DESC, artifact_sha256 DESC, map_sha256 DESC, source_index DESC) AS r FROM s1) WHERE recovered_at >= {OLD} AND r <= {CAP}),
 q2 AS (SELECT q.* FROM sources q WHERE EXISTS (SELECT 1 FROM s2 WHERE s2.project_id = q.project_id AND s2.source_sha256 = q.source_sha256))
 SELECT 'artifacts' AS tbl, project_id, count(*) AS n FROM a1 GROUP BY ALL UNION ALL SELECT 'observations', project_id, count(*) FROM o2 GROUP BY ALL UNION ALL SELECT 'analyses', project_id, count(*) FROM n2 GROUP BY ALL UNION ALL SELECT 'audit', project_id, count(*) FROM u2 GROUP BY ALL
 UNION ALL SELECT 'scans', project_id, count(*) FROM c2 GROUP BY ALL UNION ALL SELECT 'source_sightings', project_id, count(*) FROM s2 GROUP BY ALL UNION ALL SELECT 'sources', project_id, count(*) FROM q2 GROUP BY ALL"""


def _tables(spark, d):
    """All tables that retention looks after; some sightings lack their artifact."""
    s = a.sightings(spark, d)
    more = s.where(C("request_id").cast("long") % 40 < 30).groupBy("project_id", C("artifact_sha256").alias("sha256")).agg(F.max("recovered_at").alias("last_seen_at"))
    audit = a.audit(spark, d).groupBy("project_id", "event_id").agg(F.min_by("at", "seq").alias("at"))
    return {
        "artifacts": a.artifacts(spark, d).select("project_id", "sha256", "last_seen_at").union(more), "observations": a.observations(spark, d), "analyses": a.analyses(spark, d),
        "audit": audit, "scans": a.scans(spark, d), "source_sightings": s, "sources": a.sources(spark, d),
    }


@query(_SWEEP)
def retention_sweep(spark, d):
    """Rows that each table keeps after a sweep."""
    out = retention.sweep(_tables(spark, d), NOW, AGE, CAP, AUDIT_CAP)
    found = None
    for name, t in out.items():
        part = t.groupBy("project_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "project_id", "n")
        found = part if found is None else found.union(part)
    return found


@query(f"""WITH {_ALL}, held AS (SELECT * FROM arts WHERE last_seen_at % 5 <> 0), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY last_seen_at DESC, sha256 DESC) AS r FROM held) WHERE last_seen_at < {OLD} OR r > {CAP}),
 kids AS (SELECT project_id, sha256, count(*) AS n FROM (SELECT project_id, sha256 FROM observations UNION ALL SELECT project_id, sha256 FROM analyses) GROUP BY ALL),
 o AS (SELECT o.*, l.sha256 IS NULL AS lone FROM observations o LEFT JOIN held l USING (project_id, sha256) WHERE (project_id, sha256) NOT IN (SELECT (project_id, sha256) FROM v)),
 n AS (SELECT n.*, l.sha256 IS NULL AS lone FROM analyses n LEFT JOIN held l USING (project_id, sha256) WHERE (project_id, sha256) NOT IN (SELECT (project_id, sha256) FROM v)),
 w AS (SELECT 1 AS stage, project_id, last_seen_at AS "at", sha256 AS key, coalesce(n, 0) + 1 AS cost FROM v LEFT JOIN kids USING (project_id, sha256)
 UNION ALL SELECT 2, project_id, observed_at, sha256 || '/' || request_id, 1 FROM o WHERE lone UNION ALL SELECT 3, project_id, started_at, sha256 || '/' || detector_set_hash, 1 FROM n WHERE lone
 UNION ALL SELECT 4, project_id, observed_at, sha256 || '/' || request_id, 1 FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY observed_at DESC, sha256 DESC, request_id DESC) AS r FROM o WHERE NOT lone) WHERE observed_at < {OLD} OR r > {CAP}
 UNION ALL SELECT 5, project_id, started_at, sha256 || '/' || detector_set_hash, 1 FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, sha256 DESC, detector_set_hash DESC) AS r FROM n WHERE NOT lone) WHERE started_at < {OLD} OR r > {CAP}
 UNION ALL SELECT 6, project_id, "at", event_id, 1 FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "at" DESC, event_id DESC) AS r FROM au) WHERE r > {AUDIT_CAP}),
 z AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY project_id ORDER BY stage, "at", key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM w)
 SELECT stage, project_id, key, cost, spent FROM z WHERE spent <= 512""")
def budgeted_sweep(spark, d):
    """The deletes of one pass, which spend one budget over all stages in their order."""
    t = _tables(spark, d)
    t["artifacts"] = t["artifacts"].where("last_seen_at % 5 <> 0")
    return retention.one_pass(t, NOW, AGE, CAP, AUDIT_CAP)


@query(f"""WITH {_ALL} SELECT DISTINCT project_id, 'artifacts_over_age' AS probe FROM arts WHERE last_seen_at < {OLD} UNION ALL SELECT project_id, 'artifacts_over_cap' FROM arts GROUP BY 1 HAVING count(*) > {CAP}
 UNION ALL SELECT DISTINCT project_id, 'observations_over_age' FROM observations WHERE observed_at < {OLD} UNION ALL SELECT project_id, 'observations_over_cap' FROM observations GROUP BY 1 HAVING count(*) > {CAP}
 UNION ALL SELECT DISTINCT project_id, 'analyses_over_age' FROM analyses WHERE started_at < {OLD} UNION ALL SELECT project_id, 'analyses_over_cap' FROM analyses GROUP BY 1 HAVING count(*) > {CAP}
 UNION ALL SELECT DISTINCT project_id, 'source_sightings_over_age' FROM sightings WHERE recovered_at < {OLD} UNION ALL SELECT project_id, 'source_sightings_over_cap' FROM sightings GROUP BY 1 HAVING count(*) > {CAP}
 UNION ALL SELECT DISTINCT project_id, 'scans_over_age' FROM scans WHERE state <> 'suspended' AND started_at < {OLD} UNION ALL SELECT project_id, 'scans_over_cap' FROM scans GROUP BY 1 HAVING count(*) > {CAP}
 UNION ALL SELECT project_id, 'audit_over_cap' FROM au GROUP BY 1 HAVING count(*) > {AUDIT_CAP}
 UNION ALL SELECT DISTINCT project_id, 'orphan_observations' FROM observations o WHERE NOT EXISTS (SELECT 1 FROM arts x WHERE x.project_id = o.project_id AND x.sha256 = o.sha256 AND x.last_seen_at % 5 <> 0)
 UNION ALL SELECT DISTINCT project_id, 'orphan_analyses' FROM analyses n WHERE NOT EXISTS (SELECT 1 FROM arts x WHERE x.project_id = n.project_id AND x.sha256 = n.sha256 AND x.last_seen_at % 5 <> 0)
 UNION ALL SELECT DISTINCT project_id, 'orphan_sightings' FROM sightings s WHERE NOT EXISTS (SELECT 1 FROM arts x WHERE x.project_id = s.project_id AND x.sha256 = s.artifact_sha256 AND x.last_seen_at % 5 <> 0)
 UNION ALL SELECT DISTINCT project_id, 'unsighted_sources' FROM sources q WHERE NOT EXISTS (SELECT 1 FROM sightings s WHERE s.project_id = q.project_id AND s.source_sha256 = q.source_sha256)""".replace("FROM arts WHERE last_seen_at <", "FROM arts WHERE last_seen_at % 5 <> 0 AND last_seen_at <").replace("FROM arts GROUP BY", "FROM arts WHERE last_seen_at % 5 <> 0 GROUP BY"))
def work_probes(spark, d):
    """Every bound that still binds and every kind of orphan that is still there, by project."""
    t = _tables(spark, d)
    t["artifacts"] = t["artifacts"].where("last_seen_at % 5 <> 0")
    return retention.probes(t, NOW, AGE, CAP, AUDIT_CAP)


@query(f"SELECT project_id, n, CAST(50000 AS BIGINT) AS cap, CAST(({NOW} - oldest) // 86400000 AS BIGINT) AS oldest_days, NOT coalesce(marked, false) AS observed_loss FROM (SELECT project_id, count(*) AS n, min(first_seen_at) AS oldest FROM sources GROUP BY 1) LEFT JOIN (SELECT project_id, true AS marked FROM settings WHERE key = 'key0' AND project_id <> 'p1' GROUP BY 1) USING (project_id)")
def footprint_with_loss(spark, d):
    """Rows, cap, age of the oldest row, and whether the store has lost its marker."""
    n = a.sources(spark, d).groupBy("project_id").agg(F.count("*").alias("n"), F.min("first_seen_at").alias("oldest"))
    marked = a.settings(spark, d).where("key = 'key0' AND project_id <> 'p1'").select("project_id", F.lit(True).alias("marked")).distinct()
    return n.join(marked, "project_id", "left").select("project_id", "n", F.lit(50_000).cast("long").alias("cap"), F.floor((F.lit(NOW) - C("oldest")) / 86_400_000).alias("oldest_days"), C("marked").isNull().alias("observed_loss"))


@query("SELECT r // 200 AS chunk, count(*) AS n, r // 200 = max(r // 200) OVER () AS last, CASE WHEN r // 200 = max(r // 200) OVER () THEN 'observations redacted csv ' || max(total) || ' rows' END AS detail FROM (SELECT row_number() OVER (ORDER BY observed_at DESC, request_id DESC) - 1 AS r, count(*) OVER () AS total FROM observations) GROUP BY 1")
def export_audit(spark, d):
    """Chunks of an export; the last one leaves the audit row."""
    from assetlode.operators import export

    return export.audited(export.chunked(a.observations(spark, d), "observed_at", "request_id", 200), "observations", "redacted", "csv")


@query(f"SELECT project_id, count(*) > 60 OR min(last_seen_at) < {a.T0 + 3000} AS work_remains FROM artifacts GROUP BY ALL")
def work_remains(spark, d):
    return a.artifacts(spark, d).groupBy("project_id").agg(((F.count("*") > 60) | (F.min("last_seen_at") < a.T0 + 3000)).alias("work_remains"))


@query("SELECT project_id, event_id, \"at\", seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY \"at\" DESC, event_id DESC, seq DESC) AS r FROM audit) WHERE r <= 500")
def audit_by_cap(spark, d):
    """The audit trail is trimmed by number only."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("project_id").orderBy(C("at").desc(), C("event_id").desc(), C("seq").desc()))
    return a.audit(spark, d).withColumn("r", r).where("r <= 500").select("project_id", "event_id", "at", "seq")

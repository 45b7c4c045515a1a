"""Upserts, claims, guarded updates and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlode.operators import state
from assetlode.plans.registry import query
from assetlode.sources import adapters as a
from assetlode.streaming import lifecycle

C = F.col


def _batch(spark, d, half):
    rows = a.admitted(spark, d).where(f"seq % 2 = {half}")
    return rows.select("project_id", "sha256", "seq", C("n_bytes").alias("byte_len"), F.lit("js").alias("kind"), C("observed_at").alias("at"))


@query("""SELECT project_id, sha256, arg_min(n_bytes, (seq % 2, seq)) AS byte_len, arg_min(observed_at, (seq % 2, seq)) AS first_seen_at, arg_max(observed_at, (seq % 2, seq)) AS last_seen_at, count(*) AS seen_count FROM admitted GROUP BY ALL""")
def upsert_artifacts(spark, d):
    """Two batches, the second on the first's snapshot: the last arrival wins, not the latest time."""
    one = state.upsert_artifacts(None, _batch(spark, d, 0))
    return state.upsert_artifacts(one, _batch(spark, d, 1)).drop("kind")


@query("SELECT project_id, sha256, request_id, any_value(url) AS url, any_value(status) AS status, max(observed_at) + 1 AS observed_at FROM observations GROUP BY 1, 2, 3")
def upsert_observations(spark, d):
    """A second sighting of the same request moves only its time."""
    o = a.observations(spark, d)
    again = o.withColumn("observed_at", C("observed_at") + 1).withColumn("url", F.lit("changed"))
    keys = ("project_id", "sha256", "request_id")
    one = state.upsert(None, o, keys, "observed_at", first=("url", "status"), last=("observed_at",))
    return state.upsert(one, again, keys, "observed_at", first=("url", "status"), last=("observed_at",))


@query("SELECT project_id, source_sha256, first_seen_at, byte_len, line_count FROM sources")
def upsert_sources(spark, d):
    return a.sources(spark, d).select("project_id", "source_sha256", "first_seen_at", "byte_len", "line_count")


@query("SELECT project_id, artifact_sha256, map_sha256, source_index, 'again' AS request_id, sources_verbatim, producibility, recovered_at FROM sightings")
def upsert_sightings(spark, d):
    """A map met again takes the new request but keeps its producibility and first recovery."""
    s = a.sightings(spark, d)
    keys = ("project_id", "artifact_sha256", "map_sha256", "source_index")
    rules = {"first": ("producibility", "recovered_at"), "last": ("request_id", "sources_verbatim")}
    one = state.upsert(None, s, keys, "recovered_at", **rules)
    again = s.withColumns({"request_id": F.lit("again"), "producibility": F.lit("changed"), "recovered_at": C("recovered_at") + 5})
    return state.upsert(one, again, keys, "recovered_at", **rules).select(*keys, "request_id", "sources_verbatim", "producibility", "recovered_at")


@query("SELECT project_id, key, arg_max(value, seq) AS value, max(seq) AS updated_at FROM settings GROUP BY ALL")
def upsert_settings(spark, d):
    s = a.settings(spark, d).withColumn("updated_at", C("seq"))
    return state.upsert(None, s, ("project_id", "key"), "seq", last=("value", "updated_at"))


@query("SELECT project_id, key, arg_max(value, seq) AS value FROM settings WHERE NOT (project_id = 'p1' AND key = 'key2') GROUP BY ALL")
def clear_setting(spark, d):
    s = state.upsert(None, a.settings(spark, d), ("project_id", "key"), "seq", last=("value",))
    return s.where(~((C("project_id") == "p1") & (C("key") == "key2")))


@query("SELECT project_id, sha256, detector_set_hash, scan_state, started_at FROM analyses")
def claim_analyses(spark, d):
    """The earliest claim of each piece of work owns it; later ones change nothing."""
    keys = ("project_id", "sha256", "detector_set_hash")
    c = a.analysis_claims(spark, d)
    one = state.claim(None, c, keys, ("started_at", "seq"))
    late = c.withColumn("started_at", C("started_at") + 1_000_000)
    return state.claim(one, late, keys, ("started_at", "seq")).select(*keys, "scan_state", "started_at")


@query("SELECT project_id, event_id, arg_min(\"at\", seq) AS \"at\", arg_min(kind, seq) AS kind, arg_min(subject, seq) AS subject FROM audit GROUP BY ALL")
def append_audit(spark, d):
    """Appending is idempotent by event id."""
    keys = ("project_id", "event_id")
    one = state.claim(None, a.audit(spark, d), keys, ("seq",))
    return state.claim(one, a.audit(spark, d).withColumn("kind", F.lit("again")), keys, ("seq",)).drop("seq")


@query("SELECT project_id, sha256, detector_set_hash, CASE WHEN scan_state = 'running' THEN 'done' ELSE scan_state END AS scan_state, CASE WHEN scan_state = 'running' THEN started_at + 250 ELSE finished_at END AS finished_at FROM analyses")
def finish_analyses(spark, d):
    keys = ("project_id", "sha256", "detector_set_hash")
    rows = a.analyses(spark, d)
    results = rows.where("scan_state = 'running'").select(*keys, F.lit("done").alias("scan_state"), (C("started_at") + 250).alias("finished_at"))
    return state.finish(rows, results, keys, ("scan_state", "finished_at")).select(*keys, "scan_state", "finished_at")


@query("SELECT project_id, sha256, detector_set_hash, CASE WHEN scan_state IN ('partial', 'failed') THEN 'pending' ELSE scan_state END AS scan_state, CASE WHEN scan_state IN ('partial', 'failed') THEN NULL ELSE finished_at END AS finished_at, coalesce(scan_state IN ('partial', 'failed'), false) AS retried FROM analyses")
def retry_analyses(spark, d):
    """Only partial and failed work is offered again, and then it is analysed again."""
    guard = C("scan_state").isin("partial", "failed")
    rows = a.analyses(spark, d).withColumn("retried", guard)
    return state.update_where(rows, C("retried"), scan_state=F.lit("pending"), finished_at=F.lit(None).cast("long")).select("project_id", "sha256", "detector_set_hash", "scan_state", "finished_at", "retried")


@query("SELECT map_sha256, source_index, CASE WHEN producibility = 'producible' AND source_index % 3 = 0 THEN 'changed' ELSE producibility END AS producibility FROM sightings")
def mark_producibility(spark, d):
    """A mark is only ever moved away from producible."""
    guard = (C("producibility") == "producible") & (C("source_index") % 3 == 0)
    return state.update_where(a.sightings(spark, d), guard, producibility=F.lit("changed")).select("map_sha256", "source_index", "producibility")


@query("SELECT o.* FROM observations o WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = o.request_id AND l.quality = 0)")
def delete_by_key(spark, d):
    victims = a.table(spark, d, "labels").where("quality = 0").select(C("doc_id").cast("string").alias("request_id"))
    return state.delete(a.observations(spark, d), victims, ("request_id",))


@query("SELECT project_id, scan_id, CASE WHEN state = 'running' THEN 'suspended' ELSE state END AS state, CASE WHEN state = 'running' THEN 'process_restarted' END AS suspend_reason FROM scans")
def startup_sweep(spark, d):
    """Scans that a restart left running are suspended."""
    s = a.scans(spark, d).withColumn("suspend_reason", F.lit(None).cast("string"))
    return state.update_where(s, C("state") == "running", state=F.lit("suspended"), suspend_reason=F.lit("process_restarted")).select("project_id", "scan_id", "state", "suspend_reason")


@query("SELECT project_id, scan_id, CASE WHEN state = 'running' AND epoch <> 3 THEN 'suspended' ELSE state END AS state, CASE WHEN state = 'running' AND epoch <> 3 THEN 'project_changed' END AS suspend_reason FROM scans")
def epoch_suspend(spark, d):
    """Running scans of another epoch than the session's are suspended."""
    s = a.scans(spark, d).withColumn("suspend_reason", F.lit(None).cast("string"))
    return state.update_where(s, (C("state") == "running") & (C("epoch") != 3), state=F.lit("suspended"), suspend_reason=F.lit("project_changed")).select("project_id", "scan_id", "state", "suspend_reason")


@query("""WITH RECURSIVE ev AS (SELECT user_id AS scan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, ['pause', 'resume', 'complete', 'discard', 'advance'][event_id % 5 + 1] AS event FROM events),
 fold AS (SELECT DISTINCT scan_id, CAST(0 AS BIGINT) AS n, 'running' AS state, CAST(0 AS BIGINT) AS applied FROM ev
 UNION ALL SELECT f.scan_id, e.n, CASE WHEN e.event = 'pause' AND f.state = 'running' THEN 'suspended' WHEN e.event = 'resume' AND f.state = 'suspended' THEN 'running' WHEN e.event = 'complete' AND f.state = 'running' THEN 'completed' WHEN e.event = 'discard' AND f.state IN ('running', 'suspended') THEN 'discarded' ELSE f.state END,
 f.applied + CASE WHEN (e.event IN ('pause', 'complete', 'advance') AND f.state = 'running') OR (e.event = 'resume' AND f.state = 'suspended') OR (e.event = 'discard' AND f.state IN ('running', 'suspended')) THEN 1 ELSE 0 END
 FROM fold f JOIN ev e ON e.scan_id = f.scan_id AND e.n = f.n + 1)
 SELECT scan_id, arg_max(state, n) AS state, max(applied) AS applied, max(n) AS seen FROM fold GROUP BY 1""")
def scan_lifecycle(spark, d):
    """The state of each scan after its events, each applied only where its guard holds."""
    e = a.table(spark, d, "events")
    names = F.array(*(F.lit(x) for x in ("pause", "resume", "complete", "discard", "advance")))
    return lifecycle.fold(e.select(C("user_id").alias("scan_id"), "ts", "event_id", F.element_at(names, (C("event_id") % 5 + 1).cast("int")).alias("event")), ("ts", "event_id"))

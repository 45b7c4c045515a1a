"""Filters, walks and the life of scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlode.functions import admission, clauses, text
from assetlode.operators import export, scans, state
from assetlode.plans.registry import query
from assetlode.sources import adapters as a
from assetlode.streaming import coalesce

C = F.col

#: Clauses of all kinds: strings with parentheses, escapes and open ends, bad order, comments, blanks and great length.
_CLAUSES = (
    'req.path.cont:"a" AND (req.ext.eq:".js")', 'req.path.cont:"(("', '(req.a OR req.b', 'req.a) AND (req.b', "   ", "", 'req.path.cont:"//"', "/* x", 'x:"open (', 'x:"a\\"(" AND (y)',
)


def _clauses(spark, d):
    picked = F.element_at(F.array(*map(F.lit, _CLAUSES)), (C("page_id") % len(_CLAUSES) + 1).cast("int"))
    long = F.concat(F.lit("req.x:"), F.repeat(F.lit("y"), 2043))
    return a.table(spark, d, "pages").select("page_id", F.when(C("page_id") % 23 == 7, long).otherwise(picked).alias("clause"))


_SQL_CLAUSES = "clauses AS (SELECT page_id, CASE WHEN page_id % 23 = 7 THEN 'req.x:' || repeat('y', 2043) ELSE [" + ", ".join("'" + c.replace("'", "''") + "'" for c in _CLAUSES) + "][page_id % 10 + 1] END AS clause FROM pages)"
_SQL_SIGNS = r"""signs AS (SELECT *, regexp_replace(regexp_replace(clause, '"(\\.|[^"\\])*("|\\?$)', '', 'g'), '[^()]', '', 'g') AS s FROM clauses),
 depths AS (SELECT *, list_transform(range(1, length(s) + 1), lambda i: length(replace(substr(s, 1, i), ')', '')) - length(replace(substr(s, 1, i), '(', ''))) AS ds FROM signs),
 verdicts AS (SELECT page_id, clause, CASE WHEN contains(clause, '//') OR contains(clause, '/*') OR contains(clause, '*/') THEN 'comment_construct' WHEN coalesce(list_min(ds), 0) < 0 OR coalesce(ds[-1], 0) <> 0 THEN 'unbalanced_parentheses'
 WHEN clause <> '' AND trim(clause) = '' THEN 'whitespace_only' WHEN length(clause) > 2048 THEN 'too_long' END AS refusal FROM depths)"""


@query(f"WITH {_SQL_CLAUSES}, {_SQL_SIGNS} SELECT page_id, refusal FROM verdicts")
def clause_verdicts(spark, d):
    """The first check that an operator's clause fails."""
    return _clauses(spark, d).select("page_id", clauses.clause_refusal(C("clause")).alias("refusal"))


@query(f"WITH {_SQL_CLAUSES}, {_SQL_SIGNS} SELECT page_id, '(' || '{clauses.KIND_CLAUSE}' || ')' || CASE WHEN page_id % 4 = 0 THEN '' ELSE ' AND (row.id.lt:' || page_id || ')' END || CASE WHEN clause <> '' AND refusal IS NULL THEN ' AND (' || clause || ')' ELSE '' END AS filter FROM verdicts")
def composed_filters(spark, d):
    """The kind, the position and a valid operator's clause."""
    last = F.when(C("page_id") % 4 == 0, "").otherwise(C("page_id").cast("string"))
    return _clauses(spark, d).select("page_id", clauses.composed(clauses.position_clause(last), C("clause")).alias("filter"))


@query("SELECT seq, request_id FROM captures c JOIN (SELECT lang AS project_id, CAST(max(doc_id) * 0.6 AS BIGINT) AS last FROM documents GROUP BY 1) p USING (project_id) WHERE seq < last AND status BETWEEN 200 AND 299 AND url ILIKE '%.js%'")
def below_position(spark, d):
    """Each project's history below its own position, under all terms of the filter."""
    c = a.captures(spark, d)
    last = c.groupBy("project_id").agg((F.max("seq") * 0.6).alias("x")).select("project_id", F.round("x").cast("long").alias("last"))
    return c.join(last, "project_id").where(clauses.predicate(C("seq"), C("last"), C("status").between(200, 299), C("url").ilike("%.js%"))).select("seq", "request_id")


@query("SELECT request_id, CASE WHEN seq % 3 = 0 THEN content_type WHEN seq % 3 = 1 THEN 'upper' END AS header FROM captures")
def picked_headers(spark, d):
    """The first value of a header under either of its two casings."""
    i = C("seq")
    none = F.array().cast("array<string>")
    headers = F.create_map(F.lit("content-type"), F.when(i % 3 == 0, F.array("content_type", F.lit("second"))).otherwise(none), F.lit("Content-Type"), F.when(i % 3 == 1, F.array(F.lit("upper"))).otherwise(none))
    return a.captures(spark, d).select("request_id", admission.header(F.map_filter(headers, lambda _, v: F.size(v) > 0), "content-type").alias("header"))


@query("""SELECT count(*) AS n, count(*) FILTER (reject_reason IS NULL) AS n_one, count(*) FILTER (status BETWEEN 200 AND 299 AND regexp_matches(lower(split_part(split_part(url, '#', 1), '?', 1)), '[.]m?js$')) AS n_other,
 count(*) FILTER ((reject_reason IS NULL) <> (status BETWEEN 200 AND 299 AND regexp_matches(lower(split_part(split_part(url, '#', 1), '?', 1)), '[.]m?js$'))) AS n_differ FROM judged""")
def evaluator_agreement(spark, d):
    """The verdicts of two evaluators, joined by request."""
    c = a.captures(spark, d)
    one = c.select("request_id", admission.reject_reason(C("status"), C("n_bytes"), C("content_type"), C("url")).isNull().alias("one"))
    path = F.lower(F.regexp_replace("url", "(?s)[?#].*$", ""))
    other = c.select("request_id", (C("status").between(200, 299) & path.rlike(r"\.m?js$")).alias("other"))
    return one.join(other, "request_id").agg(F.count("*").alias("n"), F.count_if("one").alias("n_one"), F.count_if("other").alias("n_other"), F.count_if(C("one") != C("other")).alias("n_differ"))


_WANTED = "wanted AS (SELECT 'p' || (c_custkey % 5) AS project_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -c_custkey END AS scan_id, CAST(c_custkey * 10 AS BIGINT) AS started_at, c_custkey AS seq FROM customer)"


@query(f"""WITH {_WANTED}, w AS (SELECT w.*, s.scan_id IS NULL AS fresh FROM wanted w LEFT JOIN scans s USING (project_id, scan_id)), r AS (SELECT DISTINCT project_id FROM scans WHERE state = 'running'), f AS (SELECT project_id, min(seq) AS first FROM w WHERE fresh GROUP BY 1)
 SELECT project_id, scan_id, CASE WHEN NOT fresh THEN 'exists' WHEN project_id IN (SELECT project_id FROM r) OR seq <> first THEN 'already_running' ELSE 'started' END AS outcome FROM w LEFT JOIN f USING (project_id)""")
def started_scans(spark, d):
    """Requests to start a scan: one that exists is left alone, and a project runs one at most."""
    i = C("c_custkey")
    wanted = a.table(spark, d, "customer").select(F.concat(F.lit("p"), (i % 5).cast("string")).alias("project_id"), F.when(i % 3 == 0, i).otherwise(-i).alias("scan_id"), (i * 10).cast("long").alias("started_at"), i.alias("seq"))
    return scans.start(a.scans(spark, d), wanted)[1].select("project_id", "scan_id", "outcome")


_EVICTED = "evicted AS (SELECT project_id, count(*) AS n FROM sources o WHERE NOT EXISTS (SELECT 1 FROM sightings s WHERE s.project_id = o.project_id AND s.source_sha256 = o.source_sha256) AND project_id <> 'p1' GROUP BY 1)"


def _suspended(spark, d):
    from assetlode.operators import retention

    evicted = retention.unsighted(a.sources(spark, d), a.sightings(spark, d)).where("project_id <> 'p1'").groupBy("project_id").agg(F.count("*").alias("n"))
    return scans.suspend_evicted(a.scans(spark, d).withColumn("suspend_reason", F.lit(None).cast("string")), evicted, F.lit(a.T0).cast("long"))


@query(f"WITH {_EVICTED} SELECT project_id, scan_id, CASE WHEN state = 'running' AND n IS NOT NULL THEN 'suspended' ELSE state END AS state, CASE WHEN state = 'running' AND n IS NOT NULL THEN 'retention_eviction' END AS suspend_reason FROM scans LEFT JOIN evicted USING (project_id)")
def retention_suspend(spark, d):
    """Running scans of projects that lost something to retention are suspended."""
    return _suspended(spark, d)[0].select("project_id", "scan_id", "state", "suspend_reason")


@query(f"WITH {_EVICTED} SELECT project_id, 'retention-' || scan_id AS event_id, CAST({a.T0} AS BIGINT) AS \"at\", 'scan_suspended_by_retention' AS kind, CAST(scan_id AS VARCHAR) AS subject, 'retention row cap evicted ' || n || ' artifacts; scan suspended at its position' AS detail FROM scans JOIN evicted USING (project_id) WHERE state = 'running'")
def retention_suspend_audit(spark, d):
    """Every such suspension leaves an audit row."""
    return _suspended(spark, d)[1]


_EPOCHS = "e AS (SELECT user_id, id, ts, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS epoch FROM cache_log)"


def _epochs(spark, d):
    """Users stand for sessions and signups for changes of the project."""
    return scans.epochs(a.cache_log(spark, d), ("user_id",), ("ts", "id"), C("event_type") == "signup")


@query(f"WITH {_EPOCHS} SELECT user_id, CAST(epoch AS BIGINT) AS epoch, count(*) FILTER (event_type = 'view') AS discarded, count(*) FILTER (event_type <> 'signup') AS seen FROM e GROUP BY ALL")
def project_epochs(spark, d):
    """What was queued (views) in each epoch of a session and goes when the next one begins."""
    return _epochs(spark, d).groupBy("user_id", "epoch").agg(F.count_if(C("event_type") == "view").alias("discarded"), F.count_if(C("event_type") != "signup").alias("seen"))


@query("SELECT user_id, id, NOT EXISTS (SELECT 1 FROM cache_log c WHERE c.user_id = w.user_id AND c.event_type = 'signup' AND c.ts BETWEEN w.ts AND w.ts + 3600000) AS written FROM cache_log w WHERE event_type = 'click'")
def fenced_writes(spark, d):
    """Work of an hour is written only if no project change of its session came between."""
    e = a.cache_log(spark, d)
    work = e.where("event_type = 'click'").select("user_id", "id", C("ts").alias("started_at"), (C("ts") + 3_600_000).alias("finished_at"))
    changes = e.where("event_type = 'signup'").select("user_id", C("ts").alias("at"))
    return scans.fenced(work, changes, ("user_id",)).select("user_id", "id", "written")


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'busy' WHEN event_id % 7 = 0 THEN 'no-scan' WHEN event_id % 5 = 0 THEN 'epoch-changed' WHEN user_id * 20 >= 1528 THEN 'held' WHEN event_id % 13 = 0 THEN 'failed' WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN 'completed' END AS stop, user_id * 20 >= 1528 AS held FROM events""")
def producer_stops(spark, d):
    """Why a walk stops, by the order of the reasons."""
    i, depth = C("event_id"), C("user_id") * 20
    stop = scans.stop_reason(busy=i % 11 == 0, running=i % 7 != 0, epoch_changed=i % 5 == 0, depth=depth, failed=i % 13 == 0, items=i % 3, more=i % 2 != 0)
    return a.table(spark, d, "events").select("event_id", stop.alias("stop"), scans.held(depth).alias("held"))


@query("""WITH s AS (SELECT user_id, id, ts, CAST(floor(value / 50) AS BIGINT) AS pages, event_type FROM cache_log), f AS (SELECT *, coalesce(CAST(pages AS VARCHAR), '-') || ',' || event_type AS f FROM s),
 m AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY user_id ORDER BY ts, pages, event_type) THEN ts END AS moved FROM f), l AS (SELECT *, max(moved) OVER (PARTITION BY user_id ORDER BY ts, pages, event_type ROWS UNBOUNDED PRECEDING) AS last_change FROM m)
 SELECT user_id, id, CASE WHEN event_type = 'purchase' THEN 'Finished' WHEN event_type = 'error' THEN 'Waiting for queue' WHEN coalesce(pages, 0) = 0 THEN 'Starting' WHEN ts + id % 3 * 20000 - last_change > 30000 THEN 'Not advancing' ELSE 'Scanning' END AS word FROM l""")
def scan_words(spark, d):
    """The word shown for a scan: a hold outranks a stall, which begins after half a minute without any counter moving."""
    s = a.cache_log(spark, d).select("user_id", "id", "ts", F.floor(C("value") / 50).cast("long").alias("pages"), "event_type")
    moved = scans.last_changes(s, ("user_id",), "ts", ("pages", "event_type"))
    state_ = F.when(C("event_type") == "purchase", "completed").otherwise("running")
    word = scans.status_word(state=state_, waiting=C("event_type") == "error", pages=F.coalesce("pages", F.lit(0)), last_change=C("last_change"), now=C("ts") + C("id") % 3 * 20_000)
    return moved.select("user_id", "id", word.alias("word"))


@query("""WITH w AS (SELECT doc_id, strlen(text) AS n_bytes, CAST(CASE WHEN strlen(text) = 0 THEN 0 ELSE greatest(1, ceil((strlen(text) - 64) / 448)) END AS BIGINT) AS n, 4 + doc_id % 9 AS ms FROM documents), v AS (SELECT *, least(n, CAST(ceil(60 / ms) AS BIGINT)) AS visited FROM w)
 SELECT doc_id, visited, CAST(CASE WHEN visited = 0 THEN 0 ELSE least(n_bytes, (visited - 1) * 448 + 512) END AS BIGINT) AS bytes_walked, visited < n AS partial, CAST(floor(visited / ceil(25 / ms)) AS BIGINT) AS yields FROM v""")
def deadline_walks(spark, d):
    """Walks over windows of 512 bytes that end, partial, at a deadline of 60 ms."""
    n_bytes = F.octet_length("text").cast("long")
    n = F.size(text.frames(C("text").cast("binary"), 512, 64)).cast("long")
    w = a.table(spark, d, "documents").select("doc_id", n_bytes.alias("n_bytes"), n.alias("n"), (4 + C("doc_id") % 9).alias("ms"))
    return w.select("doc_id", *(c.alias(k) for k, c in scans.walked(C("n"), C("ms"), 60, C("n_bytes"), 512, 64).items()))


@query("SELECT request_id, (row_number() OVER (ORDER BY seq DESC) - 1) // 20 AS page FROM captures WHERE status BETWEEN 200 AND 299")
def backfill_pages(spark, d):
    """The page of 20 that a walk over all history meets each request on; no task holds more than a range of ids."""
    rows = a.captures(spark, d).where("status BETWEEN 200 AND 299").select("request_id", "seq")
    return export.chunked(rows, "seq", "request_id", 20).select("request_id", C("chunk").alias("page"))


@query("SELECT project_id, request_id, seq FROM admitted a WHERE NOT EXISTS (SELECT 1 FROM analyses n WHERE n.project_id = a.project_id AND n.sha256 = a.sha256 AND n.scan_state = 'done')")
def work_to_do(spark, d):
    """Captures whose asset isn't analysed yet; partial and failed work is done again."""
    done = a.analyses(spark, d).where("scan_state = 'done'").select("project_id", "sha256").distinct()
    return a.admitted(spark, d).join(done, ["project_id", "sha256"], "left_anti").select("project_id", "request_id", "seq")


@query("SELECT event_type, sha256, max(ts) AS \"at\" FROM (SELECT *, dense_rank() OVER (PARTITION BY event_type ORDER BY first_id DESC) AS r FROM (SELECT *, min(id) OVER (PARTITION BY event_type, sha256, user_id) AS first_id FROM (SELECT event_type, sha256 || '-' || user_id AS sha256, user_id, id, ts FROM cache_log))) WHERE r <= 8 GROUP BY ALL")
def enqueue_clock(spark, d):
    """The arrival times that a clock for eight ids of each kind holds in the end: the latest stamps of the ids that came in last."""
    ids = a.cache_log(spark, d).withColumn("sha256", F.concat_ws("-", "sha256", C("user_id").cast("string"))).groupBy("event_type", "sha256").agg(F.min("id").alias("first_id"), F.max("ts").alias("at"))
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(C("first_id").desc()))
    return ids.withColumn("r", r).where("r <= 8").select("event_type", "sha256", "at")


@query("""WITH RECURSIVE t AS (SELECT event_type AS project_id, ts // 600000 AS "at", row_number() OVER (PARTITION BY event_type ORDER BY ts // 600000, id) AS k FROM cache_log),
 r AS (SELECT project_id, min("at") + 500 AS fire FROM t GROUP BY 1 UNION ALL SELECT r.project_id, (SELECT min(t."at") + 500 FROM t WHERE t.project_id = r.project_id AND t."at" >= r.fire) AS fire FROM r WHERE EXISTS (SELECT 1 FROM t WHERE t.project_id = r.project_id AND t."at" >= r.fire)),
 b AS (SELECT project_id, fire, coalesce(lag(fire) OVER (PARTITION BY project_id ORDER BY fire), -1) AS before FROM r)
 SELECT b.project_id, b.fire AS "at", count(*) AS n FROM b JOIN t ON t.project_id = b.project_id AND t."at" >= b.before AND t."at" < b.fire GROUP BY ALL""")
def coalesced_reactions(spark, d):
    """Reactions to bursts: half a second after the first event of each, twice a second at most."""
    return coalesce.batch(a.cache_log(spark, d).select(C("event_type").alias("project_id"), F.floor(C("ts") / 600_000).cast("long").alias("at")))


@query("SELECT project_id, event_id, count(*) AS n, arg_min(kind, seq) AS kind FROM audit WHERE event_id <> 'e0' GROUP BY ALL")
def migrated_audit(spark, d):
    """A table copied into its next version: rows without a key are refused, and the first of a key stays."""
    from assetlode.store import copied

    old = a.audit(spark, d)
    rows = copied(old.withColumn("event_id", F.when(C("event_id") != "e0", C("event_id")).otherwise("")), ("project_id", "event_id"), "seq")
    n = old.groupBy("project_id", "event_id").agg(F.count("*").alias("n"))
    return rows.join(n, ["project_id", "event_id"]).select("project_id", "event_id", "n", "kind")


@query("SELECT project_id, max(CASE WHEN key = 'key0' THEN value END) IS NULL AND project_id <> '' AS observed_loss, CASE WHEN max(CASE WHEN key = 'key0' THEN value END) IS NULL THEN 1 ELSE coalesce(CASE WHEN max(CASE WHEN key = 'key1' THEN CAST(value AS BIGINT) END) > 0 THEN max(CASE WHEN key = 'key1' THEN CAST(value AS BIGINT) END) + 1 END, 1) END AS boot_count FROM (SELECT project_id, key, arg_max(value, seq) AS value FROM settings WHERE NOT (project_id = 'p1' AND key = 'key0') GROUP BY ALL) GROUP BY 1")
def boot_markers(spark, d):
    """What a start finds in each store: its marker and how often it started, or that a known store has lost its marker."""
    s = state.upsert(None, a.settings(spark, d).where("NOT (project_id = 'p1' AND key = 'key0')"), ("project_id", "key"), "seq", last=("value",))
    of = lambda k: F.max(F.when(C("key") == k, C("value")))
    found = s.groupBy("project_id").agg(of("key0").alias("install"), of("key1").try_cast("long").alias("boots"))
    count = F.when(C("install").isNull(), 1).otherwise(F.when(C("boots") > 0, C("boots") + 1).otherwise(1))
    return found.select("project_id", (C("install").isNull() & (C("project_id") != "")).alias("observed_loss"), count.cast("long").alias("boot_count"))

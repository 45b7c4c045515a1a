"""Admission, source push-down and the history source."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlode.functions import admission, text
from assetlode.plans.registry import query
from assetlode.sources import adapters as a
from assetlode.schemas import REJECT_REASONS

C = F.col


def _judged(spark, d):
    c = a.captures(spark, d)
    return c.withColumn("reject_reason", admission.reject_reason(C("status"), C("n_bytes"), C("content_type"), C("url")))


@query("SELECT request_id, project_id, reject_reason, lower(trim(split_part(content_type, ';', 1))) AS media_type FROM judged")
def admission_verdicts(spark, d):
    return _judged(spark, d).select("request_id", "project_id", "reject_reason", admission.media_type(C("content_type")).alias("media_type"))


@query("""SELECT project_id, count(*) AS seen, count(*) FILTER (reject_reason IS NULL) AS admitted, count(*) FILTER (reject_reason = 'status') AS status, count(*) FILTER (reject_reason = 'revalidation') AS revalidation,
 count(*) FILTER (reject_reason = 'empty') AS "empty", count(*) FILTER (reject_reason = 'too_large') AS too_large, count(*) FILTER (reject_reason = 'not_scriptish') AS not_scriptish, count(*) FILTER (reject_reason = 'out_of_scope') AS out_of_scope FROM judged GROUP BY 1""")
def admission_counters(spark, d):
    """Counters of every reason, zeros included."""
    return _judged(spark, d).groupBy("project_id").agg(F.count("*").alias("seen"), F.count_if(C("reject_reason").isNull()).alias("admitted"), *(F.count_if(C("reject_reason") == r).alias(r) for r in REJECT_REASONS))


@query("SELECT request_id, CASE WHEN reject_reason IS NULL AND NOT (toxic = 0) THEN 'out_of_scope' ELSE reject_reason END AS reject_reason FROM judged JOIN labels ON seq = doc_id")
def admission_in_scope(spark, d):
    """Scope given by a table; a request that it rules out is out_of_scope if nothing else is wrong with it."""
    scope = a.table(spark, d, "labels").select(C("doc_id").alias("seq"), (C("toxic") == 0).alias("in_scope"))
    return a.captures(spark, d).join(scope, "seq").select("request_id", admission.reject_reason(C("status"), C("n_bytes"), C("content_type"), C("url"), C("in_scope")).alias("reject_reason"))


@query("""SELECT count(*) AS n, count(*) FILTER (sup) AS n_superset, count(*) FILTER (reject_reason IS NULL) AS n_admitted, count(*) FILTER (reject_reason IS NULL AND NOT sup) AS n_lost FROM (
 SELECT *, status BETWEEN 200 AND 299 AND (url ILIKE '%.js%' OR url ILIKE '%.mjs%' OR coalesce(content_type ILIKE '%javascript%' OR content_type ILIKE '%ecmascript%' OR content_type ILIKE '%jscript%' OR content_type ILIKE '%livescript%' OR content_type ILIKE '%text/js%', false)) AS sup FROM judged)""")
def pushdown_superset(spark, d):
    """What the source may filter by must lose nothing that admission takes."""
    j = _judged(spark, d).withColumn("sup", admission.superset(C("status"), C("content_type"), C("url")))
    return j.agg(F.count("*").alias("n"), F.count_if("sup").alias("n_superset"), F.count_if(C("reject_reason").isNull()).alias("n_admitted"), F.count_if(C("reject_reason").isNull() & ~C("sup")).alias("n_lost"))


@query("SELECT seq, request_id, url FROM captures WHERE seq < 700 AND status BETWEEN 200 AND 299 ORDER BY seq DESC LIMIT 20")
def history_page(spark, d):
    """A page of the history source below a position, newest first."""
    return a.captures(spark, d).where("seq < 700 AND status BETWEEN 200 AND 299").orderBy(C("seq").desc()).limit(20).select("seq", "request_id", "url")


@query("SELECT o.request_id, strlen(c.body) AS n_bytes, sha256(c.body) = o.sha256 AS same FROM observations o LEFT JOIN captures c USING (request_id)")
def reload_by_request(spark, d):
    """Re-reads the body of each observation and holds its digest against the recorded one."""
    c = a.captures(spark, d).select("request_id", "body")
    return a.observations(spark, d).join(c, "request_id", "left").select("request_id", F.octet_length("body").cast("long").alias("n_bytes"), (text.sha256(C("body")) == C("sha256")).alias("same"))


@query("SELECT c.request_id, CASE WHEN r.request_id IS NULL THEN 'missing' WHEN r.body IS NULL THEN 'no_response' WHEN r.body = '' THEN 'empty' WHEN strlen(r.body) > 4000 THEN 'too_large' WHEN strlen(r.body) <> c.n_bytes THEN 'length_mismatch' END AS outcome FROM admitted c LEFT JOIN (SELECT request_id, CASE WHEN seq % 19 = 0 THEN NULL ELSE body || CASE WHEN seq % 23 = 0 THEN 'x' ELSE '' END END AS body FROM captures WHERE seq % 31 <> 0) r USING (request_id)")
def reload_rechecks(spark, d):
    """The checks after a reload, in order."""
    i = C("seq")
    r = a.captures(spark, d).where("seq % 31 <> 0").select("request_id", F.when(i % 19 != 0, F.concat("body", F.when(i % 23 == 0, "x").otherwise(""))).alias("again"), F.lit(True).alias("found"))
    n = F.octet_length("again")
    return a.admitted(spark, d).join(r, "request_id", "left").select("request_id", F.when(C("found").isNull(), "missing").when(C("again").isNull(), "no_response").when(C("again") == "", "empty").when(n > 4000, "too_large").when(n != C("n_bytes"), "length_mismatch").alias("outcome"))


@query("SELECT project_id, sha256, count(*) AS n, min(seq) AS first_seq FROM admitted GROUP BY ALL HAVING count(*) > 1")
def repeated_assets(spark, d):
    """Assets met more than once: what de-duplication saves from analysis."""
    return a.admitted(spark, d).groupBy("project_id", "sha256").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where("n > 1")


@query("SELECT request_id, project_id FROM captures WHERE project_id = 'de'")
def project_scan(spark, d):
    return a.captures(spark, d).where("project_id = 'de'").select("request_id", "project_id")


@query("SELECT * FROM observations WHERE request_id = '105'")
def point_lookup(spark, d):
    return a.observations(spark, d).where("request_id = '105'")


@query("""SELECT project_id, request_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY seq DESC) AS r FROM admitted) WHERE r <= 16""")
def queue_after_overflow(spark, d):
    """What a bounded queue that drops its oldest entries holds of a burst: the last 16 of each project."""
    from pyspark.sql import Window

    return a.admitted(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("project_id").orderBy(C("seq").desc()))).where("r <= 16").select("project_id", "request_id", "seq")

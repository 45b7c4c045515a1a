"""Text functions over documents, pages and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlode.functions import python_text, text, urls
from assetlode.operators import export
from assetlode.plans.registry import query
from assetlode.schemas import LOG_SIGNALS
from assetlode.sources import adapters as a

C = F.col


@query("SELECT doc_id, sha256(text) AS sha256, 1 + length(text) - length(replace(text, chr(10), '')) AS line_count, strlen(text) AS n_bytes FROM documents")
def digests(spark, d):
    return a.table(spark, d, "documents").select("doc_id", text.sha256(C("text")).alias("sha256"), text.line_count(C("text")).alias("line_count"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, length(text) + CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_chars, CASE WHEN doc_id % 3 = 0 THEN chr(65533) || text || chr(65533) ELSE text END AS decoded FROM documents")
def lenient_decode(spark, d):
    """Bytes that no UTF-8 text has, before and after every third text."""
    bad = F.unhex(F.lit("FF"))
    raw = F.when(C("doc_id") % 3 == 0, F.concat(bad, C("text").cast("binary"), bad)).otherwise(C("text").cast("binary"))
    body = text.decode_utf8(raw)
    return a.table(spark, d, "documents").select("doc_id", F.length(body).cast("long").alias("n_chars"), body.alias("decoded"))


@query("SELECT page_id, regexp_replace(url, '(?s)[?#].*$', '<query-redacted>') AS shown FROM pages")
def export_urls(spark, d):
    return a.table(spark, d, "pages").select("page_id", urls.export_url(C("url")).alias("shown"))


@query(r"""WITH u AS (SELECT request_id, split_part(url, '#', 1) AS u FROM captures), h AS (SELECT request_id, split_part(u, '?', 1) AS head, CASE WHEN contains(u, '?') THEN substr(u, instr(u, '?') + 1) END AS q FROM u)
 SELECT request_id, regexp_replace(regexp_replace(head, '://[^/@]*@', '://<redacted>@'), ';([^=/;]*)=[^/;]+', ';\1=<redacted>', 'g') || coalesce('?' || list_aggregate(list_transform(string_split(q, '&'), lambda s: CASE WHEN s = '' THEN '' WHEN NOT contains(s, '=') OR regexp_matches(s, '^[^=]*=+$') THEN '<redacted>' ELSE split_part(s, '=', 1) || '=<redacted>' END), 'string_agg', '&'), '') AS url FROM h""")
def normalised_urls(spark, d):
    """Observed URLs without fragment, user information and values."""
    return a.captures(spark, d).select("request_id", urls.normalise(C("url")).alias("url"))


@query("SELECT DISTINCT sources_verbatim AS label, CASE WHEN starts_with(sources_verbatim, 'webpack:') THEN regexp_replace(sources_verbatim, '(?s)[?#].*$', '<query-redacted>') ELSE regexp_replace(sources_verbatim, '(?s)[?].*$', '<query-redacted>') END AS shown FROM sightings")
def export_labels(spark, d):
    return a.sightings(spark, d).select(C("sources_verbatim").alias("label"), urls.export_label(C("sources_verbatim")).alias("shown")).distinct()


@query(r"SELECT DISTINCT sources_verbatim AS label, CASE WHEN starts_with(sources_verbatim, 'webpack:') THEN 'protocol' WHEN regexp_matches(sources_verbatim, '^.:[/\\]') THEN 'windows-drive' WHEN starts_with(sources_verbatim, '/') THEN 'absolute-posix' ELSE 'relative' END AS shape FROM sightings")
def path_shapes(spark, d):
    return a.sightings(spark, d).select(C("sources_verbatim").alias("label"), text.path_shape(C("sources_verbatim")).alias("shape")).distinct()


@query(r"SELECT DISTINCT sources_verbatim AS label, array_to_string(list_filter(regexp_split_to_array(sources_verbatim, '[/\\]'), lambda s: s NOT IN ('', '.', '..')), '/') AS path, CASE WHEN starts_with(sources_verbatim, '../') THEN 1 ELSE 0 END AS climbs FROM sightings")
def resolved_paths(spark, d):
    r = text.resolved_path(C("label"))
    return a.sightings(spark, d).select(C("sources_verbatim").alias("label")).distinct().withColumn("r", r).select("label", F.array_join("r.segments", "/").alias("path"), C("r.climbs").alias("climbs"))


@query("SELECT doc_id, regexp_replace(text || chr(7) || chr(8238), '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g') AS clean FROM documents")
def stripped_controls(spark, d):
    return a.table(spark, d, "documents").select("doc_id", text.strip_controls(F.concat("text", F.lit("\x07‮"))).alias("clean"))


@query("SELECT page_id, replace(url, '=', chr(8238)) = url AS untouched, url AS plain FROM pages")
def stripped_bidi(spark, d):
    marked = F.replace(C("url"), F.lit("="), F.lit("‮"))
    back = F.replace(C("url"), F.lit("="), F.lit("=‮"))
    return a.table(spark, d, "pages").select("page_id", (marked == C("url")).alias("untouched"), text.strip_bidi(back).alias("plain"))


@query("""SELECT doc_id, '"' || doc_id || '","' || replace(CASE WHEN substr(c, 1, 1) IN ('=', '+', '-', '@') THEN '''' || c ELSE c END, '"', '""') || '"' || chr(13) || chr(10) AS line FROM (SELECT doc_id, regexp_replace(['=', '', '+', '@'][doc_id % 4 + 1] || text || '"q"', '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g') AS c FROM documents)""")
def csv_lines(spark, d):
    lead = F.element_at(F.array(*(F.lit(x) for x in ("=", "", "+", "@"))), (C("doc_id") % 4 + 1).cast("int"))
    cell = F.concat(lead, C("text"), F.lit('"q"'))
    return a.table(spark, d, "documents").select("doc_id", text.csv_row(C("doc_id"), cell).alias("line"))


@query("""SELECT request_id, '"' || project_id || '","' || sha256 || '","' || request_id || '","' || regexp_replace(url, '(?s)[?#].*$', '<query-redacted>') || '","' || status || '","' || coalesce(content_type, '') || '","' || observed_at || '"' || chr(13) || chr(10) AS line FROM observations""")
def export_csv(spark, d):
    o = a.observations(spark, d)
    return o.select("request_id", text.csv_row(*export.cells(o, "observations").values()).alias("line"))


@query("""SELECT request_id, '{"project_id":"' || project_id || '","sha256":"' || sha256 || '","request_id":"' || request_id || '","url":"' || regexp_replace(url, '(?s)[?#].*$', '<query-redacted>') || '","status":"' || status || '","content_type":"' || coalesce(content_type, '') || '","observed_at":"' || observed_at || '"}' AS line FROM observations""")
def export_json(spark, d):
    o = a.observations(spark, d)
    return o.select("request_id", F.to_json(F.struct(*(c.alias(n) for n, c in export.cells(o, "observations").items()))).alias("line"))


@query("SELECT doc_id, substr(text, 1, 4096) AS label FROM documents WHERE length(text) > 4000")
def capped_labels(spark, d):
    return a.table(spark, d, "documents").where(F.length("text") > 4000).select("doc_id", text.label(C("text")).alias("label"))


@query("SELECT source_sha256, sources_verbatim, substr(source_sha256, 1, 16) || CASE WHEN sources_verbatim LIKE '%.vue' THEN '.vue' ELSE '.txt' END AS name FROM sightings WHERE source_sha256 IS NOT NULL")
def download_names(spark, d):
    return a.sightings(spark, d).where("source_sha256 IS NOT NULL").select("source_sha256", "sources_verbatim", text.download_name(C("source_sha256"), C("sources_verbatim")).alias("name"))


@query("SELECT event_id, 'inventory-artifacts-redacted-' || strftime(date_trunc('second', ts), '%Y%m%dT%H%M%SZ') || '.csv' AS name, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS shown FROM events")
def export_names(spark, d):
    ms = F.unix_millis(C("ts").cast("timestamp"))
    return a.table(spark, d, "events").select("event_id", text.export_name(F.lit("artifacts"), F.lit("redacted"), F.lit("csv"), ms).alias("name"), text.utc_seconds(ms).alias("shown"))


@query("SELECT doc_id, format('{:,}', n_chars) || CASE WHEN n_chars = 1 THEN ' character' ELSE ' characters' END AS shown FROM documents")
def counted_words(spark, d):
    return a.table(spark, d, "documents").select("doc_id", text.counted(C("n_chars"), "character").alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 10 <> 5 THEN CAST(sign(doc_id % 10 - 5) AS INTEGER) WHEN doc_id % 4 = 3 THEN NULL WHEN doc_id % 7 <> 2 THEN CAST(sign(doc_id % 7 - 2) AS INTEGER) ELSE 0 END AS ordering FROM documents")
def version_orders(spark, d):
    i = C("doc_id")
    v = F.concat((i % 10).cast("string"), F.lit("."), F.when(i % 4 == 3, "x").otherwise((i % 7).cast("string")), F.lit("-beta"))
    return a.table(spark, d, "documents").select("doc_id", text.version_order(v, F.lit("5.2.0")).alias("ordering"))


@query("SELECT doc_id, replace(replace(text, ' ', chr(9)) || chr(9), chr(9), '  ') AS shown FROM documents")
def expanded_tabs(spark, d):
    return a.table(spark, d, "documents").select("doc_id", F.replace(F.concat(F.replace("text", F.lit(" "), F.lit("\t")), F.lit("\t")), F.lit("\t"), F.lit("  ")).alias("shown"))


@query("""SELECT conv_id, bool_and(coalesce(lo >= before, lo >= 0) AND hi > lo) AS valid FROM (SELECT conv_id, turn * 10 AS lo, turn * 10 + length(text) % 12 AS hi, lag(turn * 10 + length(text) % 12) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY 1""")
def highlight_ranges(spark, d):
    """Ranges are in order, apart from each other and not empty."""
    from pyspark.sql import Window

    lo, hi = C("turn") * 10, C("turn") * 10 + F.length("text") % 12
    r = a.table(spark, d, "conversations").select("conv_id", lo.alias("lo"), hi.alias("hi"), F.lag(hi).over(Window.partitionBy("conv_id").orderBy("turn")).alias("before"))
    return r.groupBy("conv_id").agg(F.bool_and(F.coalesce(C("lo") >= C("before"), C("lo") >= 0) & (C("hi") > C("lo"))).alias("valid"))


@query("""SELECT doc_id, CAST(o AS INTEGER) AS "offset", md5(unhex(substr(body, CAST(o AS INTEGER) * 2 + 1, 1024))) AS frame FROM (SELECT doc_id, hex(encode(text)) AS body, unnest(range(0, greatest(1, CAST(ceil((strlen(text) - 64) / 448) AS BIGINT)) * 448, 448)) AS o FROM documents WHERE text <> '')""")
def overlapping_frames(spark, d):
    """Windows of 512 bytes that share 64 with the next one."""
    f = a.table(spark, d, "documents").select("doc_id", F.explode(text.frames(C("text").cast("binary"), 512, 64)).alias("f"))
    return f.select("doc_id", C("f.offset").alias("offset"), F.md5("f.frame").alias("frame"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT 'timeout' AS signal, count(*) AS n FROM l WHERE regexp_matches(line, 'timed?.?out|timeout') UNION ALL SELECT 'interrupt', count(*) FROM l WHERE regexp_matches(line, 'interrupt') UNION ALL SELECT 'regexp_error', count(*) FROM l WHERE regexp_matches(line, 'RegExp|regex.*(too|limit|abort)')
 UNION ALL SELECT 'stack_overflow', count(*) FROM l WHERE regexp_matches(line, 'stack overflow|Maximum call stack') UNION ALL SELECT 'abort_assertion', count(*) FROM l WHERE regexp_matches(line, 'ref_count|gc_decref|Assertion failed|panicked|SIGABRT') UNION ALL SELECT 'out_of_memory', count(*) FROM l WHERE regexp_matches(line, 'out of memory|OutOfMemory|OOM')""")
def log_signals(spark, d):
    lines = a.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    counts = lines.agg(*(F.count_if(C("line").rlike(p)).alias(n) for n, p in LOG_SIGNALS.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), C(n).alias("n")) for n in LOG_SIGNALS))).alias("s")).select("s.signal", "s.n")


@query(r"""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'cannot open ''<path-redacted> at <url-redacted> (<path-redacted>) via cdn.example.org:443' WHEN 1 THEN 'file=''<path-redacted>'' for ' || page_id
 WHEN 2 THEN 'host <url-redacted>, 1/2 done' WHEN 3 THEN 'path="<path-redacted>" of ' || page_id || ' and /single' ELSE '[<path-redacted>] refused by ' || chr(39) || '<url-redacted>' || chr(39) END AS message FROM pages""")
def redacted_errors(spark, d):
    """Error messages without URLs, paths and hosts (a quote-aware tokenizer, so a pandas UDF)."""
    i, page = C("page_id") % 5, C("page_id").cast("string")
    bare = F.concat(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/x"))
    m = (
        F.when(i == 0, F.concat(F.lit("cannot open '/srv/"), C("url"), F.lit("' at "), C("url"), F.lit(" (C:\\x\\y) via cdn.example.org:443")))
        .when(i == 1, F.concat(F.lit("file='/var/my data/x.js' for "), page)).when(i == 2, F.concat(F.lit("host "), bare, F.lit(", 1/2 done")))
        .when(i == 3, F.concat(F.lit('path="\\\\srv\\share" of '), page, F.lit(" and /single"))).otherwise("[/etc/hosts] refused by 'localhost:80/x'")
    )
    return a.table(spark, d, "pages").select("page_id", python_text.redact_error(m).alias("message"))


@query("SELECT doc_id, left_grapheme(text, 256) AS text, least(256, length_grapheme(text)) AS shown, length_grapheme(text) AS total FROM documents")
def capped_graphemes(spark, d):
    return a.table(spark, d, "documents").select("doc_id", python_text.capped_text(C("text"), 256).alias("c")).select("doc_id", "c.text", "c.shown", "c.total")


_SHOWN = "text"
for _c, _s in text.ESCAPES.items():
    _SHOWN = f"replace({_SHOWN}, chr({ord(_c)}), '{_s}')"


@query(f"SELECT doc_id, {_SHOWN} AS shown FROM documents")
def escaped_evidence(spark, d):
    return a.table(spark, d, "documents").select("doc_id", text.evidence(C("text")).alias("shown"))

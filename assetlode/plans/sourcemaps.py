"""Inline source maps: announced, decoded, exploded and counted."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assetlode.functions import python_text, sourcemaps, text
from assetlode.plans.registry import query
from assetlode.schemas import MAP_ROW_BUDGET
from assetlode.sources import adapters as a

C = F.col


def bodies(spark, d):
    """One script for each conversation, with its map inline: flat, in sections, with repeated keys, or one that is refused."""
    m = a.map_entries(spark, d).groupBy("project_id", "conv_id").agg(F.array_sort(F.collect_list(F.struct("source_index", "label", "content"))).alias("e"))
    written = {"ignoreNullFields": "false"}
    labels, contents = (lambda e: F.transform(e, lambda x: x["label"])), (lambda e: F.transform(e, lambda x: x["content"]))
    flat = lambda e: F.to_json(F.struct(F.lit(3).alias("version"), labels(e).alias("sources"), contents(e).alias("sourcesContent"), F.lit("AAAA;AACA").alias("mappings")), written)
    half = F.floor(F.size("e") / 2).cast("int")
    first, rest = F.slice("e", F.lit(1), half), F.slice(C("e"), half + 1, F.size("e"))
    sections = F.concat(F.lit('{"version":3,"sections":[{"offset":{"line":0,"column":0},"map":'), flat(first), F.lit('},{"map":null},{"map":'), flat(rest), F.lit("}]}"))
    kind = C("conv_id") % 14
    doc = (
        F.when(kind.isin(2, 9), sections).when(kind == 3, F.concat(F.lit('{"sections":[{"map":{"sections":[]}}]}'), F.lit("")))
        .when(kind == 5, F.repeat(F.lit("["), 3000)).when(kind == 12, F.lit("[1]")).when(kind == 13, F.lit('{"sources":'))
        .when(kind == 10, F.concat(F.lit('{"sources":["old"],'), F.substring(flat(C("e")), F.lit(2), F.length(flat(C("e")))))).otherwise(flat(C("e")))
    )
    url = F.concat(F.when(C("conv_id") % 7 == 0, "app.js.map").when(C("conv_id") % 7 == 1, "data:application/json;base64,not base64").otherwise(F.concat(F.lit("data:application/json;base64,"), F.base64(doc.cast("binary")))))
    return m.select("project_id", "conv_id", F.concat(F.lit("let a;\n//# sourceMappingURL=old\n//@ sourceMappingURL="), F.regexp_replace(url, "[\r\n]", ""), F.lit("  \n/* end */")).alias("body"))


def _once(df, **columns):
    """Columns that are worked out once, however often they are used: a generated row is no expression that could be copied."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once")
    return df.select("*", made).select(*df.columns, *(C(f"_once.{n}").alias(n) for n in columns))


def parsed(spark, d):
    sourcemaps.allow_duplicate_keys(spark)
    b = _once(bodies(spark, d), payload=sourcemaps.inline_payload(sourcemaps.announcement(C("body")))).drop("body")
    b = b.withColumn("refusal", sourcemaps.payload_refusal(C("payload")))
    b = _once(b, json=F.when(C("payload").isNotNull() & C("refusal").isNull(), sourcemaps.without_xssi(sourcemaps.decoded(C("payload"))))).withColumn("inline", C("payload").isNotNull()).drop("payload")
    b = _once(b, map=F.try_parse_json("json"))
    refusal = F.coalesce("refusal", F.when(C("json").isNotNull(), F.coalesce(sourcemaps.parse_refusal(C("json"), C("map")), sourcemaps.kind_of(C("map")))))
    return _once(b, refused=refusal).drop("refusal", "json").withColumnRenamed("refused", "refusal")


def _read(spark, d):
    return parsed(spark, d).where("inline AND refusal IS NULL")


GOOD = "conv_id % 7 > 1 AND conv_id % 14 NOT IN (3, 5, 12, 13)"


@query("SELECT conv_id, conv_id % 7 <> 0 AS inline, CASE WHEN conv_id % 7 = 1 THEN 'malformed_base64' WHEN conv_id % 14 = 3 THEN 'nested_sections' WHEN conv_id % 14 = 5 THEN 'too_deep' WHEN conv_id % 14 = 12 THEN 'not_a_map' WHEN conv_id % 14 = 13 THEN 'malformed_json' END AS refusal FROM (SELECT DISTINCT conv_id FROM conversations)")
def map_verdicts(spark, d):
    """Which scripts announce an inline map, and why one isn't read."""
    return parsed(spark, d).select("conv_id", "inline", "refusal")


@query(f"SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY source_index) - 1 AS INTEGER) AS at, label, CASE WHEN content = '' OR conv_id % 4 = 1 THEN NULL ELSE sha256(content) END AS source_sha256, CASE WHEN content IS NULL OR content = '' THEN 'empty' WHEN conv_id % 4 = 1 THEN 'depth_exceeded' END AS skipped FROM map_entries WHERE {GOOD}")
def recovered_sources(spark, d):
    """Labels and contents by position, over sections too; content that isn't text is skipped, and so is what was recovered from a recovered script."""
    e = _read(spark, d).select("conv_id", F.posexplode(sourcemaps.entries(C("map"))).alias("at", "e"))
    skipped = sourcemaps.derived_refusal(C("e.content"), F.when(C("conv_id") % 4 == 1, 1).otherwise(0))
    return e.select("conv_id", "at", C("e.label").alias("label"), F.when(skipped.isNull(), text.sha256(C("e.content"))).alias("source_sha256"), skipped.alias("skipped"))


@query(f"SELECT conv_id, sha256('{{\"mappings\":\"AAAA;AACA\",\"sources\":' || to_json(list(label ORDER BY source_index)) || ',\"sourcesContent\":' || to_json(list(content ORDER BY source_index)) || ',\"version\":3}}') AS map_sha256 FROM map_entries WHERE {GOOD} AND conv_id % 14 NOT IN (2, 9) GROUP BY 1")
def map_digests(spark, d):
    """The digest of each flat map, however it was written; of repeated keys the last counts."""
    return _read(spark, d).where("conv_id % 14 NOT IN (2, 9)").select("conv_id", sourcemaps.map_digest(C("map")).alias("map_sha256"))


@query(f"SELECT project_id, sha256(content) AS source_sha256, any_value(strlen(content)) AS byte_len, any_value(1 + length(content) - length(replace(content, chr(10), ''))) AS line_count, count(*) AS n_sightings FROM map_entries WHERE {GOOD} AND content <> '' GROUP BY ALL")
def reconstructed(spark, d):
    """From script bodies to the sources and sightings that are stored: announced, decoded, parsed, within the budget, admitted, upserted."""
    from assetlode.operators import state

    e = _read(spark, d).where(F.size(sourcemaps.entries(C("map"))) * 2 <= MAP_ROW_BUDGET).select("project_id", "conv_id", F.posexplode(sourcemaps.entries(C("map"))).alias("source_index", "e"))
    e = e.where(sourcemaps.derived_refusal(C("e.content"), F.lit(0)).isNull())
    content = C("e.content")
    rows = e.select("project_id", "conv_id", "source_index", text.sha256(content).alias("source_sha256"), F.octet_length(content).cast("long").alias("byte_len"), text.line_count(content).alias("line_count"))
    sources = state.upsert(None, rows, ("project_id", "source_sha256"), "conv_id", last=("byte_len", "line_count"))
    sightings = state.upsert(None, rows, ("project_id", "conv_id", "source_index"), "conv_id", last=("source_sha256",))
    n = sightings.groupBy("project_id", "source_sha256").agg(F.count("*").alias("n_sightings"))
    return sources.join(n, ["project_id", "source_sha256"])


@query(f"SELECT conv_id, count(*) AS declared, count(*) FILTER (content IS NOT NULL AND content <> '') AS recovered, count(*) * 2 > 2048 AS over_budget FROM map_entries WHERE {GOOD} GROUP BY 1")
def map_budget(spark, d):
    e = _once(_read(spark, d), e=sourcemaps.entries(C("map")))
    n = F.size("e")
    return e.select("conv_id", n.cast("long").alias("declared"), F.size(F.filter("e", lambda x: x["content"].isNotNull() & (x["content"] != ""))).cast("long").alias("recovered"), (n * 2 > 2048).alias("over_budget"))


@query("""WITH r AS (SELECT project_id, artifact_sha256, count(*) AS have FROM sightings WHERE CAST(request_id AS BIGINT) % 3 = 0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY project_id, artifact_sha256 ORDER BY map_sha256, source_index) AS k FROM sightings WHERE CAST(request_id AS BIGINT) % 3 <> 0)
 SELECT project_id, artifact_sha256, map_sha256, source_index FROM n LEFT JOIN r USING (project_id, artifact_sha256) WHERE k <= greatest(0, 16 - coalesce(have, 0))""")
def second_budget(spark, d):
    """New rows of an artifact that fit beside those recorded for it."""
    from assetlode.operators.ranks import running

    s = a.sightings(spark, d)
    old, keys = C("request_id").cast("long") % 3 == 0, ["project_id", "artifact_sha256"]
    have = s.where(old).groupBy(*keys).agg(F.count("*").alias("have"))
    new = running(s.where(~old), keys, [C("map_sha256"), C("source_index")], name="k").join(have, keys, "left")
    return new.where(C("k") <= sourcemaps.room(C("have"), 16)).select(*keys, "map_sha256", "source_index")


@query("WITH nodes AS (SELECT map_sha256, sources_verbatim AS label, count(*) AS n FROM sightings GROUP BY ALL) SELECT map_sha256, label, n > 1 AS duplicate FROM nodes")
def duplicate_labels(spark, d):
    n = F.count("*").over(Window.partitionBy("map_sha256", "sources_verbatim"))
    return a.sightings(spark, d).select("map_sha256", C("sources_verbatim").alias("label"), (n > 1).alias("duplicate")).distinct()


@query(r"""WITH s AS (SELECT map_sha256, source_index, list_filter(regexp_split_to_array(sources_verbatim, '[/\\]'), lambda x: x NOT IN ('', '.', '..')) AS p FROM sightings), n AS (SELECT map_sha256, source_index, unnest(range(1, len(p) + 1)) AS depth, p FROM s)
 SELECT map_sha256, CAST(depth AS INTEGER) AS depth, array_to_string(p[1:depth], '/') AS path, min(source_index) AS first_index, count(*) AS n_leaves, bool_or(depth < len(p)) AS expandable FROM n GROUP BY ALL""")
def source_tree(spark, d):
    """Every node of the source tree, by the first source below it."""
    segments = text.resolved_path(C("sources_verbatim"))["segments"]
    s = a.sightings(spark, d).select("map_sha256", "source_index", segments.alias("p"))
    n = s.select("map_sha256", "source_index", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    path = F.array_join(F.slice(C("p"), F.lit(1), C("depth")), "/")
    return n.groupBy("map_sha256", "depth", path.alias("path")).agg(F.min("source_index").alias("first_index"), F.count("*").alias("n_leaves"), F.bool_or(C("depth") < F.size("p")).alias("expandable"))


@query("""WITH again AS (SELECT conv_id, source_index, CASE WHEN source_index % 4 = 3 THEN content || '!' ELSE content END AS content FROM map_entries WHERE conv_id % 6 <> 0 AND source_index % 7 <> 6), met AS (SELECT DISTINCT conv_id FROM map_entries WHERE conv_id % 6 <> 0)
 SELECT s.map_sha256, s.source_index, CASE WHEN m.conv_id IS NULL THEN 'unavailable' WHEN r.content IS NULL OR r.content = '' OR s.source_sha256 IS NULL THEN 'gone' WHEN sha256(r.content) <> s.source_sha256 THEN 'changed' ELSE 'content' END AS outcome,
 CASE WHEN m.conv_id IS NOT NULL AND r.content <> '' AND sha256(r.content) = s.source_sha256 THEN strlen(r.content) END AS n_bytes
 FROM sightings s LEFT JOIN met m ON CAST(m.conv_id AS VARCHAR) = s.request_id LEFT JOIN again r ON CAST(r.conv_id AS VARCHAR) = s.request_id AND r.source_index = s.source_index""")
def derive_outcomes(spark, d):
    """What a request for a source is answered with: the map is met again, the source read anew and its digest compared; a difference fails closed.

    Some maps can't be met again, some sources are no longer in them, and some have changed.
    """
    m = a.map_entries(spark, d).where("conv_id % 6 <> 0")
    met = m.select(C("conv_id").cast("string").alias("request_id"), F.lit(True).alias("met")).distinct()
    again = m.where("source_index % 7 <> 6").select(C("conv_id").cast("string").alias("request_id"), "source_index", F.when(C("source_index") % 4 == 3, F.concat("content", F.lit("!"))).otherwise(C("content")).alias("again"))
    s = a.sightings(spark, d).join(met, "request_id", "left").join(again, ["request_id", "source_index"], "left")
    outcome = sourcemaps.derived_outcome(C("met"), C("again"), C("source_sha256"))
    return s.select("map_sha256", "source_index", outcome.alias("outcome"), F.when(outcome == "content", F.octet_length("again").cast("long")).alias("n_bytes"))


@query(f"SELECT conv_id, 0 AS source, l AS source_line, l AS first_line, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT conv_id FROM conversations WHERE {GOOD} AND conv_id % 14 NOT IN (2, 9)), (SELECT unnest([0, 1]) AS l)")
def decoded_mappings(spark, d):
    """First generated position of each source line (variable-length quantities need a decoder of their own)."""
    m = _read(spark, d).select("conv_id", python_text.decoded_mappings(F.try_variant_get("map", "$.mappings", "string")).alias("m"))
    seg = m.select("conv_id", F.posexplode("m").alias("line", "segs")).select("conv_id", "line", F.explode("segs").alias("s")).where(F.size("s") >= 4)
    return seg.groupBy("conv_id", C("s")[1].alias("source"), C("s")[2].alias("source_line")).agg(F.min("line").alias("first_line"), F.count("*").alias("n"))

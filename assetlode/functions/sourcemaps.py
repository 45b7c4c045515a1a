"""From a script body to the sources of its inline map, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from assetlode.schemas import MAP_ROW_BUDGET, MAX_MAP_BYTES

MARKERS = ("//# sourceMappingURL=", "//@ sourceMappingURL=")
PREFIXES = ("data:application/json;base64,", "data:application/json;charset=utf-8;base64,")


def announcement(body: Column, window: int = 8 * 1024 * 1024) -> Column:
    """What follows the last marker within the window, to the end of its line; null without a marker."""
    tail = F.replace(F.right(body, F.lit(window)), F.lit(MARKERS[1]), F.lit(MARKERS[0]))
    line = F.regexp_extract(F.substring_index(tail, MARKERS[0], -1), "^([^\\n\\r\\u2028\\u2029]*)", 1)
    return F.when(tail.contains(MARKERS[0]), F.regexp_replace(line, "^[\\s\\u00A0\\uFEFF]+|[\\s\\u00A0\\uFEFF]+$", ""))


def inline_payload(url: Column) -> Column:
    """The base64 text of an inline map; null for any other URL."""
    out = F.lit(None).cast("string")
    for prefix in reversed(PREFIXES):
        out = F.when(F.lower(F.substring(url, 1, len(prefix))) == prefix, F.substring(url, F.lit(len(prefix) + 1), F.length(url))).otherwise(out)
    return out


def payload_refusal(payload: Column, most: int = MAX_MAP_BYTES) -> Column:
    """Why the payload isn't decoded, sizes first; null if it is."""
    ceiling = -(-most * 4 // 3) + 4
    canonical = payload.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(payload) % 4 == 0)
    return F.when(F.length(payload) > ceiling, "too_large").when(payload == "", "empty").when(~canonical, "malformed_base64")


def decoded(payload: Column) -> Column:
    return F.make_valid_utf8(F.try_to_binary(payload, F.lit("base64")).cast("string"))


def without_xssi(json: Column) -> Column:
    """A first line that guards against inclusion is dropped."""
    return F.when(json.startswith(")]}"), F.regexp_replace(json, r"^[^\n]*\n?", "")).otherwise(json)


#: Nesting that the parser bears; a deeper text is refused as too deep, whatever else is wrong with it.
MAX_JSON_DEPTH = 710


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Of keys that an object repeats, the last one counts; parsing reads this setting when it runs."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def nesting(json: Column) -> Column:
    """How deep brackets outside strings nest."""
    signs = F.regexp_replace(F.regexp_replace(json, r'(?s)"(?:\\.|[^"\\])*+(?:"|$)', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.greatest(acc["most"], depth).alias("most"))

    return F.aggregate(F.filter(F.split(signs, ""), lambda c: c != ""), start, step)["most"]


def parse_refusal(json: Column, map_: Column) -> Column:
    """too_deep or malformed_json for a text that gave no map."""
    return F.when(map_.isNull(), F.when(nesting(json) > MAX_JSON_DEPTH, "too_deep").otherwise("malformed_json"))


def map_digest(map_: Column) -> Column:
    """SHA-256 of the map as JSON text written anew, so that spacing doesn't count."""
    return F.sha2(F.to_json(map_).cast("binary"), 256)


def room(recorded: Column, budget: int = MAP_ROW_BUDGET) -> Column:
    """Rows that an artifact may still get beside those recorded for it."""
    return F.greatest(F.lit(0), F.lit(budget) - F.coalesce(recorded, F.lit(0)))


def kind_of(map_: Column) -> Column:
    """not_a_map, nested_sections or too_many_sources; null for a map that is read."""
    is_object = F.schema_of_variant(map_).startswith("OBJECT")
    sources = F.try_variant_get(map_, "$.sources", "array<variant>")
    sections = F.try_variant_get(map_, "$.sections", "array<variant>")
    inner = F.transform(sections, lambda s: F.try_variant_get(s, "$.map.sources", "array<variant>"))
    declared = F.coalesce(F.size(sources), F.lit(0)) + F.coalesce(F.aggregate(inner, F.lit(0), lambda n, s: n + F.coalesce(F.when(s.isNotNull(), F.size(s)), F.lit(0))), F.lit(0))
    nested = F.coalesce(F.exists(sections, lambda s: F.try_variant_get(s, "$.map.sections", "variant").isNotNull()), F.lit(False))
    return F.when(~is_object, "not_a_map").when(nested, "nested_sections").when(declared * 2 > MAP_ROW_BUDGET, "too_many_sources")


def entries(map_: Column) -> Column:
    """(label, content) of each declared source in order; what isn't a string is null."""
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    def of(m: Column) -> Column:
        labels = F.coalesce(F.try_variant_get(m, "$.sources", "array<variant>"), F.array().cast("array<variant>"))
        contents = F.coalesce(F.try_variant_get(m, "$.sourcesContent", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(labels, lambda v, i: F.struct(text(v).alias("label"), text(F.get(contents, i)).alias("content")))

    sections = F.try_variant_get(map_, "$.sections", "array<variant>")
    parts = F.transform(F.filter(sections, lambda s: F.try_variant_get(s, "$.map", "variant").isNotNull()), lambda s: of(F.try_variant_get(s, "$.map", "variant")))
    return F.when(sections.isNotNull(), F.flatten(parts)).otherwise(of(map_))


def derived_refusal(content: Column, depth: Column, most: int = MAX_MAP_BYTES) -> Column:
    return F.when(content.isNull() | (content == ""), "empty").when(F.octet_length(content) > most, "too_large").when(depth >= 1, "depth_exceeded")


def derived_outcome(met: Column, content: Column, digest: Column) -> Column:
    """unavailable if the map couldn't be met again, gone if the source isn't in it, changed if its digest differs, else content."""
    return F.when(met.isNull(), "unavailable").when(content.isNull() | (content == "") | digest.isNull(), "gone").when(F.sha2(content.cast("binary"), 256) != digest, "changed").otherwise("content")

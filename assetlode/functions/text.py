"""Digests, display text, CSV fields and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlode.schemas import LABEL_MAX, SOURCE_EXTENSIONS

CONTROLS = "[\\u0000-\\u001F\\u007F-\\u009F]"
BIDI = "[\\u202A-\\u202E\\u2066-\\u2069]"


def sha256(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def decode_utf8(body: Column) -> Column:
    """Malformed bytes become U+FFFD."""
    return F.make_valid_utf8(body.cast("string"))


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def strip_bidi(text: Column) -> Column:
    return F.regexp_replace(text, BIDI, "")


#: Characters that evidence shows written out, and how; the backslash comes first.
ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
ESCAPES |= {chr(n): f"\\x{n:02X}" for n in (*range(0x20), *range(0x7F, 0xA0)) if chr(n) not in ESCAPES}
ESCAPES |= {chr(n): f"\\u{n:04X}" for n in (*range(0x202A, 0x202F), *range(0x2066, 0x206A))}


def evidence(text: Column) -> Column:
    """Control and bidirectional characters written out."""
    for c, shown in ESCAPES.items():
        text = F.replace(text, F.lit(c), F.lit(shown))
    return text


def label(text: Column) -> Column:
    return F.substring(text, 1, LABEL_MAX)


def csv_field(value: Column) -> Column:
    """Quoted, without control characters, and with an apostrophe before what a spreadsheet would run."""
    clean = strip_controls(F.coalesce(value.cast("string"), F.lit("")))
    guarded = F.when(F.substring(clean, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), clean)).otherwise(clean)
    return F.concat(F.lit('"'), F.replace(guarded, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_row(*fields: Column) -> Column:
    return F.concat(F.concat_ws(",", *map(csv_field, fields)), F.lit("\r\n"))


def source_extension(name: Column) -> Column:
    found = F.lit(".txt")
    for extension in sorted(SOURCE_EXTENSIONS, key=len):
        found = F.when(F.lower(name).endswith(extension), extension).otherwise(found)
    return found


def download_name(sha: Column, name: Column) -> Column:
    return F.when(sha.rlike("^[0-9a-f]{64}$"), F.concat(F.substring(sha, 1, 16), source_extension(name)))


def export_name(table: Column, mode: Column, kind: Column, at_ms: Column) -> Column:
    return F.concat_ws("-", F.lit("inventory"), table, mode, F.concat(F.date_format(F.timestamp_millis(at_ms), "yyyyMMdd'T'HHmmss'Z'"), F.lit("."), kind))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def counted(n: Column, noun: str) -> Column:
    return F.concat(grouped(n), F.when(n == 1, f" {noun}").otherwise(f" {noun}s"))


def utc_seconds(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by three numeric segments; null where a segment has no number."""
    of = lambda v, i: F.when(F.size(F.split(v, r"\.")) > i, F.try_element_at(F.split(v, r"\."), F.lit(i + 1))).otherwise("0")
    number = lambda v, i: F.expr("NULL").cast("int") if v is None else F.regexp_extract(of(v, i), r"^(\d+)", 1).try_cast("int")
    out = F.lit(0)
    for i in (2, 1, 0):
        x, y = number(a, i), number(b, i)
        out = F.when(x.isNull() | y.isNull(), F.lit(None).cast("int")).when(x != y, F.when(x > y, 1).otherwise(-1)).otherwise(out)
    return out


def path_shape(value: Column) -> Column:
    from assetlode.functions.urls import protocol_shaped

    return (
        F.when(protocol_shaped(value), "protocol").when(value.startswith("\\\\"), "windows-unc").when(value.rlike(r"(?s)^.:[\\/]"), "windows-drive")
        .when(value.startswith("/"), "absolute-posix").otherwise("relative")
    )


def resolved_path(value: Column) -> Column:
    """(segments, climbs, clamped): the path without empty and . segments and with .. taken back."""
    start = F.struct(F.array().cast("array<string>").alias("segments"), F.lit(0).alias("climbs"), F.lit(0).alias("clamped"))

    def step(acc: Column, s: Column) -> Column:
        skip, up, none = (s == "") | (s == "."), s == "..", F.size(acc["segments"]) == 0
        kept = F.when(skip, acc["segments"]).when(up & none, acc["segments"]).when(up, F.slice(acc["segments"], F.lit(1), F.greatest(F.size(acc["segments"]) - 1, F.lit(0)))).otherwise(F.concat(acc["segments"], F.array(s)))
        return F.struct(kept.alias("segments"), (acc["climbs"] + F.when(up, 1).otherwise(0)).alias("climbs"), (acc["clamped"] + F.when(up & none, 1).otherwise(0)).alias("clamped"))

    return F.aggregate(F.split(value, r"[/\\]", -1), start, step)


def frames(body: Column, size: int, overlap: int) -> Column:
    """(offset, bytes) of windows that overlap; one empty window for an empty body has no row."""
    step = size - overlap
    n = F.octet_length(body)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - overlap) / step).cast("int") - 1) * step, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda o: F.struct(o.alias("offset"), F.substring(body, o + 1, F.lit(size)).alias("frame")))

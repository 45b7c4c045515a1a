"""Redaction of URLs and source labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlode.schemas import QUERY_NAME_MAX, URL_MAX

REDACTED, QUERY_REDACTED = "<redacted>", "<query-redacted>"


def _segment(s: Column) -> Column:
    """name=value keeps the name; a bare word or only padding after the name is hidden whole."""
    name = F.substring(F.split_part(s, F.lit("="), F.lit(1)), 1, QUERY_NAME_MAX)
    return F.when(s == "", "").when(~s.contains("=") | s.rlike("^[^=]*=+$"), REDACTED).otherwise(F.concat(name, F.lit("=" + REDACTED)))


def redact_query(url: Column) -> Column:
    at = F.instr(url, "?")
    query = F.array_join(F.transform(F.split(F.substring(url, at + 1, F.length(url)), "&", -1), _segment), "&")
    return F.when(at == 0, url).otherwise(F.concat(F.substring(url, F.lit(1), at), query))


def redact_head(url: Column) -> Column:
    """Hides user information and ;path=parameters before the query."""
    at = F.instr(url, "?")
    head = F.when(at == 0, url).otherwise(F.substring(url, F.lit(1), at - 1))
    tail = F.when(at == 0, "").otherwise(F.substring(url, at, F.length(url)))
    prefix = F.regexp_extract(head, r"(?s)^((?:(?!://).)*://)?([^/?#]*)", 1)
    authority = F.when(prefix == "", "").otherwise(F.regexp_extract(head, r"(?s)^((?:(?!://).)*://)?([^/?#]*)", 2))
    path = F.substring(head, F.length(prefix) + F.length(authority) + 1, F.length(head))
    shown = F.when(authority.contains("@"), F.concat(F.lit(REDACTED + "@"), F.substring_index(authority, "@", -1))).otherwise(authority)

    def parts(segment: Column) -> Column:
        return F.array_join(F.transform(F.split(segment, ";", -1), lambda p, i: F.when(i == 0, p).otherwise(_segment(p))), ";")

    return F.concat(prefix, shown, F.array_join(F.transform(F.split(path, "/", -1), parts), "/"), tail)


def normalise(url: Column, most: int = URL_MAX) -> Column:
    """Without the fragment, redacted, and cut at a parameter where it is too long."""
    full = redact_query(redact_head(F.split_part(url, F.lit("#"), F.lit(1))))
    cut = F.substring(full, 1, most)
    before_last = F.substring(cut, F.lit(1), F.length(cut) - F.length(F.substring_index(cut, "&", -1)) - 1)
    query_at = F.instr(cut, "?")
    whole = (F.length(full) <= most) | (F.substring(full, most + 1, 1) == "&") | (query_at == 0) | ~F.substring(cut, query_at, F.length(cut)).contains("&")
    return F.when(whole, cut).otherwise(before_last)


def export_url(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", QUERY_REDACTED)


def protocol_shaped(label: Column) -> Column:
    at = F.instr(label, "://")
    known = F.lit(False)
    for scheme in ("webpack:", "file:", "https:", "http:"):
        known = known | label.startswith(scheme)
    return ((at > 1) & (F.instr(label, "/") == at + 1)) | known


def export_label(label: Column) -> Column:
    return F.when(protocol_shaped(label), export_url(label)).otherwise(F.regexp_replace(label, r"(?s)\?.*$", QUERY_REDACTED))

"""Which captured responses are script assets: columns in, a reason or null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlode.schemas import MAX_BODY_BYTES, SCRIPT_MEDIA_TYPES


def media_type(content_type: Column) -> Column:
    """The part before the first semicolon, in lower case."""
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def header(headers: Column, name: str = "content-type") -> Column:
    """The first value of a header from a map of arrays, under its lower-case or its title-case name."""
    return F.coalesce(F.try_element_at(headers, F.lit(name)), F.try_element_at(headers, F.lit(name.title())))[0]


def scriptish(content_type: Column, url: Column) -> Column:
    bare = F.lower(F.split_part(F.split_part(url, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)))
    return F.coalesce(media_type(content_type).isin(*SCRIPT_MEDIA_TYPES), F.lit(False)) | F.coalesce(bare.endswith(".js") | bare.endswith(".mjs"), F.lit(False))


def reject_reason(status: Column, n_bytes: Column, content_type: Column, url: Column, in_scope: Column | None = None, max_bytes: int = MAX_BODY_BYTES) -> Column:
    """The first rule that fails, cheapest first; null for an admitted response."""
    reason = (
        F.when(status == 304, "revalidation")
        .when(status.isNull() | ~status.between(200, 299), "status")
        .when(n_bytes.isNull() | (n_bytes <= 0), "empty")
        .when(n_bytes > max_bytes, "too_large")
        .when(~scriptish(content_type, url), "not_scriptish")
    )
    return reason if in_scope is None else reason.when(~F.coalesce(in_scope, F.lit(False)), "out_of_scope")


def superset(status: Column, content_type: Column, url: Column) -> Column:
    """A clause that a source can evaluate and that no admitted response fails."""
    likes = [url.ilike("%.js%"), url.ilike("%.mjs%"), *(content_type.ilike(f"%{w}%") for w in ("javascript", "ecmascript", "jscript", "livescript", "text/js"))]
    return status.between(200, 299) & reduce(lambda a, b: a | b, (F.coalesce(x, F.lit(False)) for x in likes))

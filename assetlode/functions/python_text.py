"""Text functions that need a tokenizer of their own: Arrow-batched pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from assetlode.schemas import ERROR_MAX

# Fixed values of the error contract: markers, and what is trimmed from a token before it is judged.
URL_MARK, PATH_MARK = "<url-redacted>", "<path-redacted>"
_TRIMMED = "'\"`()[],;:"

_QUOTED = r"(?:'[^']*'|\"[^\"]*\")"
#: White space, or a token; a quote that begins a token or follows one of =:([{, reaches to its closing one and ends it.
_TOKEN = re.compile(rf"[ \t\n\r\f\v]+|{_QUOTED}|[^ \t\n\r\f\v](?:(?!(?<=[=:(\[{{,]){_QUOTED})[^ \t\n\r\f\v])*(?:(?<=[=:(\[{{,]){_QUOTED})?")
_SCHEME_END = re.compile(r"[A-Za-z0-9+.-]*\Z")
_NO_SPACE = re.compile(r"\S*")
_ABSOLUTE = re.compile(r"/.*/|\\\\.*\\|[A-Za-z]:(?:/.*/|\\.*\\)", re.S)
_AUTHORITY = re.compile(r"([^/?#]+)[/?#]", re.S)
_GRAPHEME = regex.compile(r"\X")
_VLQ = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")}


def _without_urls(text: str) -> str:
    """Each scheme with :// and what follows it up to white space becomes URL_MARK."""
    out, at = [], 0
    while (sep := text.find("://", at)) >= 0:
        scheme = _SCHEME_END.search(text[at:sep])[0].lstrip("0123456789+.-")
        end = _NO_SPACE.match(text, sep + 3).end() if scheme else sep + 3
        out += [text[at : sep - len(scheme)], URL_MARK if scheme else "://"]
        at = end
    return "".join([*out, text[at:]])


def _mark(core: str) -> str | None:
    """What takes the place of an absolute path or of a host that something follows."""
    if _ABSOLUTE.match(core):
        return PATH_MARK
    found = _AUTHORITY.match(core)
    if not found or any(c in found[1] for c in "='\""):
        return None
    host = found[1].rpartition("@")[2]
    if host.startswith("["):
        return URL_MARK if host.find("]") > 1 else None
    name = host[: host.rfind(":")] if host.rfind(":") > 0 else host
    return URL_MARK if name == "localhost" or 0 < name.find(".") < len(name) - 1 else None


def _without_places(token: str) -> str:
    core = token.strip(_TRIMMED)
    start = len(token) - len(token.lstrip(_TRIMMED))
    end = start + len(core)
    mark = _mark(core)
    if mark is None and "=" in core:
        value = core[core.index("=") + 1 :].lstrip(_TRIMMED)
        start, mark = end - len(value), _mark(value)
    return token if mark is None else token[:start] + mark + token[end:]


def redact_error_text(message: str, most: int = ERROR_MAX) -> str:
    """Hides URLs, absolute paths and hosts with a path in an error message, quoted or behind a label or not."""
    return "".join(t if t[0] in " \t\n\r\f\v" else _without_places(t) for t in _TOKEN.findall(_without_urls(message)))[:most]


def graphemes(text: str, most: int) -> tuple[str, int, int]:
    """The first user-perceived characters, how many are shown and how many there are."""
    found = _GRAPHEME.findall(text)
    return "".join(found[:most]), min(most, len(found)), len(found)


def mappings(text: str) -> list[list[list[int]]]:
    """Segments of each line of a source map's mappings, as absolute positions."""
    lines, state = [], [0, 0, 0, 0, 0]
    for line in text.split(";"):
        state[0], segments = 0, []
        for segment in filter(None, line.split(",")):
            values, shift, value = [], 0, 0
            for c in segment:
                digit = _VLQ.get(c)
                if digit is None:
                    raise ValueError(f"no base64 digit: {c!r}")
                value |= (digit & 31) << shift
                if digit & 32:
                    shift += 5
                else:
                    values.append(-(value >> 1) if value & 1 else value >> 1)
                    shift = value = 0
            for i, v in enumerate(values[:5]):
                state[i] += v
            segments.append(state[: min(5, len(values))])
        lines.append(segments)
    return lines


def redact_error(messages: Column) -> Column:
    def each(column: pd.Series) -> pd.Series:
        return column.map(lambda m: None if m is None else redact_error_text(m))

    return F.pandas_udf(each, "string")(messages)


def capped_text(texts: Column, most: int) -> Column:
    def each(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([graphemes(t or "", most) for t in column], columns=["text", "shown", "total"])

    return F.pandas_udf(each, "text string, shown long, total long")(texts)


def decoded_mappings(texts: Column) -> Column:
    """Null where the text isn't a list of variable-length quantities."""
    def one(t: str | None) -> list | None:
        try:
            return None if t is None else mappings(t)
        except ValueError:
            return None

    def each(column: pd.Series) -> pd.Series:
        return column.map(one)

    return F.pandas_udf(each, "array<array<array<int>>>")(texts)

"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score.

Base spans (email, ip, card, phone) come from fixed patterns and fixed checks
and are always kept. Further kinds are proposed by looser patterns and kept if
their score, after the checksum and the context words, reaches a threshold.

Spans of one kind never overlap; spans of different kinds may. Positions count
code points, the end exclusive.

Defined results: a null or empty text has no spans; repeated rows and ties are
judged row by row; an empty table gives an empty table; other columns, whatever
their names, are not read. A row with a null id keeps the null.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assetlode.llm.batches import columns, documents, map_batches, texts_of

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + MORE_KINDS
ORDER = {kind: i for i, kind in enumerate(KINDS)}

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The look-behind and the possessive repeats keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+).-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile("[0-9]")

#: Words that raise or lower the score of a proposal when they stand near it.
CONTEXT = {
    "iban": ({"iban", "account", "bank", "konto", "compte", "cuenta", "transfer"}, {"example", "sample"}),
    "ssn": ({"ssn", "social", "security", "taxpayer", "tin"}, {"part", "serial", "order", "model"}),
    "local_phone": ({"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"}, {"isbn", "order", "invoice", "version", "id"}),
}
#: Score of a proposal whose form and checksum are right, before its context.
START = {"iban": 0.9, "ssn": 0.5, "local_phone": 0.45}
CONTEXT_CHARS = 60
CONTEXT_WEIGHT = 0.3
THRESHOLD = 0.7


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an account number without spaces."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    """Walks back from each @ that a domain follows, as far as the last match allows."""
    found, free = [], 0
    for m in _AT_DOMAIN.finditer(text):
        start = at = m.start()
        while start > free and text[start - 1] in _LOCAL_PART:
            start -= 1
        if start < at:
            found.append((start, m.end()))
            free = m.end()
    return found


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _context(text: str, start: int, end: int, kind: str) -> float:
    good, bad = CONTEXT[kind]
    near = set(re.findall(r"\w+", (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower()))
    return START[kind] + CONTEXT_WEIGHT * (bool(near & good) - bool(near & bad))


def _valid(kind: str, found: str) -> bool:
    if kind == "iban":
        bare = found.replace(" ", "")
        return 15 <= len(bare) <= 34 and mod97(bare)
    if kind == "ssn":
        area, group, serial = found.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    return True


def base_spans(text: str) -> list[Span]:
    spans = []
    if "@" in text:
        spans += [Span(s, e, "email", 1.0) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
                spans.append(Span(m.start(), m.end(), "ip", 1.0))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                spans.append(Span(m.start(), m.end(), "card", 1.0))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    spans.append(Span(m.start(), m.end(), "phone", 1.0))
    return sorted(spans, key=lambda s: (s.start, ORDER[s.kind]))


def more_spans(text: str, base: list[Span]) -> list[Span]:
    """Proposals of the further kinds that don't overlap base spans and score enough."""
    if not _DIGIT.search(text):
        return []
    spans = []
    for kind, pattern in (("iban", _IBAN), ("ssn", _SSN), ("local_phone", _LOCAL_PHONE)):
        for m in pattern.finditer(text):
            if _valid(kind, m[0]) and (score := _context(text, m.start(), m.end(), kind)) >= THRESHOLD:
                spans.append(Span(m.start(), m.end(), kind, min(1.0, score)))
    if not spans or not base:
        return spans
    # the furthest end of the base spans that begin before a place tells whether one reaches over it
    starts, ends = [b.start for b in base], list(accumulate((b.end for b in base), max))
    return [s for s in spans if not (i := bisect_left(starts, s.end)) or ends[i - 1] <= s.start]


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + more_spans(text, base), key=lambda s: (s.start, ORDER[s.kind]))


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind; overlapping spans are replaced as one, under the first one's kind."""
    if not text:
        return text
    out, at = [], 0
    for s in find(text):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if at else text


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans as an array of (kind, start, end, score, value)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = columns(batch)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("value", pa.string())]))
        rows = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score, "value": t[s.start : s.end]} for s in find(t)] for t in texts]
        return pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], ["doc_id", "found"])

    return map_batches(texts_of(docs, id_col, text_col), each, "doc_id long, found array<struct<kind:string,start:long,end:long,score:double,value:string>>")


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with personal data replaced in text_col."""
    at = docs.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.set_column(at, batch.schema.field(at), pa.array([redact(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type))

    return map_batches(docs, each, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, and all spans."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = columns(batch)
        counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
        shas, spans = [], []
        for t in texts:
            found = find(t)
            base = [s for s in found if s.kind in counts]
            for k, n in counts.items():
                n.append(sum(s.kind == k for s in base))
            shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(found))
        return pa.RecordBatch.from_arrays([ids, *(pa.array(n, pa.int64()) for n in counts.values()), pa.array(shas, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in counts), "base_sha256", "spans"])

    return map_batches(texts_of(docs), each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))

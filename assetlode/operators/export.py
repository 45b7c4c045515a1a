"""Exports: hardened CSV and JSON text in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlode.functions import text, urls
from assetlode.operators.ranks import running
from assetlode.schemas import EXPORT_CHUNK

COLUMNS: dict[str, dict[str, object]] = {
    "artifacts": dict.fromkeys(("project_id", "sha256", "byte_len", "kind", "scan_state", "first_seen_at", "last_seen_at", "seen_count")),
    "observations": dict.fromkeys(("project_id", "sha256", "request_id", "url", "status", "content_type", "observed_at")) | {"url": urls.export_url},
    "sources": dict.fromkeys(("artifact_sha256", "map_sha256", "source_index", "sources_verbatim", "source_sha256", "byte_len", "line_count", "producibility", "recovered_at")) | {"sources_verbatim": urls.export_label},
}


def cells(rows: DataFrame, table: str, redacted: bool = True) -> dict[str, Column]:
    """The table's columns in contract order, as text."""
    out = {}
    for name, rule in COLUMNS[table].items():
        c = F.col(name).cast("string")
        out[name] = F.coalesce(rule(c) if redacted and rule else c, F.lit(""))
    return out


def csv_lines(rows: DataFrame, table: str, redacted: bool = True) -> DataFrame:
    found = cells(rows, table, redacted)
    keys = [c for c in rows.columns if c == "chunk"]
    return rows.select(*keys, text.csv_row(*found.values()).alias("line"))


def csv_header(table: str, floor: str | None = None) -> str:
    """The comment of the floor statement, if any, and the names."""
    if floor is not None and any(c in floor for c in '"\r\n'):
        raise ValueError("a floor statement holds no quote and no line end")
    names = ",".join(f'"{n}"' for n in COLUMNS[table])
    return (f"# {floor}\r\n" if floor is not None else "") + names + "\r\n"


def json_rows(rows: DataFrame, table: str, redacted: bool = True) -> DataFrame:
    found = cells(rows, table, redacted)
    return rows.select(F.to_json(F.struct(*(c.alias(n) for n, c in found.items()))).alias("line"))


def json_document(lines: list[str], floor: str | None = None) -> str:
    """One chunk as a document; a chunk is bounded by EXPORT_CHUNK rows."""
    import json

    return f'{{"floor":{json.dumps(floor)},"rows":[{",".join(lines)}]}}'


def chunked(rows: DataFrame, key: str, tie: str, size: int = EXPORT_CHUNK) -> DataFrame:
    """Rows with the number of their chunk in (key, tie) order, newest first."""
    ranked = running(rows, [], [F.col(key).desc(), F.col(tie).desc()], name="_r")
    return ranked.withColumn("chunk", F.floor((F.col("_r") - 1) / size)).drop("_r")


def audited(chunks: DataFrame, table: str, mode: str, kind: str) -> DataFrame:
    """A row a chunk: chunk, n, last, and on the last one the detail of the audit row that the export leaves."""
    per = chunks.groupBy("chunk").agg(F.count("*").alias("n"))
    total = per.agg(F.max("chunk").alias("_last"), F.sum("n").alias("_all"))  # one row
    detail = F.concat_ws(" ", F.lit(table), F.lit(mode), F.lit(kind), F.concat(F.col("_all").cast("string"), F.lit(" rows")))
    last = F.col("chunk") == F.col("_last")
    return per.crossJoin(F.broadcast(total)).select("chunk", "n", last.alias("last"), F.when(last, detail).alias("detail"))


def write_csv(rows: DataFrame, table: str, path: str, redacted: bool = True) -> None:
    """Lines as text files; Spark's CSV writer has no guard against formulas."""
    csv_lines(rows, table, redacted).select(F.regexp_replace("line", "\r\n$", "").alias("value")).write.option("lineSep", "\r\n").text(path)

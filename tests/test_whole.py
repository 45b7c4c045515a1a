"""Queries see whole texts and all rows."""

from __future__ import annotations

from assetlode.plans import registry


def test_escaped_evidence_whole_text(spark, tmp_path):
    rows = [(1, "a" * 250 + "\n\x07"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.shown for r in registry.queries()["escaped_evidence"](spark, str(tmp_path)).collect()}
    assert got == {1: "a" * 250 + "\\n\\x07", 2: "", 3: None}

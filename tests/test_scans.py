"""Scans, listeners and the store: what needs folders, streams or no Spark at all."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assetlode.functions import clauses, python_text
from assetlode.operators import scans
from assetlode.sources import readers
from assetlode.store import Store, copied
from assetlode.streaming import coalesce


@pytest.mark.parametrize(
    ("clause", "want"),
    [
        ("", None), ("   ", "whitespace_only"), ("a//b", "comment_construct"), ('x:"//"', "comment_construct"), ("(a", "unbalanced_parentheses"), (") AND (", "unbalanced_parentheses"), ('x:"(("', None),
        ('x:"a\\"(" AND (y)', None), ('x:"open (', None), ("(" * 3000 + "//", "comment_construct"), ("y" * 2048, None), ("y" * 2049, "too_long"), ("()" * 1025, "too_long"), ('"\\', None), ('"a\\\\"(', "unbalanced_parentheses"),
    ],
)
def test_clause_refusal(spark, clause, want):
    assert spark.createDataFrame([(clause,)], "c string").select(clauses.clause_refusal(F.col("c")).alias("v")).first().v == want


@pytest.mark.parametrize(
    ("message", "want"),
    [
        ("failed https://h/p?token=x now", "failed <url-redacted> now"), ("open '/srv/my files/a.js' (1/2)", "open '<path-redacted>' (1/2)"), ("at C:\\a\\b, and C:\\a", "at <path-redacted>, and C:\\a"), ("cdn.example.org/a?b", "<url-redacted>"),
        ("cdn.example.org", "cdn.example.org"), ("user@host.example:80/x", "<url-redacted>"), ("file=\"/a b/c\" end", "file=\"<path-redacted>\" end"), ("[::1]/x", "[::1]/x"), ("see [::1]:80/x", "see [::1]:80/x"), ("localhost:3/x", "<url-redacted>"), ("1http://x", "1<url-redacted>"),
        ("://x", ":<path-redacted>"), ("/a", "/a"), ("\\\\s\\x y", "<path-redacted> y"), ("", ""), ("'unclosed /a/b", "'unclosed <path-redacted>"), ("x" * 300, "x" * 240),
    ],
)
def test_error_redaction(message, want):
    assert python_text.redact_error_text(message) == want


def test_error_redaction_is_linear():
    for bad in ("a:/" * 60_000, "='" * 60_000, "a" * 200_000, "://" * 60_000):
        assert len(python_text.redact_error_text(bad)) <= 240


def test_reactions():
    assert coalesce.reactions([]) == []
    assert coalesce.reactions([0]) == [(500, 1)]
    assert coalesce.reactions([0, 100, 499]) == [(500, 3)]
    assert coalesce.reactions([0, 500, 600]) == [(500, 1), (1000, 2)]
    # what arrives while the view is locked is counted, and shown by the first reaction after it
    assert coalesce.reactions([0, 600, 2000], [(550, 1500)]) == [(500, 1), (2500, 2)]
    assert coalesce.reactions([0, 2000], [(400, 1500)]) == [(2500, 2)]
    rng = random.Random(1)
    times = sorted(rng.randint(0, 20_000) for _ in range(400))
    found = coalesce.reactions(times)
    assert sum(n for _, n in found) == 400 and all(b - a >= coalesce.INTERVAL_MS for (a, _), (b, _) in zip(found, found[1:]))


def test_latest_and_clock():
    assert coalesce.latest([(0, "p", 1), (100, "p", 2), (200, "q", 9), (500, "p", 3), (900, "p", 4), (1000, "p", 5)], "p") == [(0, 1), (500, 3), (1000, 5)]
    clock = coalesce.EnqueueClock(2)
    for key, at in (("a", 1), ("b", 2), ("c", 3)):
        clock.stamp(key, at)
    assert clock.at == {"b": 2, "c": 3}


def test_reactions_as_a_stream(spark, tmp_path):
    rows = [(p, t) for p in "xy" for t in (0, 100, 700, 5000, 5100, 9000)]
    for i in range(3):
        spark.createDataFrame([r for j, r in enumerate(rows) if j % 6 // 2 == i], "project_id string, at long").coalesce(1).write.parquet(f"{tmp_path}/in/batch={i}")
    stream = spark.readStream.schema("project_id string, at long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = coalesce.stream(stream).writeStream.format("memory").queryName("reactions").outputMode("append").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.project_id, r.at, r.n) for r in spark.table("reactions").collect())
    want = [(at, n) for at, n in coalesce.reactions([t for p, t in rows if p == "x"]) if at <= 9000]
    assert got == sorted((p, at, n) for p in "xy" for at, n in want)


def test_backfill_resumes(spark, tmp_path):
    history = spark.range(95).select(F.col("id").alias("seq"), F.concat(F.lit("r"), F.col("id")).alias("request_id"))
    walk = scans.Backfill(spark, f"file://{tmp_path}/walk")
    assert walk.run(history, pages=2) == 40 and walk.position() == (2, 55, 40)
    again = scans.Backfill(spark, f"file://{tmp_path}/walk")
    later = history.union(spark.range(200, 210).select("id", F.lit("new")))  # what is above the position isn't met again
    assert again.run(later) == 95
    assert sorted(r.seq for r in again.rows().collect()) == list(range(95))
    assert scans.Backfill(spark, f"file://{tmp_path}/none").run(history.where("false")) == 0


def test_store_and_migration(spark, tmp_path):
    steps = [{"audit": lambda t: copied(t, ("k",), "seq")}, {"audit": lambda t: t.withColumn("detail", F.lit(None).cast("string"))}]
    store = Store(spark, f"file://{tmp_path}/store", steps[:1])
    assert store.version() == 0 and store.read("audit") is None and store.tables() == []
    store.write("audit", spark.createDataFrame([("a", 1), ("a", 2), ("", 3), (None, 4), ("b", 5)], "k string, seq long"))
    assert store.migrate() == 1 and sorted(map(tuple, store.read("audit").collect())) == [("a", 1), ("b", 5)]
    store.write("audit", store.read("audit").union(spark.createDataFrame([("c", 6)], "k string, seq long")))
    newer = Store(spark, f"file://{tmp_path}/store", steps)
    assert newer.migrate() == 2 and newer.migrate() == 2 and newer.read("audit").columns == ["k", "seq", "detail"] and newer.read("audit").count() == 3
    with pytest.raises(ValueError):
        store.migrate()
    (tmp_path / "store/audit/s99").mkdir()  # a snapshot whose writer died
    assert newer.read("audit").count() == 3 and newer.tables() == ["audit"]


def test_log_readers(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("200\t0.5\nbad\n404\tx\n304\t1.25\n")
    (tmp_path / "m.csv").write_text("10,5\nx,y\n20,7\n")
    (tmp_path / "r.json").write_text('{"a": 1}\n{"a": 2, "b": 3}\n')
    (tmp_path / "log.txt").write_text("all fine\nOut: OutOfMemory\nOOM 2\ntimed out\nOOM 3\nOOM 4\n")
    assert sorted((r.code, r.seconds) for r in readers.latencies(spark, f"{tmp_path}/l.tsv").where("seconds IS NOT NULL").collect()) == [("200", 0.5), ("304", 1.25)]
    assert [(r.unix_ms, r.rss_kb) for r in readers.memory_trace(spark, f"{tmp_path}/m.csv").collect()] == [(10, 5), (20, 7)]
    assert [r.a for r in readers.results(spark, f"{tmp_path}/r.json", "a long").collect()] == [1, 2]
    found = {r.signal: (r.n, len(r.samples)) for r in readers.signals(spark, f"{tmp_path}/log.txt").collect()}
    assert found["out_of_memory"] == (4, 3) and found["timeout"] == (1, 1) and found["interrupt"] == (0, 0)

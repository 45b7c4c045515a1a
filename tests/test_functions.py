"""Boundary cases of the column functions and of what needs no Spark at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assetlode.functions import admission, python_text, sourcemaps, text, urls
from assetlode.operators import analytics, export, reads, retention, state
from assetlode.streaming import ingest, lifecycle


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("status", "n", "kind", "url", "want"),
    [
        (304, 5, "text/javascript", "a.js", "revalidation"), (199, 5, "text/javascript", "a.js", "status"), (200, 5, "text/javascript", "a", None), (299, 5, "TEXT/JavaScript ; charset=x", "a", None),
        (300, 5, "text/javascript", "a", "status"), (200, None, "text/javascript", "a", "empty"), (200, 0, "text/javascript", "a", "empty"), (200, 8_388_608, "text/javascript", "a", None), (200, 8_388_609, "text/javascript", "a", "too_large"),
        (200, 5, "text/html", "https://x/a.MJS?x#y", None), (200, 5, None, "https://x/a.jsonp", "not_scriptish"), (200, 5, "text/html", None, "not_scriptish"), (None, 5, "text/javascript", "a", "status"),
    ],
)
def test_admission(spark, status, n, kind, url, want):
    row = spark.createDataFrame([(status, n, kind, url)], "status int, n long, kind string, url string")
    assert row.select(admission.reject_reason(F.col("status"), F.col("n"), F.col("kind"), F.col("url")).alias("v")).first().v == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://u:p@h/p;k=v/q?a=1&b&c=&d==&=x#f", "https://<redacted>@h/p;k=<redacted>/q?a=<redacted>&<redacted>&<redacted>&<redacted>&=<redacted>"),
        ("/p;secret/x", "/p;<redacted>/x"), ("h/p?", "h/p?"), ("https://h", "https://h"), ("", ""), ("https://h/?u=a://b@c", "https://h/?u=<redacted>"),
    ],
)
def test_normalised_url(spark, url, want):
    assert one(spark, urls.normalise(F.lit(url))) == want


def test_long_url_is_cut_at_a_parameter(spark):
    url = "https://h/?" + "&".join(f"name{i:04d}=v" for i in range(200))
    got = one(spark, urls.normalise(F.lit(url)))
    assert len(got) <= 2048 and got.endswith("<redacted>") and got.count("&") > 80


def test_export_redaction(spark):
    assert one(spark, urls.export_url(F.lit("a/b#c?d"))) == "a/b<query-redacted>"
    assert one(spark, urls.export_label(F.lit("./a#b?c"))) == "./a#b<query-redacted>"
    assert one(spark, urls.export_label(F.lit("webpack:///a#b"))) == "webpack:///a<query-redacted>"


@pytest.mark.parametrize(("raw", "want"), [("=1", "\"'=1\""), ("a\"b", '"a""b"'), ("\t=1", "\"'=1\""), ("", '""'), ("\x9fok", '"ok"')])
def test_csv_field(spark, raw, want):
    assert one(spark, text.csv_field(F.lit(raw))) == want


def test_csv_header():
    assert export.csv_header("artifacts", "half").startswith('# half\r\n"project_id",')
    with pytest.raises(ValueError):
        export.csv_header("artifacts", 'a"b')
    assert export.json_document(["{}"], None) == '{"floor":null,"rows":[{}]}'


@pytest.mark.parametrize(("label", "want"), [("webpack:///a", "protocol"), ("x://a", "protocol"), ("\\\\srv\\a", "windows-unc"), ("C:\\a", "windows-drive"), ("C:/a", "windows-drive"), ("/a", "absolute-posix"), ("", "relative"), ("a/b://c", "relative")])
def test_path_shape(spark, label, want):
    assert one(spark, text.path_shape(F.lit(label))) == want


def test_resolved_path(spark):
    r = one(spark, text.resolved_path(F.lit("../a\\.//b/../c")))
    assert (r.segments, r.climbs, r.clamped) == (["a", "c"], 2, 1)


def test_lenient_utf8(spark):
    assert one(spark, text.decode_utf8(F.lit(bytearray(b"a\xffb")))) == "a�b"


def test_announcement(spark):
    find = lambda s: one(spark, sourcemaps.announcement(F.lit(s)))
    assert find("x\n//# sourceMappingURL= a.map \ny") == "a.map"
    assert find("//@ sourceMappingURL=a\n//# sourceMappingURL=b\u2028c") == "b"
    assert find("nothing") is None


@pytest.mark.parametrize(("payload", "want"), [("", "empty"), ("abc", "malformed_base64"), ("a===", "malformed_base64"), ("e30=", None), ("A" * 3_495_264, "too_large")])
def test_payload(spark, payload, want):
    assert one(spark, sourcemaps.payload_refusal(F.lit(payload))) == want


def test_map_kinds_and_entries(spark):
    rows = spark.createDataFrame([
        ('{"sources":["a",null,"c",3],"sourcesContent":["x",null,3]}',), ("[1]",), ("{",), ('{"sections":[{"map":{"sources":["a"],"sourcesContent":["1"]}},{"map":null},{"map":{"sources":["b"],"sourcesContent":["2"]}}]}',),
        ('{"sections":[{"map":{"sections":[]}}]}',), ('{"sources":[' + ",".join(["0"] * 1025) + "]}",), (")]}'\n{\"sources\":[]}",),
    ], "j string")
    got = rows.withColumn("m", F.try_parse_json(sourcemaps.without_xssi(F.col("j")))).select(F.coalesce(sourcemaps.parse_refusal(F.col("j"), F.col("m")), sourcemaps.kind_of(F.col("m"))).alias("k"), sourcemaps.entries(F.col("m")).alias("e")).collect()
    assert [r.k for r in got] == [None, "not_a_map", "malformed_json", None, "nested_sections", "too_many_sources", None]
    assert [(e.label, e.content) for e in got[0].e] == [("a", "x"), (None, None), ("c", None), (None, None)]
    assert [(e.label, e.content) for e in got[3].e] == [("a", "1"), ("b", "2")]


def test_python_text(spark):
    assert python_text.redact_error_text("at 'C:\\a b' https://x/y on cdn.example.org:1, /etc/x") == "at 'C:\\a b' <url-redacted> on cdn.example.org:1, <path-redacted>"
    assert len(python_text.redact_error_text("x" * 200_000)) == 240
    assert python_text.graphemes("e\u0301a👨‍👩‍👧b", 2) == ("e\u0301a", 2, 4)
    assert one(spark, text.evidence(F.lit("a\n\x07‮"))) == "a\\n\\x07\\u202E"
    assert python_text.mappings("AAAA;AACA,C") == [[[0, 0, 0, 0]], [[0, 0, 1, 0], [1]]]
    with pytest.raises(ValueError):
        python_text.mappings("!")


def test_limits_and_unknown_sorts(spark):
    assert [reads.clamp_limit(x) for x in (0, 5, 1000, float("inf"), float("nan"), "x", None)] == [1, 5, 100, 100, 100, 100, 100]
    assert reads.read_page(spark.range(3), "artifacts", "nope") == reads.Page([], None, 0, True)


def test_pages_are_disjoint_and_complete(spark):
    rows = spark.range(40).selectExpr("id", "cast(id as string) as sha256", "id div 5 as last_seen_at", "'js' as kind")
    seen, at = [], None
    while True:
        p = reads.read_page(rows, "artifacts", "last_seen_at", 7, at)
        seen += [(r.last_seen_at, r.sha256) for r in p.rows]
        at = p.next_cursor
        if at is None:
            break
    assert seen == sorted(seen, reverse=True) and len(seen) == len(set(seen)) == 40


def test_filtered_page_is_short_but_not_exhausted(spark):
    rows = spark.range(1200).selectExpr("lpad(cast(id as string), 5, '0') as sha256", "id as last_seen_at", "if(id % 400 = 0, 'js', 'x') as kind")
    p = reads.read_page(rows, "artifacts", "last_seen_at", 5, None, True, {"kind": "js"})
    assert len(p.rows) == 1 and not p.exhausted and p.scanned == 500 and p.next_cursor == (700, "00700")


def test_unsighted_ignores_sightings_without_source(spark):
    sources = spark.createDataFrame([("p", "a"), ("p", "b")], "project_id string, source_sha256 string")
    sightings = spark.createDataFrame([("p", "a"), ("p", None)], "project_id string, source_sha256 string")
    assert [r.source_sha256 for r in retention.unsighted(sources, sightings).collect()] == ["b"]


def test_claim_keeps_the_owner(spark):
    old = spark.createDataFrame([("k", 1)], "k string, at long")
    new = spark.createDataFrame([("k", 0), ("j", 5), ("j", 4)], "k string, at long")
    assert sorted(map(tuple, state.claim(old, new, ("k",), ("at",)).collect())) == [("j", 4), ("k", 1)]


def test_percentile_rules_differ(spark):
    rows = spark.range(100).selectExpr("1 as g", "id as v")
    assert analytics.rank_pick(rows, ["g"], "v", analytics.nearest_rank(0.95)).first().picked == 95
    assert analytics.rank_pick(rows, ["g"], "v", analytics.floor_p95()).first().picked == 94


def test_lifecycle_rules():
    assert lifecycle.apply("suspended", 0, "resume") == ("running", 1)
    assert lifecycle.apply("completed", 3, "pause") == ("completed", 3)
    assert lifecycle.should_hold(1528) and not lifecycle.should_hold(1527)
    assert lifecycle.stop_reason(epoch_changed=False, held=False, empty=True, more=True) == "completed"


def test_stream_equals_batch(spark, tmp_path):
    schema = "project_id string, request_id string, seq long, url string, status int, content_type string, body string, observed_at long"
    rows = [("p", str(i), i, "https://h/a.js", 200 if i % 4 else 404, None, f"body{i % 3}", 1000 + i) for i in range(12)]
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(f"seq % 3 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        ingest.start(ingest.read(spark, str(tmp_path / "in"), schema), str(tmp_path / "out")).awaitTermination()
    got = sorted((r.sha256, r.seen_count) for r in ingest.artifacts(spark, str(tmp_path / "out")).collect())
    a = ingest.admit(df).select("project_id", "sha256", "seq", "byte_len", F.lit("js").alias("kind"), F.col("observed_at").alias("at"))
    assert got == sorted((r.sha256, r.seen_count) for r in state.upsert_artifacts(None, a).collect()) and sum(n for _, n in got) == 9


def test_lifecycle_stream(spark, tmp_path):
    schema = "scan_id long, ts long, event_id long, event string"
    rows = [(i % 3, i, i, ("pause", "resume", "advance", "pause", "discard")[i % 5]) for i in range(30)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = lifecycle.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("folded").trigger(availableNow=True).start()
    q.awaitTermination()
    assert lifecycle.state_rows(spark.sql("select * from folded").collect()) == lifecycle.state_rows(lifecycle.fold(df, ("ts", "event_id")).collect())

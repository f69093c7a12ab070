import base64
import json

import pytest
from pyspark.sql import functions as F

from weftlens.functions import privacy, shape
from weftlens.operators import families, navigation
from weftlens.sources import recordings, tables
from weftlens.streaming import follow


def test_recording(spark, tmp_path):
    one = tmp_path / "rec_20260101_001"
    (one / "bodies").mkdir(parents=True)
    (one / "session.json").write_text(json.dumps({"format_version": 1, "id": "rec_20260101_001", "status": "complete", "started_at": "2026-01-01T00:00:00Z"}))
    (tmp_path / "other").mkdir()
    (tmp_path / "other/session.json").write_text('{"id": "x"}')
    line = json.dumps({"id": "ex_000001", "seq": 1, "request": {"method": "GET", "host": "a", "headers": [{"name": "A", "value": "b"}]}, "timing": {"request_start": 5}})
    (one / "http.jsonl").write_text(line + "\n\n" + line.replace("001", "002") + "\n" + line[:40])
    (one / "bodies" / ("a" * 64 + ".bin")).write_bytes(b"xyz")
    assert [r.id for r in recordings.sessions(spark, str(tmp_path)).collect()] == ["rec_20260101_001"]
    assert [(r.id, r.request.headers[0].value, r.timing.request_start) for r in recordings.exchanges(spark, str(one)).orderBy("id").collect()] == [("ex_000001", "b", 5), ("ex_000002", "b", 5)]
    assert [(r.sha256, bytes(r.content)) for r in recordings.bodies(spark, str(one)).collect()] == [("a" * 64, b"xyz")]
    (one / "http.jsonl").write_text('{"id": nonsense}\n' + line + "\n")
    with pytest.raises(Exception, match="unreadable line"):
        recordings.exchanges(spark, str(one)).collect()


def test_broken_lines_in_a_folder_of_files(spark, tmp_path):
    good, cut = '{"id": "a"}\n', '{"id": "b'
    (tmp_path / "one").mkdir()
    (tmp_path / "one/x.json").write_text(good * 3)
    (tmp_path / "one/y.json").write_text(good + cut)
    (tmp_path / "one/z.json").write_text(cut)
    assert recordings.json_lines(spark, str(tmp_path / "one"), "id string").count() == 4
    (tmp_path / "one/z.json").write_text(good + cut + "\n")  # whole, and broken
    with pytest.raises(ValueError, match="unreadable line in .*z.json"):
        recordings.json_lines(spark, str(tmp_path / "one"), "id string")


def test_archive(spark, tmp_path):
    entry = lambda text, enc=None: {"startedDateTime": "2026-01-01T00:00:00.5Z", "time": 1.5, "request": {"method": "GET", "url": "https://a/x"}, "response": {"status": 200, "content": {"mimeType": "text/html", "text": text, "encoding": enc}}}
    path = tmp_path / "a.har"
    path.write_text(json.dumps({"log": {"entries": [entry("plain"), entry(base64.b64encode(b"\x00\xff").decode(), "base64")]}}, indent=1))
    rows = recordings.archive_entries(spark, str(path)).orderBy("sequence").collect()
    assert [(r.sequence, bytes(r.body), r.duration) for r in rows] == [(0, b"plain", 1_500_000), (1, b"\x00\xff", 1_500_000)]
    path.write_text('{"log": {}}')
    with pytest.raises(Exception, match="no log.entries"):
        recordings.archive_entries(spark, str(path)).collect()


def test_json_bodies(spark):
    cases = [
        ('{"p":[{"a":1},{"a":2.50,"b":null}],"n":1e3,"t":true}', "json", "{n:number,p:[{a:number,b:null}],t:bool}", ["1", "2.50", "1e3", "true"], None),
        ("{} {}", "json", "", [], "JSONDecodeError"), ('[1,"x"]', "json", "[any]", ["1", "x"], None), ("[]", "json", "[]", [], None), ('"s"', "json", "string", ["s"], None),
        ("a=1&b=%20&a=2", "form", "{a:[string],b:string}", ["1", "2", " "], None), ("a=%zz", "form", "", [], "ValueError"), ("raw", "opaque", "", [], None), (None, "json", "", [], None),
    ]
    rows = spark.createDataFrame([(k, c[0], c[1]) for k, c in enumerate(cases)], "ref int, text string, kind string")
    out = shape.body_structures(rows).orderBy("ref").collect()
    assert [(b.shape, [s.value for s in b.scalars], b.error) for b in out] == [c[2:] for c in cases]
    assert [(s.path, s.pattern) for s in out[0].scalars][:2] == [("p[0].a", "p[].a"), ("p[1].a", "p[].a")]
    big = shape.parsed_body(json.dumps(list(range(300))), "json")
    assert big["truncated"] and len(big["scalars"]) == shape.MOST_ELEMENTS
    merged = shape.merged_shapes(spark.createDataFrame([("f", '{"a":1}'), ("f", '{"a":1.5,"b":[]}'), ("f", "bad"), ("f", '{"b":["x"]}')], "key string, text string"), "key").first()
    assert merged.shape == "{a:number,b:[string]}"


def test_redaction(spark):
    values = spark.createDataFrame([("s3cr3t-value-long-enough", "cookie", "sid"), ("s3cr3t-value-long-enough", "header", "Authorization"), ("shorty", "query", "token"), ("plain", "query", "page")], "value string, part string, name string")
    known = {r.value: r.label for r in privacy.secrets(values).collect()}
    assert known == {"s3cr3t-value-long-enough": "cookie.sid", "shorty": "query.token"}
    rows = spark.createDataFrame([("x=s3cr3t-value-long-enough&y",), ("shorty",), ("shorty too",), ("a@b.org",), (None,)], "t string")
    out = [r[0] for r in rows.select(privacy.redacted(F.col("t"), known, "k")).collect()]
    assert out[0].startswith("x={{redacted:cookie.sid:") and out[0].endswith("}}&y") and out[1].startswith("{{redacted:query.token:")
    assert out[2] == "shorty too" and out[3].startswith("{{redacted:email:") and out[4] is None


def test_page_views(spark):
    rows = [
        ("s", 0, 0, "pre", False, None, None, "", False, ""), ("s", 1, 1, "a", True, "b", None, "none", False, "navigate"), ("s", 2, 2, "b", True, None, None, "none", False, "navigate"),
        ("s", 3, 3, "x.js", False, None, "b", "", False, ""), ("s", 4, 4, "c", True, None, None, "same-origin", True, "navigate"), ("s", 5, 5, "y", False, None, "b", "", False, ""), ("s", 6, 6, "z", False, None, None, "", False, ""),
        ("s", 7, 7, "d", True, "e", None, "", False, ""), ("s", 8, 8 + navigation.REDIRECT_WINDOW, "e", True, None, None, "x", False, "navigate"),
    ]
    steps = spark.createDataFrame(rows, "session string, seq long, t long, url string, document boolean, redirect_to string, referer string, site string, user boolean, mode string")
    out = [(r.view, r.trigger) for r in navigation.page_views(steps).orderBy("seq").collect()]
    assert out == [(-1, None), (0, "typed"), (0, "typed"), (0, "typed"), (1, "user"), (0, "typed"), (1, "user"), (2, "html"), (3, "link")]


def test_followed_stream_equals_batch(spark, tmp_path):
    events = tables.table(spark, "/root/testdata/sf0.001", "events")
    source, seen = tmp_path / "in", []
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(source))
    routes = lambda rows: {("/".join(r.segments), r.template) for r in families.route_templates(tables.from_events(rows)).collect()}
    follow.follow(spark, str(source), events.schema, str(tmp_path / "state"), lambda rows: seen.append((rows.count(), routes(rows)))).awaitTermination()
    assert seen[-1] == (events.count(), routes(events))

import json
import random

import pytest
from pyspark.sql import functions as F

from weftlens.functions import privacy, rewrite, url
from weftlens.lineage import components
from weftlens.operators import operations, traces, values
from weftlens.sources import recordings, sanitize


def test_components_of_a_long_chain(spark):
    chain = [(f"s{i:03d}", f"s{i + 1:03d}") for i in range(90)] + [("x", "y"), ("y", "z"), ("q", "q")]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {found[f"s{i:03d}"] for i in range(91)} == {"s000"} and found["z"] == "x" and "q" not in found
    slots = spark.createDataFrame([(a,) for a, _ in chain] + [("alone",)], "slot string")
    classes = {r.slot: r.key_class for r in values.key_classes(slots, spark.createDataFrame(chain, "a string, b string")).collect()}
    assert classes["alone"] == "alone" and len({v for k, v in classes.items() if k[0] == "s"}) == 1


def test_lower_medians(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([0, 1, 7, 1 << 17, (1 << 34) + rng.randrange(3), (1 << 50) + rng.randrange(1 << 20)])) for k in "abc" for _ in range(rng.randint(1, 60))]
    counted = spark.createDataFrame(rows, "k string, v long").groupBy("k", "v").agg(F.count("*").alias("n"))
    want = {k: sorted(v for q, v in rows if q == k) for k in "abc"}
    assert {r.k: r.median for r in traces.lower_medians(counted, ["k"], "v").collect()} == {k: v[(len(v) - 1) // 2] for k, v in want.items()}


def test_redirects_are_used_once(spark):
    """Against a scan: the last redirect to a url counts, and its first request takes it."""
    rng = random.Random(4)
    rows, want = [], set()
    for s in range(25):
        t, waiting, todo, mine = 0, {}, [], []
        for i in range(14):
            t += rng.choice([0, 1, 2])
            mine.append((f"s{s}", i, t, t + rng.choice([0, 1, 4]), rng.choice("uv"), rng.choice(["u", "v", None])))
        todo = sorted(range(14), key=lambda i: (mine[i][3], i))
        for j, y in enumerate(mine):
            while todo and mine[todo[0]][3] <= y[2]:
                i = todo.pop(0)
                if i != j and mine[i][5]:
                    waiting[mine[i][5]] = i
            if y[4] in waiting and waiting[y[4]] != j:
                want.add((f"s{s}", waiting.pop(y[4]), j))
        rows += [(*m, bool(k and mine[k - 1][2] == m[2])) for k, m in enumerate(mine)]
    frame = spark.createDataFrame(rows, "session string, pos long, t long, available long, url string, target string, tied boolean")
    assert {(r.session, r.from_pos, r.to_pos) for r in traces.redirect_flows(frame).collect()} == want


def test_inputs_of_operations(spark):
    schema = "operation string, members int, family string, location string, name string, type string, cardinality int, observations int, total int, examples array<string>, fed boolean, entity boolean"
    rows = [
        ("o", 2, "f", "query.k", "k", "string", 5, 9, 9, ["red shoes", "hat"], True, False), ("o", 2, "g", "query.q", "q", "string", 3, 4, 4, ["blue"], False, False),
        ("o", 2, "f", "query.page", "page", "integer", 2, 3, 9, ["2"], False, False), ("o", 2, "g", "query.page", "page", "string", 1, 4, 4, ["x1"], False, False),
        ("o", 2, "f", "query.tok", "tok", "string", 9, 9, 9, ["A9"], True, False), ("o", 2, "g", "query.once", "once", "string", 1, 4, 4, ["y"], False, False),
        ("o", 2, "f", "path.1", "item", "string", 1, 9, 9, ["P-1"], False, True), ("o", 2, "f", "query.sid", "sid", "string", 4, 9, 9, ["{{redacted:x:1}}"], False, False),
    ]
    slots = spark.createDataFrame(rows, schema)
    found = operations.operation_inputs(slots)
    got = {r.name: (r.type, r.slots) for r in found.collect()}
    assert got == {"k": ("string", ["f#query.k"]), "q": ("string", ["g#query.q"]), "page": ("integer|string", ["f#query.page", "g#query.page"]), "item": ("string", ["f#path.1"])}
    assert [(r.operation, r.slot) for r in operations.state_slots(slots).collect()] == [("o", "f#query.tok")]
    always = found.withColumn("always", F.lit(True))
    joined = {r.name: (r.required, r.slots) for r in operations.joined_inputs(always, slots.select("operation", "members").distinct()).collect()}
    assert set(joined) == {"k", "page", "item"} and joined["k"] == (True, ["f#query.k", "g#query.q"]) and joined["item"][0] is False


def test_typed_text(spark):
    rows = spark.createDataFrame([(["red shoes", "a-1"],), (["Red"],), (["12"],), ([],), (["x_y"],)], "e array<string>")
    assert [r[0] for r in rows.select(operations.typed_text(F.col("e"))).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("path,want", [("a/b", "a/b"), ("/a//b/./c", "a/b/c"), ("", "."), ("a/..", "."), ("..", None), ("a/../../b", None), ("a/b/../c", "a/c")])
def test_tree_paths(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(url.safe_tree_path(F.col("p"))).first()[0] == want


def test_resolved_urls(spark):
    rows = spark.createDataFrame([("https://a.b/c/d?x=1", "../e#f"), ("https://a.b/c", "//z.y/q?r=s"), ("https://a.b/c", "http://[bad"), ("https://a.b", None), ("https://a.b/c", "?p=2")], "b string, l string")
    assert [r[0] for r in rows.select(url.resolved(F.col("b"), F.col("l"))).collect()] == ["https://a.b/e", "https://z.y/q?r=s", None, None, "https://a.b/c?p=2"]


def test_json_forms(spark):
    rows = spark.createDataFrame([('{"b":1.0,"a":[1e2,"x"]}', '{ "a": [100, "x"], "b": 1 }'), ('{"a":1}', '{"a":"1"}'), ("[1,2]", "[2,1]"), ("{", "{")], "a string, b string")
    assert [r[0] for r in rows.select(rewrite.same_json(F.col("a"), F.col("b"))).collect()] == [True, False, False, None]
    lists = spark.createDataFrame([([1, 2, 2], [2, 1, 2]), ([1, 2, 2], [1, 1, 2]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in lists.select(rewrite.same_items(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    assert rewrite.rendered({"é": "<a>"}) == '{\n  "é": "<a>"\n}\n'


def test_redacted_documents(spark):
    known = {"s3cr3t-value-long-enough": "cookie.sid"}
    rows = spark.createDataFrame([('{"s3cr3t-value-long-enough": ["x s3cr3t-value-long-enough", 5, null]}', ["a@b.org", None], 1), ("no json a@b.org", [], 2)], "t string, l array<string>, n int")
    out = rows.select(privacy.redacted_json(F.col("t"), known, "k")).collect()
    tag = privacy.tag("cookie.sid", "s3cr3t-value-long-enough", "k")
    assert json.loads(out[0][0]) == {tag: [f"x {tag}", 5, None]} and out[1][0].startswith("no json {{redacted:email:")
    table = privacy.redacted_table(rows, known, "k").collect()
    assert table[0].l[0].startswith("{{redacted:email:") and table[0].l[1] is None and [r.n for r in table] == [1, 2] and tag in table[0].t


def test_sanitized_archives(spark, tmp_path):
    entry = {
        "startedDateTime": "x", "_initiator": {"type": "script", "stack": {"a": 1}}, "extra": {"kept": True},
        "request": {"method": "POST", "url": "https://me:pw@a.test/p?page=2&token=abc&x=%7B%22sid%22%3A1%7D&empty=", "headers": [{"name": "Authorization", "value": "Bearer z"}, {"name": "Referer", "value": "https://a.test/?sid=9&q=1"}, {"name": "Accept", "value": "*"}],
                    "cookies": [{"name": "a", "value": "b"}], "queryString": [{"name": "token", "value": "abc"}, {"name": "page", "value": "2"}], "postData": {"mimeType": "application/x-www-form-urlencoded", "text": "email=a%40b.c&n=1"}},
        "response": {"status": 302, "redirectURL": "/next?code=7", "headers": [{"name": "X-Session-Id", "value": "s"}], "content": {"mimeType": "application/json", "text": '{"user": {"email": "a@b.c", "age": 4, "tokens": [1, "t", null, true]}, "ok": 1.50}'}},
    }
    script = {"request": {"url": "https://a.test/cb.js"}, "response": {"content": {"mimeType": "text/javascript", "text": 'cb({"token": "x", "v": 2});'}}}
    image = {"request": {"url": "https://a.test/i.png"}, "response": {"content": {"mimeType": "image/png", "text": "aGk=", "encoding": "base64"}}}
    rows = spark.createDataFrame([("f", 0, json.dumps(entry)), ("f", 1, json.dumps(script)), ("f", 2, json.dumps(image)), ("f", 3, "{}")], "file string, sequence int, entry string")
    out = {r.sequence: r for r in sanitize.sanitize_entries(rows, sanitize.Config(strip_bodies=("media",), trim_initiators=True)).collect()}
    e = json.loads(out[0].entry)
    assert e["request"]["url"] == "https://a.test/p?page=2&token=REDACTED&x=%7B%22sid%22%3A1%7D&empty=" and e["extra"] == {"kept": True} and e["_initiator"] == {"type": "script"}
    assert [h["value"] for h in e["request"]["headers"]] == ["REDACTED", "https://a.test/?sid=REDACTED&q=1", "*"] and e["request"]["cookies"] == []
    assert e["request"]["postData"]["text"] == "email=REDACTED&n=1" and e["request"]["queryString"][0]["value"] == "REDACTED" and e["response"]["redirectURL"] == "/next?code=REDACTED"
    assert json.loads(e["response"]["content"]["text"]) == {"user": {"email": "REDACTED", "age": 4, "tokens": [0, "REDACTED", None, False]}, "ok": 1.5}
    assert out[0].headers == 2 and out[0].cookies == 1 and out[0].body_fields == 4
    assert json.loads(out[1].entry)["response"]["content"]["text"] == 'cb({"token":"REDACTED","v":2});'
    assert "text" not in json.loads(out[2].entry)["response"]["content"] and out[2].stripped == 1
    kept = sanitize.sanitize_entries(rows, sanitize.Config(drop_classes=("media", "script")))
    assert sorted(r.sequence for r in kept.collect()) == [0, 3]
    sanitize.write_archives(kept.where("sequence = 0"), str(tmp_path / "clean"))
    again = recordings.archive_entries(spark, str(tmp_path / "clean/archive=f")).collect()
    assert [(r.sequence, r.url) for r in again] == [(0, e["request"]["url"])]


def test_archives_keep_numbers_names_and_no_secrets_in_lists(spark, tmp_path):
    entry = '{"time": 1e400, "big": 12345678901234567890.10, "request": {"url": "https://a.test/p", "queryString": [{"name": "q", "value": "{\\"token\\":\\"s3cret\\",\\"n\\":1.50}"}, {"name": "r", "value": "%7B%22sid%22%3A7%2C%22password%22%3A%22p%22%7D"}, {"name": "s", "value": "[1,"}], "postData": {"params": [{"name": "q", "value": "[{\\"email\\":\\"a@b.c\\"}]"}]}}}'
    rows = spark.createDataFrame([("x/a-b.har", 0, entry), ("x/a_b.har", 0, entry), ("y/a_b.har", 0, entry)], "file string, sequence int, entry string")
    out = sanitize.sanitize_entries(rows)
    text = out.first().entry
    assert '"time": 1e400' in text and '"big": 12345678901234567890.10' in text and "s3cret" not in text and "a@b.c" not in text
    e = json.loads(text)["request"]
    assert e["queryString"][0]["value"] == '{"token":"REDACTED","n":1.50}' and e["queryString"][2]["value"] == "[1,"
    assert e["queryString"][1]["value"] == "%7B%22sid%22%3A7%2C%22password%22%3A%22REDACTED%22%7D" and out.first().params == 3
    sanitize.write_archives(out, str(tmp_path / "clean"))
    assert len([p for p in (tmp_path / "clean").iterdir() if p.name.startswith("archive=")]) == 3


def test_bodies_that_grow_when_decoded():
    import gzip
    import zlib

    from weftlens.functions import bodies

    assert bodies.decoded(gzip.compress(b"a") + gzip.compress(b"bc"), "gzip") == b"abc"
    raw = zlib.compressobj(wbits=-15)
    assert bodies.decoded(raw.compress(b"xyz") + raw.flush(), "deflate") == b"xyz"
    large = gzip.compress(b"\0" * (bodies.MOST_DECODED + 1))
    for content, coding, says in ((large, "gzip", "when decoded"), (gzip.compress(b"abc")[:-4], "gzip", "ends before"), (b"?", "gzip", "gzip:"), (b"?", "br", "unsupported")):
        with pytest.raises(ValueError, match=says):
            bodies.decoded(content, coding)


def test_recordings_grow(spark, tmp_path):
    folder = str(tmp_path / "rec_20260101_001")
    row = lambda t: {"started_at": {"t": t}, "request": {"method": "GET", "host": "a", "url": f"https://a/{t}"}}
    recordings.append_exchanges(spark.createDataFrame([row(t) for t in (30, 10, 20)], recordings.EXCHANGE).repartition(3), folder, "rec_20260101_001")
    recordings.append_exchanges(spark.createDataFrame([row(5)], recordings.EXCHANGE), folder, "rec_20260101_001")
    got = sorted((r.seq, r.id, r.started_at.t, r.session_id) for r in spark.read.schema(recordings.EXCHANGE).json(f"{folder}/http.jsonl").collect())
    assert got == [(n, f"ex_{n:06d}", t, "rec_20260101_001") for n, t in enumerate((10, 20, 30, 5), 1)]
    (tmp_path / "rec_20260101_001/session.json").write_text('{"id": "rec_20260101_001"}')
    assert recordings.next_session(spark, str(tmp_path), "20260101") == "rec_20260101_002" and recordings.next_session(spark, str(tmp_path), "20260102") == "rec_20260102_001"
    contents = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"bc"),)], "content binary")
    refs = recordings.store_bodies(contents, f"{folder}/table").collect()
    recordings.store_bodies(contents.limit(1), f"{folder}/table")
    assert {r.ref[:7] for r in refs} == {"bodies/"} and spark.read.parquet(f"{folder}/table").count() == 2


@pytest.mark.parametrize(
    "content,rows",
    [
        ('{"seq": 1}\n{"seq": 2}\n{"se', [1, 2]), ('{"seq": 1}\n\n  \n{"seq": 2}', [1, 2]), ("", []), ('{"seq": 1}\n{"se\n', None), ('{broken\n{"seq": 1}\n{"seq": 2}\n', None), ('{"se\n{"seq": 1}\n{"s', None),
    ],
)
def test_only_the_last_unended_line_may_be_broken(spark, tmp_path, content, rows):
    (tmp_path / "http.jsonl").write_text(content)
    if rows is None:
        with pytest.raises(ValueError, match="unreadable line"):
            recordings.exchanges(spark, str(tmp_path))
    else:
        assert sorted(r.seq for r in recordings.exchanges(spark, str(tmp_path)).collect()) == rows
    assert recordings.exchanges(spark, str(tmp_path / "none")).count() == 0


def test_clipping_keeps_characters_whole(spark):
    from weftlens.functions import text

    rows = spark.createDataFrame([("aé€😀b",), ("ascii only",), (None,)], "t string")
    for most in range(0, 12):
        got = [r[0] for r in rows.select(text.clipped(F.col("t"), most)).collect()]
        want = ["", None]
        for k in range(len("aé€😀b") + 1):
            if len("aé€😀b"[:k].encode()) <= most:
                want[0] = "aé€😀b"[:k]
        assert (got[0], got[2]) == tuple(want) and got[1] == "ascii only"[:most]
    assert spark.createDataFrame([(["b", "a", None, "b"],)], "l array<string>").select(text.clean_list(F.col("l"))).first()[0] == ["a", "b"]


def test_arrays_of_objects(spark):
    from weftlens.functions import shape

    rows = spark.createDataFrame([("r", '{"a":{"items":[{"id":1,"n":null,"tags":["x"],"sub":[{"k":true}]}]},"b":[1,2]}'), ("s", "[{}]"), ("t", "bad"), ("u", None)], "ref string, text string")
    got = {(r.ref, r.path, r.scalars) for r in shape.arrays_of_objects(rows).collect()}
    assert got == {("r", ".a.items[]", 2), ("r", ".a.items[].sub[]", 1), ("s", "[]", 0)}


def test_answer_trees(spark):
    from weftlens.operators import answers

    files = spark.createDataFrame([("a/b/c.txt", 3), ("a/d.txt", 5), ("e.txt", 0)], "path string, size int")
    look = lambda *a, **k: [(r.entry, r.more) for r in answers.listed(files, *a, **k).collect()]
    assert look() == [("a/", 0), ("e.txt (0 bytes)", 0)] and look("a") == [("a/b/", 0), ("a/d.txt (5 bytes)", 0)]
    assert look(recursive=True, most=2) == [("a/", 3), ("a/b/", 3)]
    lines = spark.createDataFrame([("f", k, f"l{k}") for k in range(6)] + [("g", 0, "x")], "path string, line_no int, line string")
    assert sorted(r.line for r in answers.read_lines(lines, "f", 3, 2).collect()) == ["l2", "l3"]


def test_outputs_and_preconditions(spark):
    members = spark.createDataFrame([("o1", "item-read", "f"), ("o1", "item-read", "g"), ("o2", "collection-read", "h"), ("o3", "mutation", "i")], "operation string, role string, family string")
    producers = spark.createDataFrame([("e1", "f", "response.body.id"), ("e2", "g", "response.body.items[].id"), ("e1", "h", "response.body.id")], "entity string, family string, place string")
    variants = spark.createDataFrame([("i", "v", "text/html"), ("i", "w", ""), ("f", "x", "a/b")], "family string, variant string, media string")
    got = {(r.operation, r.entity, r.many, tuple(r.sources)) for r in operations.operation_outputs(members, producers, variants).collect()}
    assert got == {("o1", "e1", False, ("f#response.body.id",)), ("o1", "e2", True, ("g#response.body.items[].id",)), ("o2", "e1", True, ("h#response.body.id",)), ("o3", None, False, ("text/html",))}
    groups = spark.createDataFrame([("c", "p", "cookie", ["cookie.sid"], ["cookie.sid"], 3, 4)], "consumer string, producer string, kind string, keys array<string>, always array<string>, matches int, of int")
    assert operations.preconditions(groups).first().confidence == 0.75


def test_result_ids(spark):
    from weftlens.functions.ids import result_id

    one = spark.createDataFrame([("rec_1", 5), ("rec_2", 7)], "session string, exchanges int")
    assert result_id(one, ["B.org.", "a.org"]) == result_id(one.orderBy(F.desc("session")).repartition(2), ["a.org", "b.org", ""]) != result_id(one)
    assert result_id(one.limit(1)) != result_id(one)

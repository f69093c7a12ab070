import json
import random

import pytest
from pyspark.sql import functions as F

from weftlens.functions import headers
from weftlens.operators import observations
from weftlens.plans.cluster import cluster
from weftlens.sources import results
from weftlens.sources.recordings import EXCHANGE


def shop():
    """Two sessions: a search, then two products, each with a script and an offer; a cookie set at first comes back."""
    rows = []
    for s, items in (("rec_1", ["p11", "p22"]), ("rec_2", ["p33", "p44"])):
        t = [0]

        def add(path, media, cookie=True, set_=None, extra=()):
            n = len([r for r in rows if r["session_id"] == s]) + 1
            start = t[0] = t[0] + 10**9
            rows.append({
                "id": f"ex_{n:06d}", "seq": n, "session_id": s, "started_at": {"t": start},
                "request": {"method": "get", "host": "shop.test", "url": f"HTTPS://Shop.test:443{path}", "headers": [{"name": "cookie", "value": f"sid={s}-secret; a=b"}] * cookie + list(extra)},
                "response": {"status": 200, "headers": [{"name": "content-type", "value": f"{media}; charset=utf-8"}] + ([{"name": "set-cookie", "value": f"sid={set_}; Path=/"}] if set_ else [])},
                "timing": {"request_start": start, "response_start": 0, "response_end": start + 4 * 10**7},
            })

        html = [{"name": "Sec-Fetch-Dest", "value": "document"}, {"name": "Sec-Fetch-Mode", "value": "navigate"}]
        add("/", "text/html", False, f"{s}-secret", [*html, {"name": "Sec-Fetch-Site", "value": "none"}])
        html += [{"name": "Sec-Fetch-Site", "value": "same-origin"}, {"name": "Sec-Fetch-User", "value": "?1"}]
        add("/static/app.js", "text/javascript")
        add(f"/s?k={s}", "application/json")
        for item in items:
            add(f"/dp/{item}", "text/html", extra=html)
            add("/static/app.js", "text/javascript")
            add(f"/api/offer?item={item}", "application/json")
    return rows


def plain(out):
    return {name: sorted(str(r) for r in df.collect()) for name, df in out.items()}


def test_whole_pass(spark, tmp_path):
    rows = shop()
    out = cluster(spark.createDataFrame(rows, EXCHANGE), ["shop.test"])
    found = {r.template: r for r in out["families"].collect()}
    assert set(found) == {"/", "/static/app.js", "/s", "/dp/{id}", "/api/offer"}
    assert found["/dp/{id}"].observations == 4 and found["/static/app.js"].static and found["/static/app.js"].observations == 6
    slots = {(r.family, r.location): r for r in out["slots"].collect()}
    assert slots[found["/dp/{id}"].family, "path.1"].cardinality == 4
    edges = {(r["from"], r["to"]): r for r in out["edges"].collect()}
    product, offer, home = (found[k].family for k in ("/dp/{id}", "/api/offer", "/"))
    assert (edges[home, offer].ordered, edges[home, offer].sessions) == (4, 2)
    assert (edges[product, product].ordered, edges[product, product]["without"]) == (2, 2)
    flows = {(r["from"], r["to"]) for r in out["edge_flows"].collect()}
    assert (home, product) in flows and (home, offer) in flows
    cookies = {(r["from"], r["to"]): r for r in out["edge_flows"].collect() if r.carrier == "cookie"}
    assert (cookies[home, product].matches, cookies[home, product]["values"], cookies[home, product].from_place) == (4, 2, "sid")
    episodes = out["episodes"].collect()
    assert sorted(r.trigger for r in episodes) == ["typed"] * 2 + ["user"] * 4 and {r.exchanges for r in episodes} == {3}
    assert {(r.name, r.n) for r in out["browser"].collect() if r.family == product and r.counted == "trigger"} == {("user", 4)}
    random.Random(1).shuffle(rows)
    first = plain(out)
    assert plain(cluster(spark.createDataFrame(rows, EXCHANGE).repartition(3), ["shop.test"])) == first
    assert cluster(spark.createDataFrame(rows, EXCHANGE), ["other.test"])["families"].count() == 0
    some = {k: out[k] for k in ("families", "edges")}
    results.write_result(some, str(tmp_path / "r"))
    assert plain(results.read_result(spark, str(tmp_path / "r"))) == {k: first[k] for k in some}
    with pytest.raises(ValueError, match="no complete result"):
        results.read_result(spark, str(tmp_path / "none"))


def test_results_are_whole(spark, tmp_path):
    folder = str(tmp_path / "r")
    one = {"families": spark.createDataFrame([("f1", "mail a@b.org"), ("f2", None)], "family string, note string"), "links": spark.createDataFrame([("l1", 2)], "link string, n int")}
    results.write_result(one, folder)
    two = {**one, "links": one["links"].limit(0)}
    results.write_result(two, folder)
    assert results.read_result(spark, folder, check=True)["links"].count() == 0
    assert {tuple(r) for r in results.references(one).collect()} == {("family", "f1"), ("family", "f2"), ("link", "l1")}
    results.write_redacted(one, str(tmp_path / "clean"), {}, "k")
    clean = results.read_result(spark, str(tmp_path / "clean"))["families"].orderBy("family").collect()
    assert clean[0].family == "f1" and clean[0].note.startswith("mail {{redacted:email:") and clean[1].note is None
    run = next(p for p in (tmp_path / "clean").iterdir() if p.name.startswith("run_"))
    one["families"].limit(1).write.mode("overwrite").parquet(str(run / "families"))
    with pytest.raises(ValueError, match="not what was written"):
        results.read_result(spark, str(tmp_path / "clean"), check=True)


def test_ledgers_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1), ("a", None)], "kind string, n int")
    for run in ("r1", "r2"):
        results.append_ledger(rows, str(tmp_path / "decisions"), run)
    assert results.read_ledger(spark, str(tmp_path / "decisions"), "kind string, n int").count() == 4
    assert results.read_ledger(spark, str(tmp_path / "decisions"), "kind string, n int", "r2").where("kind = 'b'").first().n == 1
    assert results.markdown(rows, "Runs") == "# Runs\n\n| kind | n |\n| --- | --- |\n| a |  |\n| b | 1 |\n"


def test_role_scores(spark):
    from weftlens.operators import semantics

    e = spark.createDataFrame([("f1", "read"), ("f2", "read"), ("f3", "write"), ("f4", "write")], "family string, role string")
    p = spark.createDataFrame([("f1", "read"), ("f2", "write"), ("f3", "write"), ("f4", "unknown"), ("f5", "read")], "family string, role string")
    got = {r.measure: tuple(r)[1:] for r in semantics.role_scores(e, p).collect()}
    assert got == {"read": (1, 2, 2, 0.5, 0.5), "write": (1, 2, 2, 0.5, 0.5)}


def test_request_kinds(spark):
    pair = "array<struct<name:string,value:string>>"
    of = lambda **h: [{"name": k.replace("_", "-"), "value": v} for k, v in h.items()]
    cases = [
        ("GET", of(sec_fetch_dest="document", sec_fetch_mode="navigate"), [], 200, "document"), ("GET", of(Sec_Fetch_Dest="empty", Sec_Fetch_Mode="cors"), [], 200, "fetch"),
        ("GET", of(Sec_Fetch_Dest="empty", Sec_Fetch_Mode="websocket"), [], 101, "websocket"), ("GET", of(Sec_Fetch_Dest="Image"), [], 200, "image"),
        ("GET", of(Accept="application/json;q=0.2, text/html"), of(Content_Type="text/html; x=y"), 200, "document"), ("GET", of(Accept="*/*, text/html"), of(Content_Type="text/html"), 200, ""),
        ("GET", of(Accept="text/html"), of(Location="/x"), 302, "document"), ("POST", of(Accept="text/html"), of(Content_Type="text/html"), 200, ""),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, m string, q {pair}, r {pair}, s int, want string")
    out = rows.orderBy("k").select(headers.request_kind(F.col("m"), F.col("q"), F.col("r"), F.col("s")), "want").collect()
    assert [r[0] for r in out] == [r[1] for r in out]


def test_carried_values(spark):
    out = observations.values(observations.observations(spark.createDataFrame(shop()[:1], EXCHANGE))).collect()
    assert [(r.side, r.part, r.path, r.value) for r in out] == [("response", "set-cookie", "sid", "rec_1-secret")]


def test_revisions(spark, tmp_path):
    folder = str(tmp_path / "ir")
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "node string, content string")
    assert results.commit_revision(one, folder) == (1, True)
    assert results.commit_revision(one.orderBy(F.desc("node")), folder) == (1, False)
    two = one.union(spark.createDataFrame([("c", "z")], one.schema))
    assert results.commit_revision(two, folder) == (2, True)
    assert results.load_revision(spark, folder, 1).count() == 2
    run = json.loads((tmp_path / "ir/index/00000002.json").read_text())["run"]
    two.limit(2).write.mode("overwrite").parquet(f"{folder}/{run}")
    with pytest.raises(ValueError, match="not what was committed"):
        results.load_revision(spark, folder, 2)


def test_revisions_survive_a_crash(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "ir")
    one = spark.createDataFrame([("a", "x")], "node string, content string")

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # after the rows, before the index
        m.setattr(results, "_claim", dies)
        with pytest.raises(RuntimeError):
            results.commit_revision(one, folder)
    assert results.commit_revision(one, folder, base=0) == (1, True)
    assert results.drop_orphans(spark, folder) == [] and len(results.drop_orphans(spark, folder, 0)) == 1
    assert results.load_revision(spark, folder, 1).count() == 1
    two = one.union(spark.createDataFrame([("b", None)], one.schema))
    with pytest.raises(results.Conflict):
        results.commit_revision(two, folder, base=0)
    with monkeypatch.context() as m:  # two writers that have seen the same index
        first = results._entries(spark, folder)
        assert results.commit_revision(two, folder, base=1) == (2, True)
        m.setattr(results, "_entries", lambda *_: first)
        with pytest.raises(results.Conflict, match="meanwhile"):
            results.commit_revision(one.limit(0), folder, base=1)
    assert [r.revision for r in results._entries(spark, folder)] == [1, 2]


def test_digests_see_nulls(spark):
    digest = lambda rows: results.table_digest(spark.createDataFrame(rows, "a string, b string"))
    assert len({digest(r) for r in ([("x", None)], [(None, "x")], [("x", "")], [("x", None)] * 2, [])}) == 5
    rows = [("x", None), ("y", "z"), ("y", "z")]
    assert digest(rows) == digest(rows[::-1]) == results.table_digest(spark.createDataFrame([(b, a) for a, b in rows], "b string, a string").repartition(3))


def exchange(n, path, media="text/html", status=200, method="GET", asked=(), given=(), start=None, end=None, body=None, answer=None):
    pairs = lambda x: [{"name": k, "value": v} for k, v in x]
    start = n * 10**9 if start is None else start
    return {
        "id": f"ex_{n:06d}", "seq": n, "session_id": "rec_1", "started_at": {"t": start},
        "request": {"method": method, "host": "a.test", "url": f"https://a.test{path}", "headers": pairs(asked), "body": body},
        "response": {"status": status, "headers": pairs([("Content-Type", media), *given]), "body": answer},
        "timing": {"request_start": start, "response_start": 0, "response_end": start + 10**7 if end is None else end},
    }


def test_bodies_make_families(spark):
    """POSTs to one path with bodies of different shapes are different families; codings are undone."""
    import gzip
    import hashlib

    rows, stored = [], {}
    coded = [b'{"a": 1}', b'{"a": 2}', b'{"b": [1, 2.5]}', b'{"b": []}', b"x=1&y=2", b"{broken", gzip.compress(b'{"a": 3}')]
    kinds = ["application/json"] * 4 + ["application/x-www-form-urlencoded"] + ["application/json"] * 2
    for n, (raw, kind) in enumerate(zip(coded, kinds), 1):
        sha = hashlib.sha256(raw).hexdigest()
        stored[sha] = raw
        body = {"sha256": sha, "size": len(raw), "content_type": kind, "content_encoding": "gzip" if raw[:2] == b"\x1f\x8b" else None}
        rows.append(exchange(n, "/api", method="POST", body=body))
    contents = spark.createDataFrame([(k, bytearray(v)) for k, v in stored.items()], "sha256 string, content binary")
    out = cluster(spark.createDataFrame(rows, EXCHANGE), contents=contents)
    got = sorted((r.body_kind, r.body_shape) for r in out["bodies"].collect())
    assert got == [("form", "{x:string,y:string}"), ("json", "{a:integer}"), ("json", "{b:[]}"), ("json", "{b:[number]}"), ("opaque", "application/json")]
    slots = {(r.location, r.cardinality) for r in out["slots"].collect()}
    assert ("body.a", 3) in slots and ("body.x", 1) in slots


def test_redirects_and_views(spark):
    doc = [("Sec-Fetch-Dest", "document"), ("Sec-Fetch-Mode", "navigate")]
    rows = [
        exchange(1, "/early.js", "text/javascript"),
        exchange(2, "/go", status=302, asked=[*doc, ("Sec-Fetch-Site", "none")], given=[("Location", "/landed?x=1#part")]),
        exchange(3, "/landed?x=1", asked=doc),
        exchange(4, "/api/data", "application/json", asked=[("Referer", "https://a.test/landed?x=1")]),
        exchange(5, "/next", asked=[*doc, ("Sec-Fetch-User", "?1")]),
        exchange(6, "/api/late", "application/json", asked=[("Referer", "https://a.test/landed?x=1")]),
        exchange(7, "/api/origin", "application/json", asked=[("Referer", "https://a.test/")]),
    ]
    out = cluster(spark.createDataFrame(rows, EXCHANGE))
    got = {(r.first_step, r.last_step, r.exchanges, r.trigger) for r in out["episodes"].collect()}
    assert got == {(0, 0, 1, None), (1, 5, 4, "typed"), (4, 6, 2, "user")}
    assert [(r.from_pos, r.to_pos, r.carrier) for r in out["flows"].collect() if r.carrier == "redirect"] == [(1, 2, "redirect")]


def test_a_step_without_a_family_is_skipped(spark):
    rows = spark.createDataFrame([("s", 1, 1, "x"), ("s", 2, 2, None), ("s", 3, 3, "y")], "session string, seq int, t long, family string")
    from weftlens.operators import traces

    steps = traces.steps(rows)
    assert [r.previous for r in steps.orderBy("pos").collect()] == [None, "x", "x"]
    edge = traces.edges(steps).collect()
    assert [(r["from"], r["to"], r.immediate, r.median) for r in edge] == [("x", "y", 1, 2)]

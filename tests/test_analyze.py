"""The second pass over a small shop, against literals."""

import hashlib
import json

import pytest

from weftlens.plans.analyze import analyze
from weftlens.plans.cluster import cluster
from weftlens.sources.recordings import EXCHANGE


@pytest.fixture(scope="module")
def described(spark):
    rows, contents = [], {}

    def body(text, media):
        data = text.encode()
        sha = hashlib.sha256(data).hexdigest()
        contents[sha] = data
        return {"ref": f"bodies/{sha}.bin", "size": len(data), "sha256": sha, "content_type": media}

    for n, (s, word, items) in enumerate((("rec_1", "red shoes", ["PROD1001A", "PROD2002B"]), ("rec_2", "blue hat", ["PROD3003C", "PROD1001A"]), ("rec_3", "warm coat", ["PROD4004D", "PROD2002B"]))):
        t = [n * 10**12]

        def add(method, path, media, text, dest="empty", set_=None, sent=None, user=False, s=s, t=t):
            t[0] += 10**9
            k = len([r for r in rows if r["session_id"] == s]) + 1
            pairs = [{"name": "Sec-Fetch-Dest", "value": dest}, {"name": "Sec-Fetch-Mode", "value": "navigate" if dest == "document" else "cors"}, {"name": "Sec-Fetch-Site", "value": "same-origin" if k > 1 else "none"}]
            pairs += [{"name": "Sec-Fetch-User", "value": "?1"}] * user + [{"name": "cookie", "value": f"sid={s}-secret-cookie"}] * (k > 1)
            rows.append({
                "id": f"ex_{k:06d}", "seq": k, "session_id": s, "started_at": {"t": t[0]},
                "request": {"method": method, "host": "shop.test", "url": f"https://shop.test{path}", "headers": pairs, "body": body(sent, "application/json") if sent else None},
                "response": {"status": 200, "headers": [{"name": "content-type", "value": media}] + ([{"name": "set-cookie", "value": f"sid={set_}"}] if set_ else []), "body": body(text, media) if text else None},
                "timing": {"request_start": t[0], "response_start": 0, "response_end": t[0] + 10**7},
            })

        add("GET", "/", "text/html", "<html>" + "x" * 2000, "document", f"{s}-secret-cookie", user=True)
        add("GET", "/app.js", "text/javascript", "var x;", "script")
        hits = [{"id": i, "price": 1.5 + n, "title": f"Item {i}"} for i in items]
        add("GET", f"/search?q={word.replace(' ', '+')}", "application/json", json.dumps({"hits": hits, "more": False}))
        for i in items:
            add("GET", f"/products/{i}", "application/json", json.dumps({"id": i, "stock": n + 3}))
            add("POST", "/cart", "application/json", json.dumps({"ok": True}), sent=json.dumps({"product": i, "n": 1}))
        add("OPTIONS", "/cart", "text/plain", None)
        add("GET", "/ping", "text/plain", None)
    stored = spark.createDataFrame(list(contents.items()), "sha256 string, content binary")
    out = cluster(spark.createDataFrame(rows, EXCHANGE), ["shop.test"], contents=stored)
    names = {r.family: f"{r.method} {r.template}" for r in out["families"].collect()}
    found = {k: df.cache() for k, df in analyze(out).items()}
    return names, found, out


def test_roles(described):
    names, found, _ = described
    roles = {names[r.family]: (r.role, r.how) for r in found["roles"].collect()}
    assert roles == {
        "GET /": ("collection_read", "decision"), "GET /app.js": ("presentation", "rule"), "GET /search": ("collection_read", "decision"), "GET /products/{id}": ("item_read", "decision"),
        "POST /cart": ("item_read", "decision"), "OPTIONS /cart": ("background", "rule"), "GET /ping": ("background", "rule"),
    }


def test_operations_inputs_and_outputs(described):
    names, found, _ = described
    inputs = {(names[r.operation], r.name): r for r in found["inputs"].collect()}
    assert inputs["GET /search", "q"].required and inputs["GET /search", "q"].words
    outs = {names[r.operation]: (r.entity, r.many) for r in found["outputs"].collect()}
    assert outs["GET /search"] == ("shop.test:body.hits[]", True) and outs["GET /products/{id}"][0] is None
    assert {r.container: r.names for r in found["entities"].collect()} == {"body.hits[]": ["hit"]}
    assert {(r.field, r.type) for r in found["fields"].collect()} == {("id", "string"), ("price", "number"), ("title", "string")}
    state = {(names[r.operation], r.slot.split("#")[1]) for r in found["state"].collect()}
    assert ("GET /products/{id}", "path.1") in state and not any(slot == "query.q" for _, slot in state)


def test_prerequisites_and_coverage(described):
    names, found, _ = described
    needs = {(names[r.consumer], names[r.producer], r.kind): r for r in found["prerequisites"].collect()}
    offer = needs["GET /products/{id}", "GET /search", "parameter"]
    assert offer.keys == ["path.1"] and offer.scope == "request" and offer.matches == 6
    assert needs["GET /search", "GET /", "cookie"].always == ["cookie.sid"]
    c = found["coverage"].first()
    assert c.relevant > 0 and c.covered == c.relevant


def test_unchanged_evidence_is_not_decided_again(described):
    _, found, out = described
    again = analyze(out, prior=found["decisions"])["decisions"].collect()
    assert again and all(r.reused for r in again)


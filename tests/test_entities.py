"""Entities from nested bodies, held against literals."""

import json

import pytest
from pyspark.sql import functions as F

from weftlens import queries
from weftlens.functions import shape, text
from weftlens.lineage import written
from weftlens.operators import entities, operations

BODIES = [
    ("v1", '{"page":1,"hits":[{"id":"a","price":1.5,"left":null,"seller":{"name":"x"}},{"id":"b","price":2,"left":3,"tags":["t"]}],"none":[]}'),
    ("v2", '{"hits":[{"id":7,"price":3.5,"left":null,"offers":[{"a":1,"b":2,"c":3}]}]}'),
    ("v3", '[{"only":1}]'),
    ("v4", '{"a":{"b":{"c":{"rows":[{"x":1}]}}}}'),
    ("v5", '{"a":{"b":{"rows":[{"x":1}]}}}'),
    ("v6", "17"), ("v7", "{broken"), ("v8", None), ("v9", "{}"), ("w1", '{"m":[[{"x":1}]]}'),
]


def test_containers(spark):
    rows = shape.containers(spark.createDataFrame(BODIES, "ref string, text string")).collect()
    got = {(r.ref, r.container, r.field, r.type) for r in rows}
    assert {x for x in got if x[0] == "v1"} == {
        ("v1", "body", "page", "integer"), ("v1", "body", "hits", "items"), ("v1", "body", "none", "array"), ("v1", "body.hits[]", "id", "string"), ("v1", "body.hits[]", "price", "number"),
        ("v1", "body.hits[]", "left", "any"), ("v1", "body.hits[]", "seller", "object"), ("v1", "body.hits[]", "tags", "array"), ("v1", "body.hits[].seller", "name", "string"),
    }
    assert {r.ref: r.root for r in rows} == {"v1": "object", "v2": "object", "v3": "array", "v4": "object", "v5": "object", "v6": "integer", "v9": "object", "w1": "object"}
    assert {(r.container, r.item, r.level) for r in rows if r.ref == "v4"} == {("body", False, 0), ("body.a", False, 1), ("body.a.b", False, 2), ("body.a.b.c", False, 3), ("body.a.b.c.rows[]", True, None)}
    assert ("w1", "body.m[][]", "x", "integer") in got


def test_lists_within_two_levels(spark):
    found = operations.listed(shape.containers(spark.createDataFrame(BODIES, "ref string, text string")))
    assert {r.ref: r.listed for r in found.collect()} == {"v1": True, "v2": True, "v3": True, "v4": False, "v5": True, "v6": False, "v9": False, "w1": False}


def test_item_entities(spark):
    found = shape.containers(spark.createDataFrame(BODIES, "ref string, text string"))
    variants = spark.createDataFrame([("v1", "h", 10), ("v2", "h", 5), ("v3", "h", 1)], "ref string, host string, count long")
    fields = entities.item_fields(found, variants, least=2)
    got = {(r.container, r.field): (r.type, r.nulls, r.observations, r.n_sources, r.sources) for r in fields.collect()}
    assert got[("body.hits[]", "id")] == ("any", 0, 15, 2, ["v1#response.body.hits[].id", "v2#response.body.hits[].id"])
    assert got[("body.hits[]", "left")] == ("null", 5, 5, 1, ["v2#response.body.hits[].left"])  # in v1 it has two types, so it is no scalar there
    assert got[("body.hits[]", "price")][0] == "number" and ("body[]", "only") not in got
    rows = {r.container: (r.parent, r.names) for r in entities.item_entities(fields).collect()}
    assert rows == {"body.hits[]": (None, ["hit"]), "body.hits[].offers[]": ("body.hits[]", ["offer", "hit"])}


def test_keyed_fields_and_names(spark):
    found = shape.containers(spark.createDataFrame(BODIES, "ref string, text string"))
    producers = spark.createDataFrame([("seller", "f", "body.hits[].seller.name"), ("hit", "f", "body.hits[].id")], "entity string, family string, path string")
    variants = spark.createDataFrame([("v1", "f", 2), ("v2", "g", 5)], "ref string, family string, count long")
    got = {(r.entity, r.field, r.type, r.observations) for r in entities.keyed_fields(producers, found, variants).collect()}
    assert got == {("seller", "name", "string", 2), ("hit", "id", "string", 2), ("hit", "price", "number", 2)}
    consumers = spark.createDataFrame([("hit", "path", "2", "products"), ("hit", "query", "hit-id", None), ("hit", "body", "a.product_id[]", None)], "entity string, part string, pattern string, before string")
    assert {(r.subject, r.name) for r in entities.key_name_votes(consumers, producers).collect()} == {("hit", "product"), ("hit", "hit_id"), ("hit", "product_id"), ("hit", "id"), ("seller", "name")}


def test_names(spark):
    cases = {"9items": "items", "a": None, "unknown": None, "x-y_": "x_y", "__ab c": "abc", "redactedId": None, "n" * 41: None, "é1a2": "a2"}
    df = spark.createDataFrame([(c,) for c in cases], "n string")
    assert {r.n: r.c for r in df.select("n", text.clean_name(F.col("n")).alias("c")).collect()} == cases
    plural = {"categories": "category", "class": "class", "boxes": "box", "uses": "us", "ties": "tie", "items": "item", "gas": "gas", "status": "statu"}
    df = spark.createDataFrame([(c,) for c in plural], "n string")
    assert {r.n: r.c for r in df.select("n", text.singular(F.col("n")).alias("c")).collect()} == plural


def test_shapes_without_scalars():
    bodies = [t for _, t in BODIES if t and t != "{broken"] + ['[1, 12345678901234567890, 9223372036854775807, -9223372036854775808, 9223372036854775808]', '{"a":[[1],[2.5],[]],"b":[true,null],"c":[{"x":1},{"y":"s"}],"d":1e5}', "[" * 30 + "]" * 30]
    bodies += ["[" + ",".join("[" + ",".join(["1"] * 190) + ',{"z":1}]' for _ in range(150)) + "]", "[" + ",".join(["1"] * 200) + ',"x"]']
    for t in bodies:
        assert shape.shape_of(t) == shape.walk(shape.parse_json(t))[0]


def test_structure_is_walked_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    structure = shape.containers(spark.createDataFrame(BODIES, "ref string, text string"))
    held = structure.count()
    variants = spark.createDataFrame([("v1", "h", 10), ("v2", "h", 5)], "ref string, host string, count long")
    assert entities.item_fields(structure.mapInArrow(count, shape.FIELDS), variants, least=2).count() == 6 and seen.value == held
    beside = shape.containers(spark.createDataFrame([("v3", BODIES[2][1], "h1"), ("w1", BODIES[-1][1], "h2")], "ref string, text string, host string"), beside="host")
    assert {(r.ref, r.host) for r in beside.collect()} == {("v3", "h1"), ("w1", "h2")}


def test_no_broadcast_by_file_size(spark, monkeypatch):
    """A written structure is far smaller than its rows, so its size tells nothing about what the driver would hold."""
    structure = written(shape.containers(spark.createDataFrame(BODIES, "ref string, text string")))
    variants = written(spark.createDataFrame([("v1", "f", 2), ("v2", "g", 5)], "ref string, family string, count long"))
    producers = spark.createDataFrame([("hit", "f", "body.hits[].id")], "entity string, family string, path string")
    monkeypatch.setattr(entities, "merged_fields", lambda rows, key: rows)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [ref" in plan(entities.keyed_fields(producers, structure, variants))
    items = plan(entities.item_fields(structure, variants.withColumnRenamed("family", "host")))
    assert "SortMergeJoin [ref" in items and items.count("Exchange") == 2
    bodies = plan(queries.order_bodies(spark, "/root/testdata/sf0.001"))
    assert bodies.count("SortMergeJoin") == 2 and "Broadcast" not in bodies


def test_bodies_are_read_whole(spark):
    wide = [{"id": k} for k in range(300)] + [{"id": "x", "last": True}]
    many = [{"row": [{"n": k} for k in range(150)]} for _ in range(150)] + [{"late": 1}]
    deep = "[" * 20_000 + '{"x":1,"x":"s"}' + "]" * 20_000
    bodies = [("wide", json.dumps(wide)), ("many", json.dumps(many)), ("deep", '{"a":' * 40 + "[1]" + "}" * 40), ("deeper", deep), ("digits", '{"":' + "9" * 5_000 + "}"), ("open", "[" * 20_000)]
    got = {(r.ref, r.container, r.field, r.type) for r in shape.containers(spark.createDataFrame(bodies, "ref string, text string")).collect()}
    assert {x[1:] for x in got if x[0] == "wide"} == {("body[]", "id", "any"), ("body[]", "last", "bool")}
    assert {x[1:] for x in got if x[0] == "many"} == {("body[]", "row", "items"), ("body[].row[]", "n", "integer"), ("body[]", "late", "integer")}
    assert len([x for x in got if x[0] == "deep"]) == 40 and ("deep", "body" + ".a" * 39, "a", "array") in got
    assert {x[1:] for x in got if x[0] == "deeper"} == {("body" + "[]" * 20_000, "x", "string")} and {x[1:] for x in got if x[0] == "digits"} == {("body", "", "number")}
    assert not [x for x in got if x[0] == "open"]
    for _, text_ in BODIES:
        if text_ and text_ != "{broken":
            assert shape.whole_shape(text_) == shape.walk(shape.parse_json(text_))[0]


def test_item_fields_of_many_orders(spark, tmp_path):
    """Of a customer's 250 orders only those after the 200th have a note, which so has two types."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    made = {
        "customer": "SELECT c AS c_custkey, 'c' || c AS c_name, 'S' AS c_mktsegment FROM range(1, 3) t(c)",
        "orders": "SELECT o AS o_orderkey, 1 + CAST(o > 250 AS BIGINT) AS o_custkey, 'O' AS o_orderstatus, 1.5::DOUBLE AS o_totalprice, CASE WHEN o <= 200 OR o > 250 THEN '1-URGENT' ELSE '2-HIGH' END AS o_orderpriority FROM range(1, 253) t(o)",
        "lineitem": "SELECT o AS l_orderkey, o AS l_partkey, 1::DOUBLE AS l_quantity, 2.5::DOUBLE AS l_extendedprice, 'N' AS l_returnflag FROM range(1, 253) t(o)",
    }
    for name, sql in made.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    found = con.execute(queries.ORACLE_SQL["item_fields"])
    columns = [d[0] for d in found.description]
    want = {tuple(r) for r in found.fetchall()}
    assert {tuple(r[c] for c in columns) for r in queries.item_fields(spark, str(tmp_path)).collect()} == want
    assert ("S", "body.orders[]", "note", "null", 1, 1, "2#response.body.orders[].note", 1) in want

"""Maintained templates against a fresh pass after every batch."""

import random

import pytest
from pyspark.sql import functions as F

from weftlens.operators import families
from weftlens.streaming.routes import Routes, follow_routes

@pytest.fixture(autouse=True)
def one_partition(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


SCHEMA = "method string, host string, segments array<string>"


def made(rng):
    word = lambda: rng.choice(["shop", "item", "list", "7a", "8b", "9c", "1", "2", "3", "4", "x-1", "y-2", "z-3", "a.css", "b.css", "c.css", ""])
    return (rng.choice(["GET", "POST"]), rng.choice(["a.test", "b.test"]), [word() for _ in range(rng.choice([0, 1, 2, 2, 3]))])


def plain(rows):
    return sorted((*r[:2], tuple(r[2]), *([r[3], tuple(r[4])] if len(r) > 3 else [])) for r in rows)


def test_equals_a_fresh_pass_after_each_batch(spark, tmp_path):
    rng = random.Random(12)
    routes, seen, states = Routes(spark, str(tmp_path)), [], []
    for version in range(8):
        batch = [made(rng) for _ in range(rng.choice([1, 2, 6, 15]))]
        seen += batch
        routes.apply(spark.createDataFrame(batch, SCHEMA), version)
        if version == 4:
            routes.apply(spark.createDataFrame(batch, SCHEMA), version)  # a batch that is repeated
        everything = spark.createDataFrame(seen, SCHEMA)
        fresh = families.route_templates(everything)
        got = routes.templates().cache()
        assert plain(got.select("method", "host", "segments", "template", "slots").collect()) == plain(fresh.collect())
        assert {(r.method, r.host, tuple(r.segments)): r.observations for r in got.collect()} == {(r.method, r.host, tuple(r.segments)): r["count"] for r in everything.groupBy("method", "host", "segments").count().collect()}
        states.append({tuple(r) for r in routes.families().collect()})
    # what was put in and not taken back since is what is there
    standing = set()
    for version in range(8):
        rows = [tuple(r)[:-1] for r in routes.changes().where(F.col("version") == version).collect()]
        standing -= {r[1:] for r in rows if r[0] == "retract"}
        standing |= {r[1:] for r in rows if r[0] == "assert"}
        assert standing == states[version]


def test_rewrites_follow_the_change(spark, tmp_path):
    routes = Routes(spark, str(tmp_path))
    path = lambda *s: ("GET", "a.test", list(s))
    routes.apply(spark.createDataFrame([path("dp", str(k), "x") for k in range(40)] + [path("s", "1a", "x"), path("s", "2b", "x")], SCHEMA), 0)
    routes.apply(spark.createDataFrame([path("dp", "7", "x")], SCHEMA), 1)
    assert routes.rewritten(1) == {"paths": 1, "groups": 0, "changes": 2}
    routes.apply(spark.createDataFrame([path("s", "3c", "x")], SCHEMA), 2)  # the third sibling moves two paths
    wrote = routes.rewritten(2)
    assert wrote["paths"] == 3 and wrote["changes"] == 3
    changes = {(r.change, r.template): r.paths for r in routes.changes().where("version = 2").collect()}
    assert changes == {("retract", "/s/1a/x"): 1, ("retract", "/s/2b/x"): 1, ("assert", "/s/{id}/x"): 3}


def test_follow(spark, tmp_path):
    rng = random.Random(3)
    seen = []
    for _ in range(2):
        batch = [made(rng) for _ in range(20)]
        seen += batch
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
        follow_routes(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/state").awaitTermination()
    got = Routes(spark, f"{tmp_path}/state/routes").templates()
    fresh = families.route_templates(spark.createDataFrame(seen, SCHEMA))
    assert plain(got.select("method", "host", "segments", "template", "slots").collect()) == plain(fresh.collect())

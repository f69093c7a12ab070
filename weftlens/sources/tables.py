"""Exchanges, paths, steps and values read from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def exchanges(spark: SparkSession, folder: str) -> DataFrame:
    """One HTTP exchange for each event: a session a user, a path of the event's type and its k."""
    return from_events(table(spark, folder, "events"))


def from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    t = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("u"), "user_id").alias("session"),
        F.col("event_id").alias("seq"),
        t.alias("t"),
        (t + 20_000_000).alias("end"),
        F.when(kind.isin("view", "click"), "GET").otherwise("POST").alias("method"),
        F.lit("app.test").alias("host"),
        F.array(kind, k).alias("segments"),
        k.alias("k"),
        F.when(kind == "error", 500).when(kind == "signup", 302).otherwise(200).alias("status"),
        F.when(kind == "click", "application/json").when(kind == "error", "text/plain").otherwise("text/html").alias("media"),
    )


def page_paths(spark: SparkSession, folder: str) -> DataFrame:
    """One GET for each page."""
    u = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", "url", F.lit("GET").alias("method"), url.canonical_host(u).alias("host"), url.path(u).alias("path"), url.query(u).alias("query"),
        url.segments(url.path(u)).alias("segments"), "html",
    )


def key_values(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the order tables as values seen at locations of request families: (value, family, side, part, pattern, ref)."""
    def seen(name, column, prefix, family, side, part, pattern, ref):
        value = F.concat(F.lit(prefix), F.lpad(F.col(column).cast("string"), 7, "0")) if prefix else F.col(column)
        return table(spark, folder, name).select(
            value.alias("value"), F.lit(family).alias("family"), F.lit(side).alias("side"), F.lit(part).alias("part"), F.lit(pattern).alias("pattern"), F.col(ref).cast("string").alias("ref")
        )

    parts = [
        seen("orders", "o_orderkey", "ORD", "list_orders", "response", "body", "orders[].id", "o_custkey"),
        seen("orders", "o_custkey", "CUS", "list_orders", "response", "body", "orders[].customer", "o_orderkey"),
        seen("lineitem", "l_orderkey", "ORD", "get_order", "request", "path", "1", "l_linenumber"),
        seen("lineitem", "l_partkey", "PRT", "get_order", "response", "body", "lines[].part", "l_orderkey"),
        seen("customer", "c_custkey", "CUS", "get_customer", "request", "path", "1", "c_nationkey"),
        seen("part", "p_partkey", "PRT", "get_part", "request", "query", "part", "p_size"),
        seen("orders", "o_custkey", "CUS", "orders_of_customer", "request", "query", "customer", "o_orderkey"),
        seen("lineitem", "l_orderkey", "ORD", "cancel_order", "request", "body", "order.id", "l_linenumber"),
        seen("lineitem", "l_partkey", "PRT", "part_stock", "request", "path", "2", "l_suppkey"),
        # values that say little
        seen("orders", "o_orderstatus", None, "list_orders", "request", "query", "status", "o_orderkey"),
        seen("lineitem", "l_linestatus", None, "get_order", "request", "query", "status", "l_orderkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def navigation(spark: SparkSession, folder: str) -> DataFrame:
    """The events as steps of page views: views are documents, clicks name the last view of their k as referer."""
    x = exchanges(spark, folder)
    kind = F.get("segments", F.lit(0))
    at = lambda what: F.concat(F.lit("https://app.test/"), what, F.lit("/"), F.col("k"))
    return x.select(
        "session", "seq", "t", at(kind).alias("url"), (kind == "view").alias("document"), F.lit(None).cast("string").alias("redirect_to"), F.when(kind == "click", at(F.lit("view"))).alias("referer"),
        F.when(F.length("k") == 1, "none").otherwise("same-origin").alias("site"), F.endswith("k", F.lit("3")).alias("user"), F.lit("navigate").alias("mode"),
    )


def places(stepped: DataFrame) -> DataFrame:
    """What the events' steps carry, by place: k in every path and response, and by kind in cookies, queries and headers."""
    kind = F.get("segments", F.lit(0))
    place = lambda side, part, pattern: F.struct(F.lit(side).alias("side"), F.lit(part).alias("part"), F.lit(pattern).alias("pattern"))
    some = F.array(
        place("response", "body", "id"), place("request", "path", "1"), F.when(kind == "signup", place("response", "set-cookie", "k")), F.when(kind == "purchase", place("request", "cookie", "k")),
        F.when(kind == "click", place("request", "query", "q")), F.when(kind == "error", place("request", "header", "X-K")),
    )
    return stepped.select("session", "pos", F.col("k").alias("value"), F.inline(F.filter(some, lambda x: x.isNotNull())))

"""Exchanges of a recording in canonical form, and the values they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import headers, text, url
from ..functions.shape import SCALARS

PAIRS = "array<struct<name:string,value:string>>"


def observations(exchanges: DataFrame) -> DataFrame:
    """One row an exchange: canonical request and response, without bodies' contents.

    A time of 0 means "not reached" in the log and becomes null; a request without a start has the time it was noted.
    """
    req, res = F.col("request"), F.col("response")
    given = lambda h: F.coalesce(h["headers"], F.array().cast(PAIRS))
    named = lambda h: F.array_sort(F.transform(given(h), lambda x: F.struct(text.canonical_header(x["name"]).alias("name"), x["value"].alias("value"))))
    u = req["url"]
    path = F.when(url.path(u) == "", "/").otherwise(url.path(u))
    return exchanges.select(
        F.col("session_id").alias("session"), "seq", F.concat_ws("#", "session_id", "id").alias("ref"),
        F.coalesce(F.nullif(F.col("timing.request_start"), F.lit(0)), F.col("started_at.t")).alias("t"),
        F.nullif(F.col("timing.response_start"), F.lit(0)).alias("answered"), F.nullif(F.col("timing.response_end"), F.lit(0)).alias("end"),
        F.upper(req["method"]).alias("method"), url.canonical_host(u).alias("host"), u.alias("url"), path.alias("path"), url.segments(path).alias("segments"),
        url.query_pairs(url.query(u)).alias("query"), named(req).alias("request_headers"), named(res).alias("response_headers"),
        headers.cookies(headers.header(given(req), "Cookie")).alias("cookies"), headers.set_cookies(given(res)).alias("set_cookies"),
        headers.request_kind(F.upper(req["method"]), given(req), given(res), res["status"]).alias("kind"), res["status"].alias("status"),
        text.media_type(headers.header(given(res), "Content-Type")).alias("media"), F.coalesce("error", F.lit("")).alias("error"),
    )


def body_references(exchanges: DataFrame) -> DataFrame:
    """(ref, side, sha256, size, content_type, content_encoding) of the bodies of exchanges; the type is the stored one, else the header's."""
    rows = None
    for side in ("request", "response"):
        message = F.col(side)
        given = F.coalesce(message["headers"], F.array().cast(PAIRS))
        kind = F.when(F.coalesce(message["body"]["content_type"], F.lit("")) != "", message["body"]["content_type"]).otherwise(headers.header(given, "Content-Type"))
        part = exchanges.where(F.coalesce(message["body"]["size"], F.lit(0)) > 0).select(
            F.concat_ws("#", "session_id", "id").alias("ref"), F.lit(side).alias("side"), message["body"]["sha256"].alias("sha256"), message["body"]["size"].alias("size"),
            kind.alias("content_type"), message["body"]["content_encoding"].alias("content_encoding"),
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def navigation_steps(observed: DataFrame) -> DataFrame:
    """What page views need of observations: (session, seq, t, url, document, redirect_to, referer, site, user, mode)."""
    asked = lambda name: headers.header(F.col("request_headers"), name)
    target = F.when(F.col("status").between(300, 399), headers.header(F.col("response_headers"), "Location"))
    return observed.select(
        "session", "seq", "t", url.without_fragment(F.col("url")).alias("url"), (F.col("kind") == "document").alias("document"), url.resolved(F.col("url"), F.nullif(target, F.lit(""))).alias("redirect_to"),
        url.usable_referer(asked("Referer")).alias("referer"), F.lower(asked("Sec-Fetch-Site")).alias("site"), (asked("Sec-Fetch-User") == "?1").alias("user"), asked("Sec-Fetch-Mode").alias("mode"),
    )


def query_shape(pairs: Column) -> Column:
    """Shape of query pairs: each name once, as a string, or a list where it repeats."""
    names = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["name"])))
    times = lambda n: F.size(F.filter(pairs, lambda p: p["name"] == n))
    one = F.transform(names, lambda n: F.concat(n, F.when(times(n) > 1, ":[string]").otherwise(":string")))
    return F.concat(F.lit("{"), F.array_join(one, ","), F.lit("}"))


def values(observed: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """(ref, side, part, path, pattern, type, value, low_information) of everything an exchange carries.

    scalars: (ref, side, scalars) of parsed bodies.  A header that only describes the transport carries nothing.
    """
    place = "array<struct<side:string,part:string,path:string,pattern:string,type:string,value:string>>"

    def listed(side: str, part: str, pairs: Column) -> Column:
        return F.transform(pairs, lambda p: F.struct(F.lit(side).alias("side"), F.lit(part).alias("part"), p["name"].alias("path"), p["name"].alias("pattern"), F.lit("string").alias("type"), p["value"].alias("value")))

    steps = F.transform(F.col("segments"), lambda s, i: F.struct(F.lit("request").alias("side"), F.lit("path").alias("part"), i.cast("string").alias("path"), i.cast("string").alias("pattern"), F.lit("string").alias("type"), s.alias("value")))
    bearing = lambda c: F.filter(c, lambda h: text.value_bearing_header(h["name"]))
    every = F.concat(
        steps.cast(place), listed("request", "query", F.col("query")).cast(place), listed("request", "header", bearing(F.col("request_headers"))).cast(place),
        listed("request", "cookie", F.col("cookies")).cast(place), listed("response", "header", bearing(F.col("response_headers"))).cast(place),
        listed("response", "set-cookie", F.col("set_cookies")).cast(place),
    )
    rows = observed.select("ref", F.inline(every))
    if scalars is not None:
        body = scalars.select("ref", "side", F.lit("body").alias("part"), F.inline(F.col("scalars").cast(SCALARS)))
        rows = rows.unionByName(body.select("ref", "side", "part", "path", "pattern", "type", "value"))
    return rows.where("value <> ''").withColumn("low_information", text.low_information(F.col("type"), F.col("value")))


def summary(observed: DataFrame, most: int = 10) -> DataFrame:
    """The hosts of a recording with most exchanges, their failures and documents: a report."""
    rows = observed.groupBy("host").agg(F.count("*").alias("exchanges"), F.count_if((F.col("error") != "") | (F.col("status") >= 400)).alias("failures"), F.count_if(F.col("kind") == "document").alias("documents"))
    return rows.orderBy(F.desc("exchanges"), "host").limit(most)

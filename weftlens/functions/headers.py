"""Headers, cookies, and what a request was for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import media_type


def header(headers: Column, name: str) -> Column:
    """Value of the first header of this name, any case; empty if there is none."""
    same = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.get(same, F.lit(0))["value"], F.lit(""))


def _pair(text: Column) -> Column:
    cut = F.instr(text, "=")
    return F.struct(F.trim(F.when(cut > 0, F.substr(text, F.lit(1), cut - 1)).otherwise(text)).alias("name"), F.trim(F.when(cut > 0, F.substr(text, cut + 1)).otherwise("")).alias("value"))


def cookies(value: Column) -> Column:
    """(name, value) pairs of a Cookie header, sorted."""
    parts = F.filter(F.transform(F.split(value, ";", -1), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("=")))
    return F.array_sort(F.transform(parts, _pair))


def set_cookies(headers: Column) -> Column:
    """(name, value) of every Set-Cookie header; attributes are left out."""
    mine = F.filter(headers, lambda h: F.lower(h["name"]) == "set-cookie")
    return F.array_sort(F.transform(mine, lambda h: _pair(F.substring_index(h["value"], ";", 1))))


def prefers_html(accept: Column) -> Column:
    """Whether HTML has the highest quality in an Accept header; of equals the earlier counts."""
    quality = lambda x: F.coalesce(F.regexp_extract(x, r";\s*q=([0-9.]+)", 1).try_cast("double"), F.lit(1.0))
    rated = F.transform(F.split(accept, ","), lambda x, i: F.struct((-quality(x)).alias("q"), i.alias("i"), F.lower(F.trim(F.substring_index(x, ";", 1))).alias("m")))
    return F.get(F.array_sort(rated), F.lit(0))["m"].isin("text/html", "application/xhtml+xml")


def request_kind(method: Column, request_headers: Column, response_headers: Column, status: Column) -> Column:
    """document, fetch, websocket or the destination the browser named; a GET for HTML without such headers is a document."""
    dest, mode = F.lower(header(request_headers, "Sec-Fetch-Dest")), F.lower(header(request_headers, "Sec-Fetch-Mode"))
    redirect = status.between(300, 399) & (header(response_headers, "Location") != "")
    html = media_type(header(response_headers, "Content-Type")).isin("text/html", "application/xhtml+xml")
    looks = (mode == "") & (method == "GET") & prefers_html(header(request_headers, "Accept")) & (redirect | html)
    return (
        F.when((dest == "document") & (mode == "navigate"), "document")
        .when((dest == "empty") & (mode == "websocket"), "websocket")
        .when(dest == "empty", "fetch")
        .when(dest != "", dest)
        .when(looks, "document")
        .otherwise("")
    )

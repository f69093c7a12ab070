"""HTTP archives without credentials, session material and personal identifiers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote_plus, unquote_plus, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import har, url

REDACTED = "REDACTED"


@dataclass(frozen=True)
class Config:
    """What is redacted (fixed values): names in lower case, and fragments of names."""

    headers: tuple[str, ...] = (
        "cookie", "set-cookie", "authorization", "proxy-authorization", "x-api-key", "api-key", "x-auth-token", "x-access-token", "x-csrf-token", "x-xsrf-token",
        "csrf-token", "x-wp-nonce", "x-amz-security-token", "x-client-data", "x-browser-validation",
    )
    headers_with: tuple[str, ...] = ("token", "secret", "session", "apikey", "api-key")
    params: tuple[str, ...] = (
        "key", "api_key", "apikey", "access_token", "refresh_token", "id_token", "token", "auth", "password", "passwd", "secret", "signature", "sig", "session",
        "sessionid", "session_id", "sid", "csrf", "_csrf", "xsrf", "nonce", "_wpnonce", "code", "state", "email", "phone", "uid", "user_id", "userid", "cid",
        "client_id", "_ga", "_gid", "ui", "uifp", "sd", "visitor_id", "device_id",
    )
    params_with: tuple[str, ...] = ("token", "secret", "password", "session", "apikey", "api_key")
    fields: tuple[str, ...] = (
        "password", "passwd", "secret", "token", "access_token", "refresh_token", "id_token", "api_key", "apikey", "authorization", "session", "sessionid",
        "session_id", "csrf", "csrf_token", "nonce", "email", "phone", "credit_card", "card_number", "cvv", "ssn", "uid", "user_id", "userid", "visitor_id",
        "device_id", "ui", "uifp", "sd",
    )
    fields_with: tuple[str, ...] = ("password", "secret", "token")
    strip_bodies: tuple[str, ...] = ()
    drop_classes: tuple[str, ...] = ()
    trim_initiators: bool = False


def _named(name: str, exact: tuple[str, ...], parts: tuple[str, ...]) -> bool:
    low = name.lower()
    return low in exact or any(p in low for p in parts)


def sanitized_query(query: Column, config: Config = Config()) -> Column:
    """A query string with the values of sensitive names redacted; order, other values and empty ones stay as they are."""
    name = lambda x: F.lower(url.decoded(F.substring_index(x, "=", 1)))
    secret = lambda x: name(x).isin(*config.params) | name(x).rlike("|".join(re.escape(p) for p in config.params_with) or r"\b\B")
    swap = lambda x: F.when(F.contains(x, F.lit("=")) & secret(x), F.concat(F.substring_index(x, "=", 1), F.lit(f"={REDACTED}"))).otherwise(x)
    return F.array_join(F.transform(F.split(query, "&", -1), swap), "&")


def unsanitized(entries: DataFrame) -> DataFrame:
    """(file, sequence, found): what credentials entries (file, sequence, cookies, request_headers, response_headers) still show; none: clean."""
    risky = lambda h: F.lower(h["name"]).isin("cookie", "set-cookie", "authorization", "proxy-authorization") & ~h["value"].isin(REDACTED, "")
    said = lambda where, hs: F.transform(F.filter(F.coalesce(hs, F.array().cast("array<struct<name:string,value:string>>")), risky), lambda h: F.concat(F.lit(f"{where} header "), h["name"]))
    jar = F.filter(F.array(F.when(F.col("cookies") > 0, F.format_string("%d cookie(s)", "cookies"))), lambda x: x.isNotNull())
    found = F.concat(jar, said("request", F.col("request_headers")), said("response", F.col("response_headers")))
    return entries.select("file", "sequence", F.explode(found).alias("found"))


#: Stands before a number while it is text; no document may hold it.
_MARK = "\x00number\x00"


class _Number(str):
    """A number as it is written, so that no digit of it changes."""


def _refused(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def _loads(text: str) -> Any:
    if _MARK in text or "\\u0000number\\u0000" in text:
        raise ValueError("a document with the mark of numbers")
    return json.loads(text, parse_int=lambda t: _Number(_MARK + t), parse_float=lambda t: _Number(_MARK + t), parse_constant=_refused)


def _dumps(value: Any, **how: Any) -> str:
    return re.sub(r'"\\u0000number\\u0000([-+.0-9eE]+)"', r"\1", json.dumps(value, ensure_ascii=False, **how))


class _Entry:
    """Redacts one parsed entry in place, and counts what it changed."""

    def __init__(self, config: Config):
        self.config, self.counts = config, dict.fromkeys(("headers", "cookies", "params", "body_fields", "stripped"), 0)

    def named_value(self, name: str, value: Any) -> Any:
        """A value of a list of names and values: redacted by its name, else cleaned inside where it is JSON, as it is or encoded."""
        if _named(name, self.config.params, self.config.params_with):
            self.counts["params"] += value != REDACTED
            return REDACTED
        if not isinstance(value, str):
            return value
        plain = unquote_plus(value)
        if plain.lstrip()[:1] not in ("{", "["):
            return value
        clean = self.body(plain, "application/json")
        if clean == plain:
            return value
        self.counts["params"] += 1
        return clean if plain == value else quote_plus(clean)

    def query(self, raw: str) -> str:
        out = []
        for part in raw.split("&"):
            key, has, value = part.partition("=")
            if has and value != REDACTED:
                if _named(unquote_plus(key), self.config.params, self.config.params_with):
                    part = f"{key}={REDACTED}"
                    self.counts["params"] += 1
                elif (plain := unquote_plus(value)).lstrip()[:1] in ("{", "["):
                    clean = self.body(plain, "application/json")
                    if clean != plain:
                        part = f"{key}={quote_plus(clean)}"
                        self.counts["params"] += 1
            out.append(part)
        return "&".join(out)

    def url(self, raw: str) -> str:
        try:
            parts = urlsplit(raw)
        except ValueError:
            return raw
        query = self.query(parts.query) if parts.query else ""
        host = parts.netloc.rpartition("@")[2]
        return raw if (query, host) == (parts.query, parts.netloc) else urlunsplit((parts.scheme, host, parts.path, query, parts.fragment))

    def headers(self, message: dict[str, Any]) -> None:
        for h in message.get("headers") or []:
            name, value = h.get("name") or "", h.get("value") or ""
            if _named(name, self.config.headers, self.config.headers_with):
                self.counts["headers"] += value != REDACTED
                h["value"] = REDACTED
            elif name.lower() in ("referer", "location") or name == ":path":
                h["value"] = self.url(value)
        self.counts["cookies"] += len(message.get("cookies") or [])
        if "cookies" in message:
            message["cookies"] = []

    def value(self, v: Any, secret: bool = False) -> Any:
        """A JSON value; under a secret name every scalar becomes an empty one of its type, so that the body keeps its shape."""
        if isinstance(v, dict):
            return {k: self.value(x, secret or _named(k, self.config.fields, self.config.fields_with)) for k, x in v.items()}
        if isinstance(v, list):
            return [self.value(x, secret) for x in v]
        empty = v if v is None or not secret else False if isinstance(v, bool) else _Number(_MARK + "0") if isinstance(v, _Number) else REDACTED
        self.counts["body_fields"] += empty != v
        return empty

    def body(self, body: str, mime: str) -> str:
        mime = mime.lower()
        wrapped = re.fullmatch(r"(\s*[\w.$]+\s*(?:\(|=)\s*)([\[{].*[\]}])(\s*\)?;?\s*)", body, re.S)
        if wrapped and "javascript" in mime:
            return wrapped[1] + self.body(wrapped[2], "application/json") + wrapped[3]
        if "json" in mime or body.lstrip()[:1] in ("{", "["):
            before = self.counts["body_fields"]
            try:
                clean = self.value(_loads(body))
            except (ValueError, RecursionError):
                return body
            return body if self.counts["body_fields"] == before else _dumps(clean, separators=(",", ":"))
        return self.query(body) if "x-www-form-urlencoded" in mime else body

    def run(self, entry: dict[str, Any], strip: bool) -> dict[str, Any]:
        request, response = entry.get("request") or {}, entry.get("response") or {}
        if self.config.trim_initiators and isinstance(entry.get("_initiator"), dict):
            entry["_initiator"].pop("stack", None)
        self.headers(request)
        self.headers(response)
        if request.get("url"):
            request["url"] = self.url(request["url"])
        post = request.get("postData") or {}
        for p in [*(request.get("queryString") or []), *(post.get("params") or [])]:
            if "value" in p:
                p["value"] = self.named_value(p.get("name") or "", p["value"])
        if post.get("text"):
            post["text"] = self.body(post["text"], post.get("mimeType") or "")
        if response.get("redirectURL"):
            response["redirectURL"] = self.url(response["redirectURL"])
        content = response.get("content") or {}
        if content.get("text") and strip:
            content.pop("text")
            content.pop("encoding", None)
            content["comment"] = "body removed"
            self.counts["stripped"] += 1
        elif content.get("text") and (content.get("encoding") or "").lower() != "base64":
            content["text"] = self.body(content["text"], content.get("mimeType") or "")
        return entry


COUNTS = ("headers", "cookies", "params", "body_fields", "stripped")


def sanitize_entries(entries: DataFrame, config: Config = Config()) -> DataFrame:
    """(file, sequence, entry, counts of what was redacted) of archive entries (file, sequence, entry as JSON), without dropped classes.

    Fields that aren't known are kept.  Binary bodies are left as they are; redacted values keep their types.
    """
    field = lambda path: F.coalesce(F.get_json_object("entry", path), F.lit(""))
    address = field("$.request.url")
    cls = har.entry_class(url.canonical_host(address), url.path(address), field("$._resourceType"), field("$.response.content.mimeType"))
    rows = entries.select("file", "sequence", "entry", cls.alias("_class"))
    if config.drop_classes:
        rows = rows.where(~F.col("_class").isin(*config.drop_classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):
                batch = whole.slice(k, 64)
                out, counts = [], []
                for text, kind in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    one = _Entry(config)
                    out.append(_dumps(one.run(_loads(text), kind in config.strip_bodies)))
                    counts.append(one.counts)
                sums = [pa.array([c[n] for c in counts], pa.int64()) for n in COUNTS]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), *sums], ["file", "sequence", "entry", *COUNTS])

    return rows.mapInArrow(run, "file string, sequence int, entry string, " + ", ".join(f"{c} long" for c in COUNTS))


def write_archives(entries: DataFrame, folder: str) -> None:
    """Writes entries (file, sequence, entry) as one archive a file: a document holds its entries in order, as it did when it was read.

    An archive's folder is named by its file, path and all, escaped one to one, so that no two files share one.
    """
    listed = entries.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("sequence", "entry"))).alias("e"))
    text = F.concat(F.lit('{"log": {"version": "1.2", "entries": ['), F.array_join(F.transform("e", lambda x: x["entry"]), ", "), F.lit("]}}"))
    listed.select(text.alias("value"), F.url_encode("file").alias("archive")).write.mode("overwrite").partitionBy("archive").text(folder)

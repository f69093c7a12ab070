"""Classes of requests in an HTTP archive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import media_type

#: Hosts and paths of measuring services (fixed values).
TELEMETRY_HOSTS = (
    "google-analytics.com", "analytics.google.com", "googletagmanager.com", "doubleclick.net", "googlesyndication.com", "nr-data.net", "hotjar.com",
    "segment.io", "segment.com", "mixpanel.com", "amplitude.com", "facebook.net", "clarity.ms", "sentry.io", "trc-events.taboola.com",
    "il-trc-events.taboola.com", "beacon.taboola.com", "cds.taboola.com", "jnn-pa.googleapis.com", "csp.withgoogle.com",
)
TELEMETRY_PATHS = ("/collect", "/cdn-cgi/rum", "/beacon", "/pixel", "/track", "/recaptcha")
RESOURCE_CLASSES = {
    "document": "document", "xhr": "api", "fetch": "api", "script": "script", "stylesheet": "stylesheet", "image": "media", "media": "media",
    "font": "font", "ping": "telemetry", "beacon": "telemetry", "csp_violation_report": "telemetry",
}
EXTENSION_CLASSES = {
    "html": "document", "htm": "document", "json": "api", "js": "script", "mjs": "script", "css": "stylesheet", "png": "media", "jpg": "media",
    "jpeg": "media", "gif": "media", "webp": "media", "svg": "media", "ico": "media", "avif": "media", "mp4": "media", "webm": "media", "mp3": "media",
    "woff": "font", "woff2": "font", "ttf": "font", "otf": "font", "eot": "font",
}


def _choice(value: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for cls in dict.fromkeys(table.values()):
        out = F.when(value.isin([k for k, v in table.items() if v == cls]), cls).otherwise(out)
    return out


def is_telemetry(host: Column, path: Column) -> Column:
    dotted = lambda names: "|".join(re.escape(n) for n in names)
    bare = F.regexp_replace(host, r":[^:]*\z", "")
    return bare.rlike(rf"(^|\.)({dotted(TELEMETRY_HOSTS)})\z") | F.lower(path).rlike(rf"({dotted(TELEMETRY_PATHS)})(/|\z)")


def mime_class(mime: Column) -> Column:
    m = media_type(mime)
    return (
        F.when(m.isin("text/html", "application/xhtml+xml"), "document")
        .when(m.contains("json") | m.endswith("+xml") | m.isin("application/xml", "text/xml"), "api")
        .when(m.contains("javascript") | m.contains("ecmascript"), "script")
        .when(m == "text/css", "stylesheet")
        .when(m.rlike("^(image|video|audio)/"), "media")
        .when(m.contains("font"), "font")
    )


def entry_class(host: Column, path: Column, resource_type: Column, mime: Column) -> Column:
    """Class of an archive entry: telemetry, then the browser's own type, then media type, then file extension."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))
    rest = F.coalesce(_choice(resource_type, RESOURCE_CLASSES), mime_class(mime), _choice(extension, EXTENSION_CLASSES), F.lit("unknown"))
    return F.when(is_telemetry(host, path), "telemetry").otherwise(rest)

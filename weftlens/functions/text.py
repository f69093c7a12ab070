"""Predicates and classes of values, headers, media types and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values and names that must be as they are for right results (fixed values).
PLACEHOLDERS = ("true", "false", "null", "none", "yes", "no", "undefined", "default", "unknown")
MEDIA_FAMILIES = ("application", "text", "image", "audio", "video", "font", "multipart", "message", "model")
STATIC_MEDIA = (
    "text/css", "text/javascript", "application/javascript", "application/x-javascript", "application/font-woff",
    "application/font-woff2", "application/vnd.ms-fontobject", "application/x-font-ttf",
)
TRANSPORT_HEADERS = (
    "Accept", "Accept-Charset", "Accept-Encoding", "Accept-Language", "Accept-Ranges", "Age", "Alt-Svc", "Cache-Control", "Connection", "Content-Encoding",
    "Content-Length", "Content-Type", "Cookie", "Date", "Dnt", "Dpr", "Downlink", "Ect", "Expires", "Host", "Keep-Alive", "Last-Modified", "Nel", "Origin",
    "Permissions-Policy", "Pragma", "Priority", "Referer", "Referrer-Policy", "Report-To", "Rtt", "Save-Data", "Server", "Set-Cookie", "Strict-Transport-Security",
    "Te", "Timing-Allow-Origin", "Transfer-Encoding", "Upgrade-Insecure-Requests", "User-Agent", "Vary", "Via", "Viewport-Width", "X-Content-Type-Options",
    "X-Frame-Options", "X-Xss-Protection",
)
SECRET_NAMES = ("auth", "token", "csrf", "xsrf", "session", "secret", "password", "passwd", "apikey", "api-key", "api_key", "signature", "credential", "cookie")
EMAIL = r"[A-Za-z0-9._%+-]+(@|%40|%2540)[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def body_kind(media: Column) -> Column:
    """How a body of this media type is read."""
    json = media.isin("application/json", "text/json") | media.endswith("+json")
    form, multipart = media == "application/x-www-form-urlencoded", media.startswith("multipart/")
    return F.when(json, "json").when(form, "form").when(multipart, "multipart").otherwise("opaque")


def static_media(media: Column) -> Column:
    return media.rlike(r"^(image|font|audio|video)/") | media.isin(*STATIC_MEDIA)


def media_type_like(value: Column) -> Column:
    return value.rlike(rf"^({'|'.join(MEDIA_FAMILIES)})/[^/ \t]+\z")


def low_information(type_: Column, value: Column) -> Column:
    """Whether a value's recurrence says little: flags, numbers of up to three digits, short or stock words."""
    number = F.octet_length(F.regexp_replace(value, r"^[-+]+", "")) <= 3
    text = (F.octet_length(value) < 4) | media_type_like(value) | F.lower(value).isin(*PLACEHOLDERS)
    return F.when(type_.isin("bool", "null"), True).when(type_.isin("integer", "number"), number).otherwise(text)


def value_bearing_header(name: Column) -> Column:
    return ~(name.isin(*TRANSPORT_HEADERS) | name.rlike("^(Sec-|Access-Control-|Content-Security-Policy)"))


def canonical_header(name: Column) -> Column:
    words = F.transform(F.split(F.lower(name), "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substr(w, F.lit(2))))
    return F.when(name.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+\z"), F.array_join(words, "-")).otherwise(name)


def size_class(n: Column) -> Column:
    """Size in powers of sixteen from 1 KiB (fixed values)."""
    out = F.when(n <= 0, "empty")
    for name, below in (("tiny", 1 << 10), ("small", 1 << 14), ("medium", 1 << 18), ("large", 1 << 22)):
        out = out.when(n < below, name)
    return out.otherwise("huge")


def tokens(text: Column) -> Column:
    """Distinct runs of letters, digits, _ and -, in the order of first sight."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_-]+"), F.lit(0)))


def id_like(value: Column) -> Column:
    return (F.octet_length(value) >= 6) & ~value.rlike(r"[ \t\n]") & value.rlike(r"\p{L}") & value.rlike(r"\p{Nd}")


def char_mask(value: Column) -> Column:
    """1 for upper-case, 2 for lower-case letters, 4 for digits, 8 for any other character."""
    bit = lambda pattern, n: F.when(value.rlike(pattern), n).otherwise(0)
    return bit("[A-Z]", 1) + bit("[a-z]", 2) + bit("[0-9]", 4) + bit("[^A-Za-z0-9]", 8)


def secret_location(part: Column, name: Column) -> Column:
    named = F.lower(name).rlike("|".join(n.replace("-", r"\-") for n in SECRET_NAMES))
    return part.isin("cookie", "set-cookie") | (part.isin("header", "query", "body") & named)


def redact_patterns(text: Column) -> Column:
    """Tokens and mail addresses replaced by plain tags."""
    return F.regexp_replace(F.regexp_replace(text, JWT, "{{redacted:jwt}}"), EMAIL, "{{redacted:email}}")


def singular(name: Column) -> Column:
    """English singular of a collection's name, by its ending."""
    return (
        F.when(name.rlike(r"ies\z") & (F.length(name) > 4), F.regexp_replace(name, r"ies\z", "y"))
        .when(name.rlike(r"(ses|xes)\z"), F.regexp_replace(name, r"es\z", ""))
        .when(name.rlike(r"(?<!s)s\z") & (F.length(name) > 3), F.regexp_replace(name, r"s\z", ""))
        .otherwise(name)
    )


def last_name(pattern: Column) -> Column:
    """The last key of a pattern such as events[].data.id, without the mark of an array."""
    return F.regexp_replace(F.substring_index(pattern, ".", -1), r"(\[\]){0,2}\z", "")


#: Answers that stand for no name (fixed values).
NO_NAMES = ("unknown", "not_an_object")


def clean_name(name: Column) -> Column:
    """A name of letters, digits and underscores that begins with a letter; null if less than two or more than forty are left, or it stands for none."""
    kept = F.regexp_replace(name, r"[^A-Za-z0-9_-]", "")
    kept = F.regexp_replace(F.regexp_replace(kept, r"^[^A-Za-z]+", ""), "-", "_")
    kept = F.regexp_replace(kept, r"_+\z", "")
    return F.when(F.length(kept).between(2, 40) & ~kept.isin(*NO_NAMES) & ~F.contains(kept, F.lit("redacted")), kept)


def quantisation(path: Column) -> Column:
    """The part of a model file's name that says how its numbers are stored, as Q4_K_M in a-4B-Q4_K_M.gguf; empty without one."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*\z", "")
    parts = F.filter(F.split(name, "[-.]"), lambda p: F.upper(p).rlike(r"^(Q[0-9].*|F16|BF16|F32)\z"))
    return F.coalesce(F.get(F.reverse(parts), F.lit(0)), F.lit(""))


def clipped(text: Column, most: int) -> Column:
    """The first characters of a text that take no more than `most` bytes of UTF-8."""
    part = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(part, "\uFFFD+\\z", ""))


def clean_list(values: Column) -> Column:
    """A list in canonical form: sorted, once each, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(values)))

"""URLs and paths as column expressions."""

from __future__ import annotations

from urllib.parse import urldefrag, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?"

#: Query keys that only defeat caches (fixed values).
VOLATILE_KEYS = ("_", "_t", "cb", "cachebust", "cachebuster", "nocache", "rnd", "rand", "random", "timestamp", "ts")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _PARTS, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def canonical_host(url: Column) -> Column:
    """Lower-case host without user, trailing dot or the scheme's default port."""
    host = F.lower(F.regexp_replace(authority(url), r"^[^@]*@", ""))
    secure, plain = scheme(url).isin("https", "wss"), scheme(url).isin("http", "ws")
    host = F.when(secure, F.regexp_replace(host, r":443\z", "")).when(plain, F.regexp_replace(host, r":80\z", "")).otherwise(host)
    return F.regexp_replace(host, r"\.(?=:|\z)", "")


def segments(path_: Column) -> Column:
    """Path segments; "" and "/" have none, a trailing slash gives a last empty one."""
    return F.when(path_.isin("", "/"), F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(path_, "^/", ""), "/", -1))


def decoded(text: Column) -> Column:
    """Percent-decoded text, or the text itself where it can't be decoded."""
    return F.coalesce(F.try_url_decode(text), text)


def query_pairs(query_: Column) -> Column:
    """(name, value) of a query, decoded and sorted; repeats stay."""
    parts = F.filter(F.split(query_, "&", -1), lambda x: x != "")
    pair = lambda x: F.struct(decoded(F.substring_index(x, "=", 1)).alias("name"), decoded(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("value"))
    return F.array_sort(F.transform(parts, pair))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def usable_referer(url: Column) -> Column:
    """The referer without fragment, or null if it names an origin only."""
    bare = without_fragment(url)
    return F.when((~path(bare).isin("", "/")) | (query(bare) != ""), bare)


def stable_url(url: Column, volatile: tuple[str, ...] = VOLATILE_KEYS) -> Column:
    """Lower-case scheme and host, no default port, user or fragment, no volatile keys, query sorted by key."""
    parts = F.filter(F.split(query(url), "&", -1), lambda x: (x != "") & ~F.substring_index(x, "=", 1).isin(*volatile))
    keyed = F.transform(parts, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))).alias("x")))
    sorted_ = F.array_join(F.transform(F.array_sort(keyed), lambda p: p["x"]), "&")
    base = F.concat(scheme(url), F.lit("://"), canonical_host(url), F.when(path(url) == "", "/").otherwise(path(url)))
    return F.when(sorted_ == "", base).otherwise(F.concat(base, F.lit("?"), sorted_))


def segment_class(segment: Column) -> Column:
    """Character class of a path segment; a file name is classed by its extension."""
    extension = F.regexp_extract(segment, r"^[^/]+\.([0-9A-Za-z]{1,5})\z", 1)
    return (
        F.when(segment == "", "empty")
        .when(segment.rlike(r"^[0-9]+\z"), "int")
        .when(segment.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"), "uuid")
        .when(segment.rlike(r"^[A-Za-z]+\z"), "word")
        .when(segment.rlike(r"^[0-9A-Za-z]+\z"), "id")
        .when(segment.rlike(r"^[0-9A-Za-z]+([-_][0-9A-Za-z]+)+\z"), "slug")
        .when(extension != "", F.concat(F.lit("file:"), F.lower(extension)))
        .otherwise("other")
    )


def slottable(class_: Column) -> Column:
    """Words name routes and an empty segment is structure; every other class may become a slot."""
    return ~class_.isin("word", "empty")


def own_host(host: Column, hosts: list[str]) -> Column:
    """Whether a host is one of `hosts` or below it; no hosts keep all."""
    if not hosts:
        return F.lit(True)
    out = F.lit(False)
    for h in hosts:
        h = h.lower().rstrip(".")
        out = out | (F.lower(host) == h) | F.lower(host).endswith(f".{h}")
    return out


def answer_url(url: Column) -> Column:
    """A url as answers are compared by: lower-case scheme and host, no fragment, no slashes at the end of the path."""
    bare = without_fragment(F.trim(url))
    start = F.regexp_extract(bare, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?]*)?)", 1)
    rest = F.substr(bare, F.length(start) + 1)
    ends = F.regexp_replace(F.substring_index(rest, "?", 1), r"/+\z", "")
    return F.concat(F.lower(start), ends, F.when(F.contains(rest, F.lit("?")), F.concat(F.lit("?"), F.regexp_replace(rest, r"^[^?]*\?", ""))).otherwise(""))


def _resolve(base: str | None, location: str | None) -> str | None:
    if not base or not location:
        return None
    try:
        return urldefrag(urljoin(base, location)).url
    except ValueError:
        return None


def resolved(base: Column, location: Column) -> Column:
    """The absolute url, without fragment, that a Location header means; null if either can't be read or is empty."""
    return F.udf(_resolve, StringType(), useArrow=True)(base, location)


def numbered_names(pairs: Column) -> Column:
    """Names of query pairs, where repeats of a name are name[1], name[2] and so on."""
    names = F.transform(pairs, lambda p: p["name"])
    before = lambda name, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda n: n == name))
    return F.transform(names, lambda n, i: F.when(before(n, i) == 0, n).otherwise(F.concat(n, F.lit("["), before(n, i).cast("string"), F.lit("]"))))


def safe_tree_path(path_: Column) -> Column:
    """A path inside a tree, without leading slashes, double slashes and dots; "." for the tree itself, null if it leads out of it."""
    parts = F.filter(F.split(F.trim(path_), "/", -1), lambda x: ~x.isin("", "."))
    step = lambda s, x: F.struct(
        F.when((x == "..") & (F.size(s["kept"]) > 0), F.slice(s["kept"], F.lit(1), F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).when(x == "..", s["kept"]).otherwise(F.array_append(s["kept"], x)).alias("kept"),
        (s["out"] | ((x == "..") & (F.size(s["kept"]) == 0))).alias("out"),
    )
    end = F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("out")), step)
    return F.when(~end["out"], F.when(F.size(end["kept"]) == 0, ".").otherwise(F.array_join(end["kept"], "/")))

import pytest
from pyspark.sql import functions as F

from weftlens.functions import har, score, text, url


@pytest.fixture
def column(spark):
    def run(f, *values, kind="string"):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
        return [r[0] for r in rows.orderBy("k").select(f(F.col("v"))).collect()]

    return run


def test_segment_classes(column):
    pairs = {
        "": "empty", "12": "int", "search": "word", "B0abc12": "id", "a-b_c9": "slug", "123e4567-e89b-12d3-a456-426614174000": "uuid",
        "logo.PNG": "file:png", "a.b.js": "file:js", "x.toolong": "other", "a b": "other", "12\n": "other", "é": "other",
    }
    assert column(url.segment_class, *pairs) == list(pairs.values())


def test_urls(column):
    assert column(url.canonical_host, "HTTPS://u:p@Ex.Org.:443/x", "http://a:8080", "http://a:80?q", "http://[::1]:80/") == ["ex.org", "a:8080", "a", "[::1]"]
    assert column(lambda c: url.segments(url.path(c)), "http://a/b//c/?q=/z", "http://a", "http://a/") == [["b", "", "c", ""], [], []]
    assert column(lambda c: F.transform(url.query_pairs(c), lambda p: F.concat(p["name"], F.lit("|"), p["value"])), "b=2&a=1&b=%zz&c&a=x=y") == [["a|1", "a|x=y", "b|%zz", "b|2", "c|"]]
    assert column(url.stable_url, "HTTP://A.b:80?z=1&_=9&a=2&a=1#f", "https://a/x?ts=1") == ["http://a.b/?a=2&a=1&z=1", "https://a/x"]
    assert column(url.usable_referer, "http://a/#x", "http://a/p#x", "http://a?q") == [None, "http://a/p", "http://a?q"]
    assert column(lambda c: url.own_host(c, ["Example.com."]), "example.com", "a.EXAMPLE.com", "badexample.com") == [True, True, False]


def test_values(column):
    low = lambda kind: lambda c: text.low_information(F.lit(kind), c)
    assert column(low("integer"), "-123", "1234") == [True, False]
    assert column(low("string"), "abc", "abcd", "Undefined", "text/html", "text/a/b", "éé") == [True, False, True, True, False, False]
    assert column(low("bool"), "anything") == [True]
    assert column(text.media_type, " Text/HTML ; charset=x", None) == ["text/html", ""]
    assert column(text.body_kind, "application/ld+json", "text/plain", "multipart/form-data", "application/x-www-form-urlencoded") == ["json", "opaque", "multipart", "form"]
    assert column(text.canonical_header, "content-TYPE", "x-a", "bad name") == ["Content-Type", "X-A", "bad name"]
    assert column(text.value_bearing_header, "X-Id", "Sec-Fetch-Dest", "Accept") == [True, False, False]
    assert column(text.size_class, 0, 1023, 1024, 1 << 22, kind="long") == ["empty", "tiny", "small", "huge"]
    assert column(text.tokens, "a-b c a-b,d_e é") == [["a-b", "c", "d_e"]]
    assert column(text.id_like, "abc123", "abc 123", "abcdef", "a1") == [True, False, False, False]
    assert column(text.redact_patterns, "x a.b%40c.de y", "eyJabcdefgh.abcdefgh.abcdefgh") == ["x {{redacted:email}} y", "{{redacted:jwt}}"]
    assert column(lambda c: text.secret_location(F.lit("query"), c), "Access_TOKEN", "page") == [True, False]
    assert column(text.singular, "categories", "class", "items", "s") == ["category", "class", "item", "s"]


def test_archive_classes(spark):
    cases = [
        ("www.google-analytics.com:443", "/x", "document", "", "telemetry"), ("a", "/api/track/1", "xhr", "", "telemetry"), ("a", "/tracks", "xhr", "", "api"),
        ("a", "/x.js", "", "", "script"), ("a", "/x.js", "", "text/html", "document"), ("a", "/f.woff2", "", "", "font"), ("a", "/x", "", "image/svg+xml", "api"), ("a", "/x", "", "", "unknown"),
    ]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, h string, p string, r string, m string, want string")
    out = rows.orderBy("k").select(har.entry_class(F.col("h"), F.col("p"), F.col("r"), F.col("m")), "want").collect()
    assert [r[0] for r in out] == [r[1] for r in out]


def test_scores(spark):
    row = spark.sql("SELECT 2L AS a, 3L AS b, 0L AS z, 'Price $1,234.50' AS t").select(
        score.ratio(F.col("a"), F.col("b")), score.ratio(F.col("a"), F.col("z")), score.coverage(F.col("a"), F.col("b")), score.number(F.col("t"), True), score.plain_text(F.col("t"))
    ).first()
    assert tuple(row) == (0.667, 0.0, 0.666, 1234.5, "price $1,234.50")


def test_quantisation_names(column):
    assert column(text.quantisation, "/m/a-4B-Q4_K_M.gguf", "x.f16.bin", "plain.gguf", "Qwen-7b.gguf") == ["Q4_K_M", "f16", "", ""]

"""Redaction by a table of secrets, against a plain scan."""

import random
import re

from weftlens.functions import privacy
from weftlens.functions.text import EMAIL, JWT
from weftlens.operators import secrets

KEY = "k"


def plain(text, known):
    if not text or re.fullmatch(secrets.TAG, text):
        return text
    if text in known:
        return privacy.tag(known[text], text, KEY)
    inside = sorted((v for v in known if len(v.encode()) >= 16 and v in text), key=lambda v: (-len(v.encode()), v))
    if inside:
        text = re.sub("|".join(map(re.escape, inside)), lambda m: privacy.tag(known[m[0]], m[0], KEY), text)
    for label, pattern in (("jwt", JWT), ("email", EMAIL)):
        text = re.sub(pattern, lambda m: privacy.tag(label, m[0], KEY), text)
    return text


def check(spark, texts, known):
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "k long, text string, _row int").repartition(3)
    table = spark.createDataFrame(sorted(known.items()), "value string, label string")
    got = {r.k: r.text for r in secrets.redacted(rows, "text", table, KEY).collect()}
    assert got == {k: plain(t, known) for k, t in enumerate(texts)}


def test_many_secrets(spark):
    """20,000 secrets, many of which begin alike or hold one another, in texts in which some of them stand."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abé0") for _ in range(n))
    values = [word(rng.randint(4, 40)) for _ in range(12000)] + ["session-id=0000" + word(rng.randint(1, 30)) for _ in range(8000)]
    known = {v: f"cookie.c{k % 7}" for k, v in enumerate(values)}
    long = [v for v in known if len(v.encode()) >= 16]
    known |= {v[2:-2] + "zz": "query.q" for v in rng.sample(long, 300)} | {v + "tail": "body.b" for v in rng.sample(long, 300)}
    names = list(known)
    texts = [" ".join(rng.choice([word(9), rng.choice(names), rng.choice(names) + "tail" + rng.choice(names)]) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    texts += rng.sample(names, 30) + ["", None, "{{redacted:x:0123}}", "ab@example.org " + names[0]]
    check(spark, texts, known)


def test_leftmost_then_longest(spark):
    a, b, c = "A" * 16, "A" * 20, "AAAABBBBBBBBBBBBBBBBBB"
    known = {a: "header.a", b: "header.b", c: "header.c", "short": "cookie.s", "eyJabcdefghij.abcdefghij.abcdefghij-and-more": "cookie.j"}
    check(spark, ["x" + "A" * 40 + "y", "A" * 16 + "B" * 18, "short", "not short", "eyJabcdefghij.abcdefghij.abcdefghij-and-more", "z eyJabcdefghij.abcdefghij.abcdefghij z"], known)


def test_no_secrets_or_texts(spark):
    check(spark, ["who@example.org"], {"unused-unused-unused": "cookie.u"})
    rows = spark.createDataFrame([("who@example.org",)], "text string")
    none = spark.createDataFrame([], "value string, label string")
    assert secrets.redacted(rows, "text", none, KEY).first()[0].startswith("{{redacted:email:")
    assert secrets.redacted(rows.limit(0), "text", none, KEY).count() == 0

"""Lists compared item by item, against a plain scan."""

import random

from pyspark.sql import functions as F

from weftlens.functions import score


def scan(want, got, same):
    left = list(got)
    for w in want:
        k = next((i for i, g in enumerate(left) if same(w, g)), None)
        if k is None:
            return False
        del left[k]
    return not left


def test_first_fit_with_tolerance(spark):
    rng = random.Random(6)
    rows = [([float(rng.randint(0, 9)) for _ in range(n)], [float(rng.randint(0, 9)) for _ in range(n + rng.choice([0, 0, 0, 1]))]) for n in [rng.randint(0, 5) for _ in range(400)]]
    rows += [([2.0, 1.0], [3.0, 1.5]), ([1.0, 2.0], [2.0, 3.0]), ([2.0, 1.0], [2.0, 3.0]), ([None, 1.0], [1.0, None]), ([None], [1.0])]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, want array<double>, got array<double>")
    close = lambda w, g: F.abs(w - g) <= 1.0
    got = {r.k: (r.a, r.b) for r in df.select("k", score.first_fit(F.col("want"), F.col("got"), close).alias("a"), score.in_order(F.col("want"), F.col("got"), close).alias("b")).collect()}
    same = lambda w, g: (w is None and g is None) or (w is not None and g is not None and abs(w - g) <= 1.0)
    assert {k: v[0] for k, v in got.items()} == {k: scan(*r, same) for k, r in enumerate(rows)}
    assert {k: v[1] for k, v in got.items()} == {k: len(r[0]) == len(r[1]) and all(map(same, *r)) for k, r in enumerate(rows)}
    # the first item takes what the second needs; sorted lists would fit
    hard = next(k for k, r in enumerate(rows) if None not in r[0] and not scan(*r, same) and len(r[0]) == len(r[1]) and all(map(same, sorted(r[0]), sorted(r[1]))))
    assert got[hard][0] is False


def test_dates_and_currency(spark):
    df = spark.createDataFrame([(["2024-03-01", "2024-05-02"], ["May 2, 2024", "03/01/2024"], ["$1,200.50", "7 EUR"], [7.0, 1200.5])], "d array<string>, e array<string>, p array<string>, n array<double>")
    r = df.select(
        score.first_fit(F.col("d"), F.col("e"), lambda w, g: score.date(w) == score.date(g)).alias("days"),
        score.first_fit(F.col("n"), F.col("p"), lambda w, g: score.numbers_equal(w, score.number(g, currency=True))).alias("prices"),
    ).first()
    assert r.days and r.prices


def test_no_list(spark):
    df = spark.createDataFrame([(None, [1.0]), ([], [])], "want array<double>, got array<double>")
    assert [r.x for r in df.select(score.first_fit(F.col("want"), F.col("got"), lambda w, g: w == g).alias("x")).collect()] == [False, True]

"""Streams against the same operators over whole tables."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftlens.operators import traces
from weftlens.streaming import flows

S = 10**9
INPUT = "session string, seq long, t long, ended boolean, available long, url string, target string, given array<string>, asked array<string>"
BODY = "available long, url string, target string, given array<string>, asked array<string>"


def made(seed, sessions, n):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        t = rng.randint(1000, 1020) * S
        for k in range(n):
            t += rng.choice([0, 0, 1, 1, 2, 5, 40]) * S // 2
            takes = rng.choice([0, 0, 1, 3]) * S
            target = f"u{rng.randint(0, 3)}" if rng.random() < 0.3 else None
            rows.append((f"s{s}", k, t, False, t + takes, f"u{rng.randint(0, 3)}", target, rng.sample("abcd", rng.randint(0, 2)), rng.sample("abcd", rng.randint(0, 2))))
    return rows


def whole(spark, rows, within):
    df = spark.createDataFrame([r for r in rows if not r[3]], INPUT)
    s = df.withColumn("pos", F.row_number().over(traces.in_order()) - 1).withColumn("tied", F.coalesce(F.lag("t").over(traces.in_order()) == F.col("t"), F.lit(False)))
    sources = s.select("session", "pos", "t", "available", "tied", F.explode("given").alias("value"))
    asked = s.select("session", "pos", "t", F.explode("asked").alias("value"))
    ordered = [tuple(r) for r in s.select("session", "seq", "pos", "tied").collect()]
    return sorted(ordered), sorted(tuple(r) for r in traces.value_flows(sources, asked).collect()), sorted(tuple(r) for r in traces.redirect_flows(s, within).collect())


def streamed(spark, tmp, batches, values=True):
    """The rows of all three streams, run to the end after each batch; and the redirect states held after each."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    source, steps = f"{tmp}/in", f"{tmp}/steps"
    held = []
    for rows in batches:
        spark.createDataFrame(rows, INPUT).coalesce(1).write.mode("append").parquet(source)
        first = spark.readStream.schema(INPUT).parquet(source)
        flows.append(flows.ordered_steps(first), steps, f"{tmp}/c1").awaitTermination()
        if values:
            flows.append(flows.value_flow_stream(flows.read_steps(spark, steps, BODY)), f"{tmp}/values", f"{tmp}/c2").awaitTermination()
        q = flows.append(flows.redirect_flow_stream(flows.read_steps(spark, steps, BODY)), f"{tmp}/redirects", f"{tmp}/c3")
        q.awaitTermination()
        progress = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
        held.append(progress[-1] if progress else (held[-1] if held else 0))
    read = lambda name, *c: sorted(tuple(r) for r in spark.read.parquet(f"{tmp}/{name}").select(*c).collect())
    columns = ("session", "value", "from_pos", "to_pos", "delay")
    return read("steps", "session", "seq", "pos", "tied"), read("values", *columns) if values else [], read("redirects", *columns), held


@pytest.fixture(autouse=True)
def partitions(spark):
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stream_equals_table_in_any_batches(spark, tmp_path):
    rng = random.Random(7)
    rows = sorted(made(1, 5, 40), key=lambda r: r[2])
    # rows come up to five seconds late, and in batches of any size
    rows = [r for _, r in sorted(((r[2] + rng.randint(0, 4) * S, k), r) for k, r in enumerate(rows))]
    cuts = sorted(rng.sample(range(1, len(rows)), 2))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    last = max(r[2] for r in rows)
    batches.append([(f"s{s}", None, last, True, *[None] * 5) for s in range(5)])
    ordered, values, redirects, _ = streamed(spark, tmp_path, batches)
    want = whole(spark, rows, flows.REDIRECT_NS)
    assert ordered == want[0] and values == want[1] and redirects == want[2]
    assert values and redirects and any(r[3] for r in ordered)


def test_redirects_expire_and_state_shrinks(spark, tmp_path):
    step = lambda k, t, url, target=None: ("s", k, (1000 + t) * S, False, (1000 + t) * S + 1, url, target, [], [])
    first = [step(0, 0, "a", "x"), step(1, 1, "a", "y"), step(2, 2, "a", "z"), step(3, 3, "x")]
    second = [step(4, 25, "y"), step(5, 26, "y"), step(6, 60, "w")]
    third = [step(7, 61, "z"), step(8, 200, "q")]
    fourth = [("s", None, 1201 * S, True, *[None] * 5), ("other", 0, 1400 * S, False, 1400 * S + 1, "a", None, [], [])]
    _, _, redirects, held = streamed(spark, tmp_path, [first, second, third, fourth], values=False)
    # x at once, y after 24 s and once only, z too late
    assert [(r[1], r[3]) for r in redirects] == [("x", 3), ("y", 4)]
    assert redirects == whole(spark, first + second + third, flows.REDIRECT_NS)[2]
    assert max(held) >= 1 and held[-1] < max(held)


class Held:
    """A list state in memory that counts how often it is read and written."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, []

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = list(rows)

    def clear(self):
        self.calls += 1
        self.rows = []


@pytest.mark.parametrize("processor", [flows._LastSource(), flows._OpenRedirects(1000 * S)])
def test_calls_into_the_state_grow_with_sessions_not_with_values(processor):
    held = Held()
    processor.init(held)
    columns = ["value", "at", "reads", "t", "pos"]
    first = pd.DataFrame([(f"v{k}", k * S + 1, False, k * S, k) for k in range(500)], columns=columns)
    second = pd.DataFrame([(f"v{k}", (500 + k) * S, True, (500 + k) * S, 500 + k) for k in range(500)], columns=columns)
    out = [tuple(r) for part in (first, second) for rows in processor.handleInputRows(("s",), iter([part]), None) for r in rows.itertuples(index=False)]
    assert sorted(out) == sorted(("s", f"v{k}", k, 500 + k, 500 * S - 1) for k in range(500))
    assert held.calls <= 4

import math

import numpy as np
import pytest

from weftlens.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, least):
    units = []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in v] if v else [np.nan], float)
        ok = np.isfinite(x).all() and (x != 0).any()
        units.append(x / np.linalg.norm(x) if ok else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return [(d, n[i], low.get(find(i)), d is not None and d == low.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, rng.normal(size=16).tolist()) for i in range(150)]
    for i in range(150, 230):  # copies of a hot vector, tight and loose
        base = np.array(out[5][1])
        out.append((i, (base + rng.normal(size=16) * np.linalg.norm(base) / 4 * (0.05 if i % 3 else 0.45)).tolist()))
    for i in range(230, 260):
        base = np.array(out[i - 200][1])
        out.append((i, (3 * (base + rng.normal(size=16) * np.linalg.norm(base) / 4 * 0.3)).tolist()))
    out += [(300, None), (301, []), (302, [0.0] * 16), (303, [math.nan] + [1.0] * 15), (304, [None] + [1.0] * 15), (305, [math.inf] + [1.0] * 15)]
    out += [(306, [1.0, 2.0]), (307, [2.0, 4.1]), out[8], out[8], (None, out[9][1])]
    return [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in out]


@pytest.mark.parametrize("block", [1024, 8])
def test_links_against_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    out = vectors.near_vectors(frame, 0.9).collect()
    want = brute(rows, 0.9)
    assert len(out) == len(rows)
    by = lambda r: (r[0] is None, r[0] or 0, r[1])
    got, want = sorted(map(tuple, out), key=by), sorted(want, key=by)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert found <= all_ and found >= 0.97 * all_
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.97 * len(want)
    for r in out:
        assert r.kept == (r.vec_id is not None and r.vec_id == r.component_id)


def test_no_rows(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rare_lengths_are_linked(spark, monkeypatch):
    """Lengths of a few vectors among thousands of another length, beyond any one sample."""
    monkeypatch.setattr(vectors, "MOST_PIVOTS", 64)
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    rows += [(5000, [1.0, 2.0, 3.0]), (5001, [1.0, 2.0, 3.0]), (5002, [3.0, -2.0, 1.0]), (6000, [1.0]), (6001, [4.0]), (7000, [1.0] * 5)]
    out = {r.vec_id: tuple(r)[1:4] for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9).collect()}
    assert [out[i] for i in (5000, 5001, 5002, 6000, 6001, 7000)] == [
        (1, 5000, True), (1, 5000, False), (0, 5002, True), (1, 6000, True), (1, 6000, False), (0, 7000, True),
    ]


def test_recall_of_planted_pairs(spark):
    """10,000 vectors of 64 numbers, a thousand of them at a cosine of 0.90 to 0.93 to another: the hardest links."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(1000):
        side = rng.normal(size=64)
        side -= (side @ x[k]) * x[k]
        cos = rng.uniform(0.9001, 0.93)
        x[9000 + k] = cos * x[k] + math.sqrt(1 - cos * cos) * side / np.linalg.norm(side)
    want = np.triu(x @ x.T >= 0.9, 1).sum()
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    out = vectors.near_vectors(frame, 0.9).agg({"n_links": "sum"}).first()[0] / 2
    assert want >= 1000 and want >= out >= 0.97 * want


def test_the_table(spark):
    """The given embeddings hold no links at 0.9, so this shows only that none is made up."""
    from weftlens.llm.queries import op1_pivot_permutation, table

    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want = {r[0]: r for r in brute(rows, 0.9)}
    assert {r.vec_id: tuple(r)[:4] for r in op1_pivot_permutation(spark, sf).collect()} == want

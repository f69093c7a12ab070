import numpy as np
import pandas as pd

from weftlens.llm import neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, score int, rank int"


def usable(v):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def brute(rows, k=20, every=20):
    """For each query row: (query_id, scores of the k nearest), by a scan."""
    out = []
    rows = [r for r in rows if usable(r[1])]
    for at, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            others = [(-float(np.dot(v, w)), j is None, j or 0) for b, (j, w) in enumerate(rows) if b != at and len(w) == len(v)]
            out.append((i, [(-s, None if gone else j) for s, gone, j in sorted(others)[:k]]))
    return out


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)
    return neighbours.nearest_neighbours(df, k, every).collect()


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(60)] + [(200 + i, [1.0, 2.0, 3.0]) for i in range(5)] + [(100, [3.0, 0.0, 0.5]), (300, [7.0])]
    rows += [(400, None), (420, []), (440, [0.0] * 6), (460, [1.0, None, 0, 0, 0, 0]), (480, [float("nan")] + [1.0] * 5), (500, [float("inf")] * 6), (None, [1.0] * 6)]
    rows += [rows[0], rows[0], (41, rows[0][1])]  # repeated rows and ties
    got = run(spark, rows)
    want = sorted((i, r + 1, j, s) for i, near in brute(rows) for r, (s, j) in enumerate(near))
    assert [(g[0], g[1], g[2]) for g in sorted(got, key=str)] == [(w[0], w[1], w[2]) for w in sorted(want, key=str)]
    assert np.allclose([g.score for g in sorted(got, key=str)], [w[3] for w in sorted(want, key=str)], rtol=1e-12)


def test_recall_and_groups_of_copies(spark):
    """Random directions of different lengths, where nothing is near, and one group of near copies with a third of all rows."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12000, 48)) * rng.uniform(0.5, 2, (12000, 1))
    x[:4000] = x[0] + rng.normal(size=(4000, 48)) * 0.05
    order = rng.permutation(12000)
    ids = np.arange(12000)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": [v.tolist() for v in x[order]]})).repartition(4)
    got = neighbours.nearest_neighbours(df).collect()
    x = x[order]
    hits = total = 0
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 12000, 20))
    for i, near in found.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 21)) and all(abs(s - x[i] @ x[j]) < 1e-9 for _, j, s in near)
        assert [s for _, _, s in near] == sorted((s for _, _, s in near), reverse=True) and i not in [j for _, j, _ in near]
        scores = x @ x[i]
        scores[i] = -np.inf
        top = set(np.argpartition(-scores, 20)[:20].tolist())
        hits, total = hits + len(top & {j for _, j, _ in near}), total + 20
    assert hits / total >= 0.95


def test_counts_of_collisions():
    """Pairs with enough collisions are those that a plain count of the windows gives."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 10))
    rows = pd.DataFrame({"dim": 10, "blk": 0, "key": np.arange(700), "vec_id": np.arange(700), "embedding": list(x)})
    block = neighbours.Block(neighbours._index(rows).iloc[0])
    projected = rng.normal(size=(9, neighbours.PROJECTIONS)).astype(np.float32)
    lifted = np.column_stack([x / block.scale, np.sqrt(1 - ((x / block.scale) ** 2).sum(1).clip(max=1))])
    own = (neighbours._directions(10) @ lifted.T).astype(np.float32)
    step = -(-700 // neighbours.MARKS)
    for half in (0.4, 1.9, 2.4):
        count = np.zeros((9, 700), int)
        for j in range(neighbours.PROJECTIONS):
            rank = np.argsort(np.argsort(own[j], kind="stable"))
            for q in range(9):
                start = max(int(np.sum(block.marks[j] <= np.float32(projected[q, j] - np.float32(half)))) - 1, 0) * step
                end = int(np.sum(block.marks[j] <= np.float32(projected[q, j] + np.float32(half)))) * step
                count[q] += (rank >= start) & (rank < end)
        for last, enough in ((True, neighbours.ENOUGH), (False, neighbours.SURE)):
            q, v = block.colliding(projected, np.full(9, half, np.float32), np.full(9, last))
            assert set(zip(q.tolist(), v.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(count >= enough))))


def test_no_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == [] and run(spark, [(20, [1.0])]) == []
    assert [tuple(r) for r in run(spark, [(20, [1.0, 2.0]), (3, [2.0, 1.0])])] == [(20, 1, 3, 4.0)]

"""Near-duplicate vectors by a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import components, written

#: Pivots of a vector length at most; they come from a sample of at most four times as many vectors.
MOST_PIVOTS = 8192
#: No two pivots are this close, so that one group of copies doesn't fill the pivots.
PIVOTS_APART = 0.7
#: A vector is described by its nearest pivots, in order; candidates share at least two of them.
NEAREST, SHARED = 8, 2
#: Vectors of a list or ball that one task compares with as many others.
BLOCK = 1024
MARGIN = 1e-9


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a column of arrays, scaled to length 1, and their places; all must have one length."""
    where, rows = [], []
    for k, v in enumerate(column):
        if v is None or not len(v):
            continue
        x = np.array([np.nan if c is None else c for c in v] if not isinstance(v, np.ndarray) or v.dtype == object else v, np.float64)
        scale = np.abs(x).max()
        if np.isfinite(scale) and scale > 0:
            x = x / scale
            where.append(k)
            rows.append(x / np.sqrt(x @ x))
    return (np.stack(rows) if rows else np.zeros((0, 0))), np.array(where, np.int64)


def choose_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots for every vector length: up to about 2 sqrt(count) by the length's count, spread out, from bounded samples in the order of a hash.

    A sample over all lengths may hold none of a rare one; lengths that are still without pivots are sampled again.
    """
    counts = {r["_dim"]: r["count"] for r in vectors.where("_dim > 0").groupBy("_dim").count().collect()}
    wanted = {dim: int(min(MOST_PIVOTS, max(64, 2 * math.sqrt(n)))) for dim, n in counts.items()}
    out: dict[int, np.ndarray] = {}
    while left := [dim for dim in counts if dim not in out]:
        some = vectors.where(F.col("_dim").isin(left)).orderBy(F.xxhash64("_key", F.lit(7)), "_key").limit(4 * max(wanted[dim] for dim in left))
        by_dim: dict[int, list] = {}
        for r in some.select("embedding", "_dim").collect():
            by_dim.setdefault(r["_dim"], []).append(r["embedding"])
        for dim, rows in sorted(by_dim.items()):
            units, _ = _unit(rows)
            chosen: list[int] = []
            nearest = np.full(len(units), -1.0)
            for k in range(len(units)):
                if len(chosen) < wanted[dim] and nearest[k] < PIVOTS_APART:
                    chosen.append(k)
                    nearest = np.maximum(nearest, units @ units[k])
            out[dim] = units[chosen]
    return out


def _star(a: np.ndarray, b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that connect what the links (a, b), places in keys_a and keys_b, connect."""
    keys, inverse = np.unique(np.concatenate([keys_a[a], keys_b[b]]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(keys))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(keys)))
    return keys[moved], keys[label[moved]]


def _result(keys: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Rows (key, links, null) and (key, 0, other) of a task."""
    some = counts > 0
    none = np.full(int(some.sum()), None, object)
    return pd.DataFrame(
        {
            "key": np.concatenate([keys[some], a]).astype("int64"),
            "links": np.concatenate([counts[some], np.zeros(len(a), np.int64)]).astype("int64"),
            "other": pd.array([*none, *b.tolist()], "Int64"),
        }
    )


LINKS = "key long, links long, other long"


def _shared(rows: pd.DataFrame, pivots: int) -> np.ndarray:
    hot = np.zeros((len(rows), pivots), np.float32)
    near = np.stack(rows["near"].to_numpy()) if len(rows) else np.zeros((0, NEAREST), int)
    hot[np.arange(len(rows))[:, None], near] = 1
    return hot


def _compare_list(rows: pd.DataFrame, pivots: int, least: float) -> pd.DataFrame:
    """Links in one pivot's list between two blocks (or inside one) whose members share enough pivots, this one first."""
    pivot, lo, hi = int(rows["pivot"].iloc[0]), int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
    left = rows[rows["blk"] == lo].reset_index(drop=True)
    right = left if lo == hi else rows[rows["blk"] == hi].reset_index(drop=True)
    hot_l, hot_r = _shared(left, pivots), _shared(right, pivots)
    candidate = (hot_l @ hot_r.T >= min(SHARED, len(left["near"].iloc[0]))) & (hot_l[:, :pivot] @ hot_r[:, :pivot].T < 0.5)
    if lo == hi:
        candidate = np.triu(candidate, 1)
    a, b = np.nonzero(candidate)
    if not len(a):
        return _result(np.zeros(0, np.int64), np.zeros(0, np.int64), a, b)
    x, _ = _unit(left["embedding"])
    y, _ = (x, 0) if lo == hi else _unit(right["embedding"])
    linked = np.concatenate([np.einsum("ij,ij->i", x[a[k : k + 65536]], y[b[k : k + 65536]]) >= least for k in range(0, len(a), 65536)])
    a, b = a[linked], b[linked]
    kl, kr = left["key"].to_numpy(), right["key"].to_numpy()
    counts = np.concatenate([np.bincount(a, minlength=len(left)), np.bincount(b, minlength=len(right))])
    return _result(np.concatenate([kl, kr]), counts, *_star(a, b, kl, kr))


def _compare_ball(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between a block of a ball's members and vectors from outside that may reach it."""
    inside = rows[rows["inside"]].reset_index(drop=True)
    outside = rows[~rows["inside"]].reset_index(drop=True)
    if not len(inside) or not len(outside):
        none = np.zeros(0, np.int64)
        return _result(none, none, none, none)
    x, _ = _unit(inside["embedding"])
    y, _ = _unit(outside["embedding"])
    a, b = np.nonzero(x @ y.T >= least)
    kl, kr = inside["key"].to_numpy(), outside["key"].to_numpy()
    counts = np.concatenate([np.bincount(a, minlength=len(inside)), np.bincount(b, minlength=len(outside))])
    return _result(np.concatenate([kl, kr]), counts, *_star(a, b, kl, kr))


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding); links have cosine >= least.

    The index describes a vector by its 8 nearest pivots in order.  Vectors that share at least two of
    them meet in the inverted list of the first pivot they share, and are verified in double precision.  A
    list is compared in blocks of about 1024, block against block, each pair in one task; tasks give
    counts and a spanning set of links, never all pairs.

    Vectors within half the linking angle of their nearest pivot form its ball: any two of them link, so a group of copies that holds a
    pivot (every large one does) is counted, not compared.  A vector from outside can reach a member only
    if it lies within one and a half linking angles of the pivot, and only such are compared with the ball.

    Every length of vectors has pivots of its own, fitted on samples of at most 4 * MOST_PIVOTS vectors; all vectors are indexed.  Retrieval is by the
    pivots shared, so a link may be missed; tests and the README give the recall.  Null, zero, or non-finite vectors, or
    with null components, link with nothing.  Vectors of different lengths don't link.  Repeated rows are vectors of
    their own and link; a null vec_id gives a row with n_links, and is no component's id.  No rows: no rows.
    """
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    dim = F.when(F.coalesce(fine, F.lit(False)), F.size("embedding")).otherwise(0)
    copy = Window.partitionBy("vec_id", F.xxhash64("embedding")).orderBy("vec_id")
    keyed = wide.withColumn("_dim", dim).withColumn("_copy", F.row_number().over(copy))
    keyed = written(keyed.select("vec_id", "embedding", "_dim", F.xxhash64("vec_id", "embedding", "_copy").alias("_key")))
    spark = keyed.sparkSession
    pivots = spark.sparkContext.broadcast(choose_pivots(keyed))
    half, reach = math.cos(math.acos(least) / 2) + MARGIN, math.cos(min(math.pi, 1.5 * math.acos(least))) - MARGIN
    most = max((len(p) for p in pivots.value.values()), default=1)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                mine = batch.filter(pa.array(dims == dim))
                if not dim:
                    continue
                x, _ = _unit(mine.column(1).to_numpy(zero_copy_only=False))
                sims = x @ pivots.value[dim].T
                k = min(NEAREST, sims.shape[1])
                near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                held = np.take_along_axis(sims, near, 1)
                ball = np.where(held[:, 0] >= half, near[:, 0], -1)
                # pivots whose ball this vector may reach from outside; of two balls, members of the later one ask
                asks = [[int(p) for p, s in zip(ps, ss) if s >= reach and p != b and (b < 0 or p < b)] for ps, ss, b in zip(near.tolist(), held.tolist(), ball.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [mine.column(0), mine.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(ball, pa.int32()), pa.array(asks, pa.list_(pa.int32())), mine.column(2)],
                    ["key", "embedding", "near", "ball", "asks", "dim"],
                )

    schema = "key long, embedding array<double>, near array<int>, ball int, asks array<int>, dim int"
    index = written(keyed.where("_dim > 0").select("_key", "embedding", "_dim").mapInArrow(describe, schema))

    free = index.where("ball < 0").select("dim", "key", "embedding", "near", F.explode("near").alias("pivot"))
    lengths = free.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    spread = free.join(F.broadcast(lengths), ["dim", "pivot"]).withColumn("blk", F.pmod(F.xxhash64("key"), "blocks"))
    spread = spread.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("blk", "_other")).withColumn("hi", F.greatest("blk", "_other")).drop("_other", "blocks")
    listed = spread.groupBy("dim", "pivot", "lo", "hi").applyInPandas(lambda rows: _compare_list(rows, most, least), LINKS)

    balls = index.where("ball >= 0").select("dim", F.col("ball").alias("pivot"), "key", "embedding")
    sizes = balls.groupBy("dim", "pivot").agg(F.count("*").alias("held"), F.min("key").alias("head"))
    inside = balls.select("dim", "pivot", "key").join(F.broadcast(sizes), ["dim", "pivot"])
    certain = inside.select("key", (F.col("held") - 1).alias("links"), F.when(F.col("key") != F.col("head"), F.col("head")).alias("other"))
    outside = index.select("dim", "key", "embedding", F.explode("asks").alias("pivot"))
    askers = outside.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    grid = sizes.join(askers, ["dim", "pivot"]).select("dim", "pivot", "chunks", F.ceil(F.col("held") / BLOCK).alias("blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("key"), n)
    both = balls.join(F.broadcast(grid), ["dim", "pivot"]).select("dim", "pivot", part("blocks").alias("blk"), every("chunks").alias("chunk"), "key", "embedding", F.lit(True).alias("inside"))
    asked = outside.join(F.broadcast(grid), ["dim", "pivot"]).select("dim", "pivot", every("blocks").alias("blk"), part("chunks").alias("chunk"), "key", "embedding", F.lit(False).alias("inside"))
    reached = both.union(asked).groupBy("dim", "pivot", "blk", "chunk").applyInPandas(lambda rows: _compare_ball(rows, least), LINKS)

    found = written(listed.union(certain).union(reached))
    counts = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    roots = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    ids = keyed.select("vec_id", F.col("_key").alias("key"))
    named = ids.join(roots, F.col("key") == F.col("node"), "left").select("vec_id", "key", F.coalesce("root", "key").alias("root"))
    named = written(named)
    least_id = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    out = named.join(least_id, "root").join(counts, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))

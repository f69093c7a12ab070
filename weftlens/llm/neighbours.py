"""Approximate nearest neighbours by inner product, by counting collisions in windows of sorted projections.

Vectors are laid in blocks.  A block is scaled into the unit ball and each vector lifted onto the unit sphere by one more number, so that a
larger inner product with a query is a smaller distance to it.  For each of PROJECTIONS random directions the block's vectors are sorted by
their projection.  A query opens a window around its own projection in each; vectors that fall into enough of its windows are
verified.  Widening the windows by a factor is the same as hashing anew with wider buckets, without a new index.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import beside, written

PROJECTIONS = 192
#: Vectors of a block and queries of a group, about; each group meets each block in one task.
BLOCK = 8192
#: Windows end at marks, every so many of which a block's sorted projections have.
MARKS = 128
#: Half a window for distance d is REACH * d wide: a vector so far away falls into it with probability erf(REACH / sqrt 2).
REACH = 1.75
#: The threshold lies so many standard deviations below the mean of the collisions of a vector that far away: one in six of those is missed, and fewer
#: of nearer ones (one in 25 at 0.93 of the distance).
SPARE = 1.0
#: Distance that the first windows are made for, and how they grow.
FIRST, GROWTH = 0.15, 2.0
#: Queries whose windows are counted together.
TOGETHER = 64

_LIKELY = math.erf(REACH / math.sqrt(2))
#: The collision threshold of windows for a known distance, and that of windows which still grow.
ENOUGH = math.floor(PROJECTIONS * _LIKELY - SPARE * math.sqrt(PROJECTIONS * _LIKELY * (1 - _LIKELY)))
SURE = math.ceil(PROJECTIONS * _LIKELY)


def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng([dim, 13]).standard_normal((PROJECTIONS, dim + 1))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


INDEX = "dim int, blk long, keys binary, ids array<long>, vectors binary, scale double, marks binary, places binary"


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """A block's sorted arrays: the vectors' places in the order of each projection, and the projections at the marks."""
    x = _stack(rows["embedding"])
    n, dim = x.shape
    peak = np.abs(x).max()
    norms = np.sqrt(((x / peak) ** 2).sum(1))
    unit = (x / peak) / norms.max()
    lifted = np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))])
    projected = (_directions(dim) @ lifted.T).astype(np.float32)
    places = np.argsort(projected, axis=1, kind="stable")
    step = max(1, -(-n // MARKS))
    marks = np.take_along_axis(projected, places[:, ::step], 1)
    ids = [None if pd.isna(v) else int(v) for v in rows["vec_id"]]
    cell = lambda a, kind: np.ascontiguousarray(a, kind).tobytes()
    return pd.DataFrame(
        {"dim": [dim], "blk": [rows["blk"].iloc[0]], "keys": [cell(rows["key"], np.int64)], "ids": [ids], "vectors": [cell(x, np.float64)], "scale": [peak * norms.max()],
         "marks": [cell(marks, np.float32)], "places": [cell(places, np.uint16 if n <= 1 << 16 else np.uint32)]}
    )


class Block:
    """A block of the index, opened: bit sets of the vectors before each mark of each projection."""

    def __init__(self, row):
        self.keys = np.frombuffer(row["keys"], np.int64)
        n = self.n = len(self.keys)
        self.x = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        self.scale = row["scale"]
        self.null = np.array([v is None or pd.isna(v) for v in row["ids"]], bool)
        self.ids = np.array([np.iinfo(np.int64).max if gone else int(v) for v, gone in zip(row["ids"], self.null)], np.int64)
        self.marks = np.frombuffer(row["marks"], np.float32).reshape(PROJECTIONS, -1)
        places = np.frombuffer(row["places"], np.uint16 if n <= 1 << 16 else np.uint32).reshape(PROJECTIONS, n)
        step, words = max(1, -(-n // MARKS)), -(-n // 64)
        parts = self.marks.shape[1]
        self.before = np.zeros((PROJECTIONS, parts + 1, words), np.uint64)
        part = np.arange(n) // step
        for j in range(PROJECTIONS):
            held = np.zeros((parts, words * 64), np.uint8)
            held[part, places[j]] = 1
            np.bitwise_or.accumulate(np.packbits(held, axis=1, bitorder="little").view(np.uint64), axis=0, out=self.before[j, 1:])

    def colliding(self, projected: np.ndarray, half: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) with enough collisions, for queries by their projections, half the width of their windows, and whether these are the last."""
        planes: list[list[np.ndarray]] = [[]]

        def add(level: int, bits: np.ndarray) -> None:
            """Counts of all vectors at once, one bit of each count to a plane: three bits of a level become one there and one of the next."""
            held = planes[level]
            if len(held) < 2:
                held.append(bits)
                return
            a, b = held
            either = a ^ b
            planes[level] = [either ^ bits]
            if len(planes) == level + 1:
                planes.append([])
            add(level + 1, (a & b) | (either & bits))

        for j in range(PROJECTIONS):
            start = np.maximum(np.searchsorted(self.marks[j], projected[:, j] - half, "right") - 1, 0)
            end = np.searchsorted(self.marks[j], projected[:, j] + half, "right")
            add(0, self.before[j][end] ^ self.before[j][start])
        level = 0
        while level < len(planes):
            if len(planes[level]) == 2:
                a, b = planes[level]
                planes[level] = [a ^ b]
                if len(planes) == level + 1:
                    planes.append([])
                if len(planes[level + 1]) == 2:
                    add(level + 1, a & b)
                else:
                    planes[level + 1].append(a & b)
            level += 1
        more = np.zeros((len(projected), self.before.shape[2]), np.uint64)
        equal = ~more
        enough = np.where(last, ENOUGH, SURE)[:, None]
        for level in range(max(len(planes), SURE.bit_length()) - 1, -1, -1):
            bits = planes[level][0] if level < len(planes) and planes[level] else np.zeros_like(more)
            wanted = np.where(enough >> level & 1, ~np.uint64(0), np.uint64(0))
            more |= equal & bits & ~wanted
            equal &= ~(bits ^ wanted)
        found = np.unpackbits((more | equal).view(np.uint8), axis=1, bitorder="little")[:, : self.n]
        return np.nonzero(found)

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of up to k found for each query, the queries' own keys left out.

        Windows grow until k vectors are verified, with the threshold SURE; the k-th then says how far away a nearest vector can be, and the last
        windows are made for that distance, with the threshold ENOUGH.
        """
        n_queries = len(queries)
        if self.n <= 4 * k:
            q, v = np.divmod(np.arange(n_queries * self.n), self.n)
            return self._best(queries, own, q, v, k)
        peaks = np.abs(queries).max(1)
        unit = queries / peaks[:, None]
        lengths = np.sqrt((unit**2).sum(1))
        projected = ((unit / lengths[:, None]) @ _directions(queries.shape[1])[:, :-1].T).astype(np.float32)
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        far = np.full(n_queries, FIRST)  # distance that the windows are made for
        last = np.zeros(n_queries, bool)
        open_ = np.arange(n_queries)
        while len(open_):
            q, v = self.colliding(projected[open_], (REACH * far[open_]).astype(np.float32), last[open_])
            q = open_[q]
            every = open_[far[open_] >= 2]  # nothing on the sphere is further away: all vectors are verified
            if len(every):
                keep = ~np.isin(q, every)
                q, v = np.concatenate([q[keep], np.repeat(every, self.n)]), np.concatenate([v[keep], np.tile(np.arange(self.n), len(every))])
            q, v, s = self._best(queries, own, q, v, k)
            ended = last[open_] | (far[open_] >= 2)
            keep = np.isin(q, open_[ended])
            out = tuple(np.concatenate([o, m[keep]]) for o, m in zip(out, (q, v, s)))
            kth = np.full(n_queries, np.inf)
            np.minimum.at(kth, q, s)
            near = np.clip(np.nan_to_num(kth[open_] / self.scale / peaks[open_] / lengths[open_], nan=-1.0), -1, 1)
            known = np.bincount(q, minlength=n_queries)[open_] >= k
            far[open_] = np.where(known, np.sqrt(np.maximum(2 - 2 * near, 1e-6)), np.minimum(2, far[open_] * GROWTH))
            last[open_] = known
            open_ = open_[~ended]
        return out

    def _best(self, queries, own, q, v, k) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keep = own[q] != self.keys[v]
        q, v = q[keep], v[keep]
        s = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", queries[q[a : a + 2048]], self.x[v[a : a + 2048]]) for a in range(0, len(q), 2048))])
        order = np.lexsort((self.ids[v], -s, q))
        q, v, s = q[order], v[order], s[order]
        first = np.searchsorted(q, np.arange(len(queries)))
        keep = np.arange(len(q)) - first[q] < k
        return q[keep], v[keep], s[keep]


FOUND = "query_key long, query_id long, vec_id long, score double"


def _search(k: int):
    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_key": pd.Series([], dtype="int64"), "query_id": pd.Series([], dtype="int64"), "vec_id": pd.Series([], dtype="Int64"), "score": pd.Series([], dtype="float64")})
        if not len(index) or not len(queries):
            return empty
        block = Block(index.iloc[0])
        parts = [empty]
        for at in range(0, len(queries), TOGETHER):
            some = queries.iloc[at : at + TOGETHER]
            own = some["key"].to_numpy()
            q, v, s = block.nearest(_stack(some["embedding"]), own, k)
            ids = pd.array(block.ids[v], "Int64")
            ids[block.null[v]] = pd.NA
            parts.append(pd.DataFrame({"query_key": own[q], "query_id": some["vec_id"].to_numpy()[q].astype("int64"), "vec_id": ids, "score": s}))
        return pd.concat(parts)

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, dim, key) of the vectors that aren't null or zero and hold finite numbers only; key tells rows apart."""
    wide = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    return written(wide.where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("embedding")).withColumn("key", F.monotonically_increasing_id()))


def build_index(rows: DataFrame) -> DataFrame:
    """The index of usable() rows: a row for each block, with its sorted arrays; every row is indexed."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    laid = rows.join(beside(written(sizes)), "dim").withColumn("blk", F.pmod(F.xxhash64("key"), "blocks"))
    return written(laid.groupBy("dim", "blk").applyInPandas(_index, INDEX))


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors found with the largest inner product for each row of vectors (vec_id, embedding) whose vec_id is
    divisible by `every`, nearest first, ties to the smaller vec_id (null last).

    All other rows are candidates, those with the query's vec_id too.  Each group of queries meets each block of the index in one task, which gives
    its k best; the chance to miss a vector there depends on its distance (SPARE), not on the number of rows.  Scores are inner products of the
    vectors as given, in double precision.

    Vectors that are null, zero, or hold null or non-finite numbers take no part.  Vectors of different lengths aren't compared.  Repeated rows are
    queries and candidates of their own.  With k candidates or fewer, all are returned.  Other columns aren't read.  No rows: no rows.
    """
    rows = usable(vectors)
    index = build_index(rows)
    asked = rows.where((F.col("vec_id") % every == 0))
    groups = written(asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("groups")))
    blocks = written(index.groupBy("dim").agg(F.max("blk").alias("last")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    left = index.join(beside(groups), "dim").withColumn("grp", upto(F.col("groups") - 1)).drop("groups")
    right = asked.join(beside(groups), "dim").join(beside(blocks), "dim").withColumn("grp", F.pmod(F.xxhash64("key"), "groups")).withColumn("blk", upto(F.col("last")))
    meet = ["dim", "blk", "grp"]
    found = left.groupBy(*meet).cogroup(right.select(*meet, "key", "vec_id", "embedding").groupBy(*meet)).applyInPandas(_search(k), FOUND)
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Jaccard self-join of documents on word shingles, by a token-group matrix."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import beside, components, fresh, in_small_batches, written
from .scan import Texts, mix, texts, windows

#: Counters of the sketch of shingle frequencies: 16 MB whatever the corpus holds; a task counts to 255 in each.
SKETCH_BITS = 22
SKETCH_CHUNKS = 256
#: Sketches that one task adds up at a time.
FAN_IN = 32
#: Members of a block of a group, and queries that meet a block in one task.
BLOCK = 256
#: In lists of this many nodes or more, nodes are first compared with the list's most central node.
LONG = 16


def _sets(t: Texts, size: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: runs of `size` lower-cased words, or the whole of a shorter text."""
    data = t.lowered()
    starts, ends, first = t.words()
    words = t.span_hash(t.prefix_hash(data), starts, ends)
    runs, begin = windows(words, first, size)
    for k in range(t.n):
        n = first[k + 1] - first[k]
        if n >= size:
            yield np.unique(runs[begin[k] : begin[k + 1]])
        elif n:
            yield windows(words, first[[k, k + 1]], int(n))[0]
        else:
            yield np.zeros(0, np.uint64)


def _node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    for t in texts(column):
        yield from _sets(t, size)


def least_overlap(n: int, percent: int) -> int:
    """A set of n that links has at least this many elements in common with the other: the union is no smaller than n."""
    return -(-percent * n // 100)


def _frequency_classes(docs: DataFrame, size: int) -> np.ndarray:
    """For each counter of a count sketch over all documents: 0 up to three deviations above the mean, else about the logarithm of how far."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for t in texts(batch.column(0)):
                for s in _sets(t, size):
                    np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        salt = TaskContext.get().partitionId() // FAN_IN
        parts = np.minimum(sketch, 255).astype(np.uint8).reshape(SKETCH_CHUNKS, -1)
        for k in np.flatnonzero(parts.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([salt], pa.int32()), pa.array([parts[k].tobytes()], pa.binary())], ["chunk", "salt", "counts"])

    def add(kind: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros((1 << SKETCH_BITS) // SKETCH_CHUNKS, np.int32)
            for c in rows["counts"]:
                total += np.frombuffer(c, kind)
            return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "salt": [rows["salt"].iloc[0] // FAN_IN], "counts": [total.tobytes()]})

        return run

    schema = "chunk int, salt int, counts binary"
    parts = in_small_batches(docs).select("text").mapInArrow(count, schema)
    sums = parts.groupBy("chunk", "salt").applyInPandas(add(np.uint8), schema).groupBy("chunk", "salt").applyInPandas(add(np.int32), schema)
    sums = sums.groupBy("chunk").applyInPandas(add(np.int32), schema)
    sketch = np.zeros((SKETCH_CHUNKS, (1 << SKETCH_BITS) // SKETCH_CHUNKS), np.int32)
    for r in sums.collect():
        sketch[r.chunk] = np.frombuffer(r.counts, np.int32)
    above = sketch.reshape(-1) - sketch.mean()
    return np.clip(np.log2(np.maximum(above / (3 * np.sqrt(sketch.mean()) + 2), 0.5)) + 1, 0, 7).astype(np.uint8)


def _signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, node, prefix): set size, hash of the set, and the first tokens of the set in the order rare to frequent.

    Two sets that link share one of their first n - least_overlap(n) + 1 tokens in any common order.
    A task gives the prefix of equal sets once.
    """
    classes = docs.sparkSession.sparkContext.broadcast(_frequency_classes(docs, size))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sizes, nodes, prefixes = [], [], []
            for s in shingle_sets(batch.column(1), size):
                node = _node(s)
                prefix = None
                if len(s) and node not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(node)
                    tokens = (classes.value[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(60)) | (mix(s) >> np.uint64(4))
                    k = len(s) - least_overlap(len(s), percent) + 1
                    prefix = np.sort(np.partition(tokens, k - 1)[:k]).astype(np.int64)
                sizes.append(len(s))
                nodes.append(node)
                prefixes.append(prefix)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "n", "node", "prefix"],
            )

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, node long, prefix array<long>")


def _open_block(rows: pd.DataFrame, size: int, percent: int) -> list[tuple[int, int]]:
    """Links between queries and a block's members that lie in different components.

    The block's tokens, each with the members that have it, give a query's overlap with their union and, if
    that reaches what a link needs, with each member.
    """
    sets = list(shingle_sets(pa.array(rows["text"], pa.string()), size))
    query, comp = rows["query"].to_numpy(), rows["comp"].to_numpy()
    members = np.flatnonzero(~query)
    if not len(members):
        return []
    sizes = np.array([len(sets[i]) for i in members])
    tokens = np.concatenate([sets[i] for i in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out: set[tuple[int, int]] = set()
    for q in np.flatnonzero(query):
        mine = sets[q]
        left, right = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
        count = right - left
        if np.count_nonzero(count) < least_overlap(len(mine), percent):
            continue
        at = np.repeat(left - np.cumsum(count) + count, count) + np.arange(count.sum())
        both = np.bincount(owner[at], minlength=len(members))
        link = (100 * both >= percent * (len(mine) + sizes - both)) & (both > 0) & (comp[members] != comp[q])
        out.update((int(comp[q]), int(c)) for c in comp[members[link]])
    return list(out)


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def _enough(common: str, a: str, b: str, percent: int) -> str:
    """SQL: sets of sizes a and b may link, if their prefixes have `common` tokens in common.

    Up to the earlier of the two prefix ends all common tokens are counted; beyond it lie at most
    least_overlap(n) - 1 elements of the set whose prefix ends there.
    """
    return f"{100 + percent} * ({common} + ceil({percent} * greatest({a}, {b}) / 100.0) - 1) >= {percent} * ({a} + {b})"


def _any_enough(common: str, n: str, lo: str, hi: str, percent: int) -> str:
    """SQL: a set of size n may link with one of some size from lo to hi, if their prefixes have `common` tokens in common.

    Up to n, _enough is easiest met at lo.  Above n its ceil rises in steps, so the ends don't speak for the sizes
    between them; with ceil(x) - 1 < x the bound has no steps, and is easiest met at hi.
    """
    above = f"{100 + percent} * (100 * {common} + {percent} * {hi}) > {100 * percent} * ({n} + {hi})"
    return f"({_enough(common, n, lo, percent)} or ({hi} > {n} and {above}))"


def _open_groups(docs: DataFrame, probes: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components, from probes (grp, blk, node, rep, comp) and members of the probed groups (same columns).

    A group with many queries is opened in several tasks, each with about 256 of them.
    """
    probes, members = written(probes), members.distinct()
    loads = probes.groupBy("grp", "blk").agg(F.ceil(F.count("*") / BLOCK).alias("chunks"))
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), "chunks").alias("chunk")
    asked = probes.join(loads, ["grp", "blk"]).select("grp", "blk", chunk, "node", "rep", "comp", F.lit(True).alias("query"))
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")
    held = members.join(loads, ["grp", "blk"]).select("grp", "blk", chunks, "node", "rep", "comp", F.lit(False).alias("query"))
    rows = written(asked.union(held))
    absent = F.lit(-(1 << 63))

    def belongs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [_node(s) for s in shingle_sets(batch.column(1), size)]
            yield batch.filter(pa.array(np.array(nodes, np.int64) == batch.column(0).to_numpy(), pa.bool_()))

    wanted = written(rows.select("node", F.coalesce("rep", absent).alias("_id")).distinct())
    body = docs.withColumn("_id", F.coalesce("doc_id", absent)).join(beside(wanted), "_id").select("node", "text")
    body = written(body.mapInArrow(belongs, "node long, text string"))
    opened = rows.join(body, "node").groupBy("grp", "blk", "chunk")
    return opened.applyInPandas(lambda part: _frame(_open_block(part, size, percent)), "a long, b long")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of `size`-word shingles; the
    component's id is its smallest doc_id.

    Equal sets are one node.  To spare comparisons inside large groups of near copies, nodes in long lists of a token
    are first compared with the list's most central node.  What that links is a group of the matrix; other nodes fall
    into groups by the commonest token of their prefix that another node has too, and by the band of their size; groups lie in blocks of about 256.
    The matrix says which prefix tokens a block's union has.  A query's overlap with a block is the number of its prefix
    tokens there; it bounds the overlap with every member, and only blocks that can hold a link are opened: the
    texts are fetched and the sets compared, again under the bound of the block's whole token union.

    A node probes only blocks with a node of a larger component (or as large, with a larger name).  No link between components is
    lost: it needs a common prefix token, and the node of its smaller component probes the other's block.

    Null or blank text: no shingles, linked with nothing.  Fewer than `size` words: the whole is one
    shingle.  A null doc_id gives a row too.  Repeated rows get the same component.  No rows: no rows.
    """
    docs = docs.select("doc_id", "text")
    signed = written(_signatures(docs, size, percent))
    nodes = written(signed.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("prefix").alias("prefix")))
    lists = nodes.select("node", F.explode("prefix").alias("token"))
    held = written(lists.groupBy("token").agg(F.count("*").alias("held")).where("held > 1"))
    lists = written(lists.join(held, "token").select("node", "token", "held"))

    long_ = lists.where(F.col("held") >= LONG)
    # the node with most company in long lists: of copies that vary around one text, that text
    company = long_.groupBy("node").agg(F.sum("held").alias("_sum"))
    heads = written(long_.join(company, "node").groupBy("token").agg(F.max_by("node", F.struct("_sum", "node")).alias("head")))
    pairs = long_.join(heads, "token").where("node <> head").select("node", "head").distinct()
    a, b = nodes.select("node", "n", "prefix"), nodes.select(F.col("node").alias("head"), F.col("n").alias("_n"), F.col("prefix").alias("_prefix"))
    pairs = pairs.join(a, "node").join(b, "head").withColumn("_c", F.size(F.array_intersect("prefix", "_prefix")))
    pairs = written(pairs.where(f"100 * least(n, _n) >= {percent} * greatest(n, _n)").where(_enough("_c", "n", "_n", percent)).select("node", "head"))
    alone = F.col("node").alias("comp")
    block = (F.col("head").alias("grp"), F.lit(0).cast("long").alias("blk"))
    reps = nodes.select("node", "rep")
    probes = pairs.select(*block, "node").join(reps, "node").select("grp", "blk", "node", "rep", alone)
    members = pairs.select(*block, F.col("head").alias("node")).distinct().join(reps, "node").select("grp", "blk", "node", "rep", alone)
    labels = components(_open_groups(docs, probes, members, size, percent))

    common = lists.groupBy("node").agg(F.max(F.struct("held", "token")).alias("_most")).select("node", F.col("_most.token").alias("_token"))
    placed = common.join(labels, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    # sets of a band differ by no more than two that link may
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent))) if percent < 100 else F.col("n")
    placed = placed.join(nodes.select("node", "rep", "n"), "node").withColumn("grp", F.coalesce("root", F.xxhash64("_token", band)))
    placed = written(placed.select("node", "rep", "n", "comp", "grp"))
    groups = written(placed.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    sizes = written(placed.groupBy("comp").agg(F.count("*").alias("nodes")))
    placed = placed.join(groups, "grp").join(sizes, "comp").withColumn("blk", F.pmod(F.xxhash64("node"), "blocks"))
    placed = written(placed.select("node", "rep", "n", "comp", "nodes", "grp", "blk"))
    across = lists.select("token", "node").join(placed, "node")
    across = written(across.select("token", "node", "n", "grp", "blk", F.struct("nodes", "comp").alias("rank")))
    mixed = across.groupBy("token").agg(F.min("rank.comp").alias("_lo"), F.max("rank.comp").alias("_hi")).where("_lo < _hi")
    across = across.join(written(mixed.select("token")), "token")
    matrix = across.groupBy("token", "grp", "blk").agg(
        F.count("*").alias("held"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rank").alias("top")
    ).alias("m")
    q = across.alias("q")
    others = F.expr("not (q.grp = m.grp and q.blk = m.blk and m.held = 1) and q.rank < m.top")
    fits = F.expr(f"100 * m.hi >= {percent} * q.n and 100 * q.n >= {percent} * m.lo")
    overlap = (
        q.join(matrix, (F.col("q.token") == F.col("m.token")) & others & fits)
        .groupBy("q.node", "m.grp", "m.blk")
        .agg(F.count("*").alias("_c"), F.first("q.n").alias("n"), F.min("m.lo").alias("lo"), F.max("m.hi").alias("hi"))
        .withColumn("lo", F.expr(f"greatest(lo, ceil({percent} * n / 100.0))"))
        .withColumn("hi", F.expr(f"least(hi, floor(100.0 * n / {percent}))"))
        .where(f"lo <= hi and {_any_enough('_c', 'n', 'lo', 'hi', percent)}")
    )
    overlap = written(overlap.select("node", "grp", "blk"))
    probes = overlap.join(placed.select("node", "rep", "comp"), "node").select("grp", "blk", "node", "rep", "comp")
    members = placed.join(overlap.select("grp", "blk").distinct(), ["grp", "blk"]).select("grp", "blk", "node", "rep", "comp")
    merged = components(_open_groups(docs, probes, members, size, percent)).select(F.col("node").alias("comp"), F.col("root").alias("_top"))

    final = placed.join(merged, "comp", "left").select("node", F.coalesce("_top", "comp").alias("comp"))
    final = nodes.select("node", "rep").join(final, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    least = final.groupBy("comp").agg(F.min("rep").alias("_least"))
    own = final.join(least, "comp").select("node", "_least")
    # a row without shingles has no node of its own
    return signed.select("doc_id", "n", "node").join(own, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay when one document of each component does: the one with the smallest doc_id.

    Columns and values stay as they are.  Repeated rows stay once.  Rows without words all stay; so
    does a row with a null doc_id.
    """
    found = jaccard_components(docs, size, percent)
    gone = found.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    row = fresh(docs.columns, "row")
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    return kept.withColumn(row, F.row_number().over(once)).where(F.expr(f"`{row}` = 1 or doc_id is null or text is null")).drop(row)

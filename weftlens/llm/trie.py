"""Prefix trie of conversations, as tables of nodes behind minimal perfect hashes.

A prefix's digest is a polynomial of its turns' digests, so a long conversation is digested in parts that are put together afterwards.
A shard is a bounded run of rows of the sorted conversations: its distinct digests get slots, counts are scattered into flat arrays by
slot, and sums are carried from slot to parent slot, deepest first.  Shards share the upper nodes of the trie; as every
sum over a subtree counts each node in one shard only, what shards find is added up by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import beside, written
from .places import PARTITION_BITS, numbered
from .scan import mix

#: Digests are polynomials modulo a Mersenne prime at a fixed point; the root's is 0.
PRIME = (1 << 127) - 1
POINT = int.from_bytes(hashlib.sha256(b"weftlens conversation prefixes").digest()[:15], "big")
#: Rows of a shard, about; a shard ends where a chunk does.
SHARD_ROWS = 1 << 15
#: Turns of a conversation that one shard holds.
CHUNK = 4096
#: Ids in one text of a node's list of ids.
IDS_A_TEXT = 4096
#: Turns at most that a conversation takes over from the first of its hundred.
HEAD = 5

_MASK = (1 << 64) - 1


class SlotTable:
    """Slots 0 to n - 1 for n distinct 128-bit keys: a minimal perfect hash, whose every answer is verified against the key stored in the slot.

    Keys that are alone in their place at a level get the next slots in the order of places; the others go on to a level of their own.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        self.n, self._levels = len(hi), []
        self.hi, self.lo = np.empty(self.n, np.uint64), np.empty(self.n, np.uint64)
        left, taken = np.arange(self.n), 0
        while len(left):
            size, seed = max(64, 2 * len(left)), len(self._levels)
            place = self._place(hi[left], lo[left], seed, size)
            alone = np.bincount(place, minlength=size) == 1
            ranks = np.cumsum(alone) - 1 + taken
            self._levels.append((size, alone, ranks))
            here = alone[place]
            slots = ranks[place[here]]
            self.hi[slots], self.lo[slots] = hi[left[here]], lo[left[here]]
            taken += int(here.sum())
            left = left[~here]

    @staticmethod
    def _place(hi: np.ndarray, lo: np.ndarray, seed: int, size: int) -> np.ndarray:
        return (mix(hi ^ mix(lo + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _MASK))) % np.uint64(size)).astype(np.int64)

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 for keys that aren't in the table."""
        out = np.full(len(hi), -1, np.int64)
        left = np.arange(len(hi))
        for seed, (size, alone, ranks) in enumerate(self._levels):
            if not len(left):
                break
            place = self._place(hi[left], lo[left], seed, size)
            here = alone[place]
            out[left[here]] = ranks[place[here]]
            left = left[~here]
        held = out >= 0
        held[held] = (self.hi[out[held]] == hi[held]) & (self.lo[out[held]] == lo[held])
        out[~held] = -1
        return out


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    return hi[new], lo[new]


def _shards(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of about SHARD_ROWS rows that don't cut rows equal in key, which stand together."""
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < SHARD_ROWS:
            continue
        rows = pa.concat_tables(held).combine_chunks()
        while rows.num_rows >= SHARD_ROWS:
            columns = [rows.column(c).to_numpy() for c in key]
            change = np.zeros(rows.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = np.flatnonzero(change[SHARD_ROWS:])
            if not len(cuts):
                break
            yield rows.slice(0, SHARD_ROWS + int(cuts[0]))
            rows = rows.slice(SHARD_ROWS + int(cuts[0]))
        held = [rows]
    if held and (rows := pa.concat_tables(held).combine_chunks()).num_rows:
        yield rows


def _unsigned(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy().view(np.uint64) for c in names]


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns.values()], list(columns))


# ---------------------------------------------------------------- rebuilt conversations and digests


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, kind, i, digest, chars) for each turn in the order of (kind, i), and (conv_id, turns) for each conversation.

    A conversation takes over as many turns as crc32(decimal conv_id) mod 6 says from the first of its hundred (conv_id - conv_id % 100), then goes
    on after as many of its own.  Turns are ordered by turn (null first), those of one turn by the MD5 of role and text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.char_length(text).cast("long").alias("chars"), digest.alias("digest"))
    own = numbered(slim, ["conv_id"], ["turn", "digest"], "i", "n")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    first = F.col("conv_id") - F.col("conv_id") % 100
    convs = own.where("i = 0").select("conv_id", "n", first.alias("base"), taken.alias("h"))
    heads = own.where((F.col("conv_id") % 100 == 0) & (F.col("i") < HEAD)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("i", "digest", "chars"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
    convs = written(convs.select("conv_id", "head", (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("turns")))
    copied = convs.select("conv_id", F.lit(0).alias("kind"), F.inline("head")).select("conv_id", "kind", "i", "digest", "chars")
    rest = own.where(F.col("i") >= taken).select("conv_id", F.lit(1).alias("kind"), "i", "digest", "chars")
    return copied.union(rest), convs.select("conv_id", "turns")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of a partition's rows, each conversation's from its first row here, whatever stands in other partitions."""
    conv, value, k = None, 0, 0
    for batch in batches:
        convs, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        values, befores, ks = [], [], []
        for c, d in zip(convs, digests):
            if c != conv:
                conv, value, k = c, 0, 0
            befores.append(value)
            value = (value * POINT + int(d, 16) + 1) % PRIME
            k += 1
            values.append(value)
            ks.append(k)
        parts = [[v >> 64 for v in values], [(v & _MASK) for v in values], [v >> 64 for v in befores], [(v & _MASK) for v in befores]]
        arrays = [pa.array(np.array(p, np.uint64).view(np.int64)) for p in parts]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *arrays, pa.array(ks, pa.int64())], ["conv_id", "chars", "d1", "d2", "p1", "p2", "k"])


PATH = "conv_id long, depth long, d1 long, d2 long, p1 long, p2 long, chars long"


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, d1, d2, p1, p2, chars) of every prefix of every rebuilt conversation, in the order of conv_id and depth.

    Rows are sorted into ranges; a range digests what it holds of a conversation.  Only the conversation that goes on from the range before needs what
    came before: (turns, digest) of earlier ranges, one entry for each range, put together on the driver.
    """
    keys = ["conv_id", "kind", "i"]
    sorted_rows = written(rows).repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "digest", "chars")
    local = sorted_rows.mapInArrow(_digests, "conv_id long, chars long, d1 long, d2 long, p1 long, p2 long, k long")
    local = written(local.withColumn("part", F.shiftright(F.monotonically_increasing_id(), PARTITION_BITS)))
    ends = local.groupBy("part").agg(*[f("conv_id").alias(n) for f, n in ((F.min, "first"), (F.max, "last"))])
    runs = local.join(F.broadcast(ends), "part").where((F.col("conv_id") == F.col("first")) | (F.col("conv_id") == F.col("last")))
    runs = runs.groupBy("part", "conv_id").agg(F.max(F.struct("k", "d1", "d2")).alias("end")).select("part", "conv_id", "end.*")
    before: dict[int, tuple[int, int, int]] = {}
    conv, turns, value = None, 0, 0
    for r in sorted(runs.collect(), key=lambda r: (r.part, r.conv_id)):  # two rows for each partition at most
        if r.conv_id == conv:
            before[r.part] = (conv, turns, value)
            turns, value = turns + r.k, (value * pow(POINT, r.k, PRIME) + (r.d1 << 64) + (r.d2 & _MASK)) % PRIME
        else:
            conv, turns, value = r.conv_id, r.k, (r.d1 << 64) + (r.d2 & _MASK)
    carried = local.sparkSession.sparkContext.broadcast(before)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("conv_id", "k", "d1", "d2", "p1", "p2", "part")]
            conv, depth, d1, d2, p1, p2, part = columns
            for p in np.unique(part):
                if p not in carried.value:
                    continue
                whose, turns, value = carried.value[p]
                for at in np.flatnonzero((part == p) & (conv == whose)):
                    factor = pow(POINT, int(depth[at]) - 1, PRIME)
                    for hi, lo, times in ((p1, p2, factor), (d1, d2, factor * POINT % PRIME)):
                        v = (value * times + (int(hi[at]) << 64) + (int(lo[at]) & _MASK)) % PRIME
                        hi[at], lo[at] = np.array([v >> 64, v & _MASK], np.uint64).view(np.int64)
                    depth[at] += turns
            yield pa.RecordBatch.from_arrays([*map(pa.array, (conv, depth, d1, d2, p1, p2)), batch.column(batch.schema.names.index("chars"))], ["conv_id", "depth", "d1", "d2", "p1", "p2", "chars"])

    return written(local.mapInArrow(put_together, PATH))


# ---------------------------------------------------------------- shards


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's nodes with the members it holds."""
    for rows in _shards(batches, ["conv_id"]):
        d1, d2, p1, p2 = _unsigned(rows, "d1", "d2", "p1", "p2")
        conv, depth, chars = (rows.column(c).to_numpy() for c in ("conv_id", "depth", "chars"))
        table = SlotTable(*_distinct(d1, d2))
        slot = table.slots(d1, d2)
        members = np.bincount(slot, minlength=table.n)
        least = np.full(table.n, np.iinfo(np.int64).max)
        np.minimum.at(least, slot, conv)
        flat = [np.empty(table.n, np.int64) for _ in range(4)]
        for to, of in zip(flat, (p1.view(np.int64), p2.view(np.int64), depth, chars)):
            to[slot] = of
        yield _table(d1=table.hi, d2=table.lo, p1=flat[0], p2=flat[1], depth=flat[2], chars=flat[3], conv_id=least, n_convs=members)


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a shard's subtrees, deepest nodes first, from each slot to its parent's.

    Rows of (conv_id, chunk, depth, kind, ...): kind 0 is a node on a conversation's path; kind 1, after it, has the values that the node adds, or
    those of all that the conversation adds in later chunks.
    """
    for rows in _shards(batches, ["conv_id", "chunk"]):
        conv, chunk, depth, kind, leaves, saved = (rows.column(c).to_numpy() for c in ("conv_id", "chunk", "depth", "kind", "leaves", "saved"))
        path = np.flatnonzero(kind == 0)
        d1, d2 = _unsigned(rows.take(pa.array(path)), "d1", "d2")
        table = SlotTable(*_distinct(d1, d2))
        slot = table.slots(d1, d2)
        sums = np.zeros((2, table.n), np.int64)
        own = np.flatnonzero(kind == 1)
        at = slot[np.cumsum(kind == 0)[own] - 1]
        np.add.at(sums[0], at, leaves[own])
        np.add.at(sums[1], at, saved[own])
        parent, deep = np.full(table.n, -1, np.int64), np.empty(table.n, np.int64)
        deep[slot] = depth[path]
        on = np.flatnonzero((conv[path][1:] == conv[path][:-1]) & (chunk[path][1:] == chunk[path][:-1])) + 1
        parent[slot[on]] = slot[on - 1]
        order = np.argsort(-deep, kind="stable")
        for level in np.split(order, np.flatnonzero(np.diff(deep[order])) + 1):
            level = level[parent[level] >= 0]
            np.add.at(sums[0], parent[level], sums[0][level])
            np.add.at(sums[1], parent[level], sums[1][level])
        yield _table(d1=table.hi, d2=table.lo, n_leaves=sums[0], saved_tokens=sums[1])


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (d1, d2, conv_id) as rows of up to IDS_A_TEXT ids, joined by commas."""
    names = ["d1", "d2", "first", "ids"]
    for batch in batches:
        d1, d2, conv = (batch.column(c).to_numpy() for c in range(3))
        change = np.flatnonzero((d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) + 1
        edges = np.concatenate([[0], change, [len(d1)]]) if len(d1) else np.zeros(1, np.int64)
        starts, texts = [], []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for k in range(a, b, IDS_A_TEXT):
                starts.append(k)
                texts.append(",".join(map(str, conv[k : min(b, k + IDS_A_TEXT)].tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(d1[starts] if starts else d1[:0]), pa.array(d2[starts] if starts else d2[:0]), pa.array(conv[starts] if starts else conv[:0]), pa.array(texts, pa.string())], names)


def _sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids from its sorted texts, one after another."""
    key, sha = None, None
    done: list[tuple[int, int, str]] = []
    batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ((),) * 3, (pa.int64(), pa.int64(), pa.string()))], ["d1", "d2", "ends"])
    for batch in batches:
        for d1, d2, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
            if (d1, d2) == key:
                sha.update(b"," + ids.encode())
            else:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha = (d1, d2), hashlib.sha256(ids.encode())
        yield batch_of()
        done = []
    if key is not None:
        done.append((*key, sha.hexdigest()))
        yield batch_of()


def ends_of(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends): SHA-256 of the ascending ids of the conversations (d1, d2, conv_id) that end at a node.

    The ids of one node are sorted in several tasks and joined there into texts; one task then reads a node's texts as a stream.
    """
    keys = ["d1", "d2", "conv_id"]
    texts = written(ends).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_id_texts, "d1 long, d2 long, first long, ids string")
    return texts.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(_sealed, "d1 long, d2 long, ends string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of the rebuilt conversations of turns (conv_id, turn, role, text): see rebuilt().

    conv_id (the smallest member's), depth, parent_conv_id (the parent's conv_id, null for the root), n_convs (members), n_children, n_leaves
    (childless nodes in the subtree), saved_tokens (over the subtree, (n_convs - 1) times the code points of a node's last text), ends_sha256 (of the
    ids of the members that end here), and the node's digest d1, d2.

    A null role or text is empty.  Rows with a null conv_id belong to no conversation and aren't read.  Rows that are equal in conv_id and turn are turns
    of their own; where they differ they are ordered by MD5.  A conversation that is rebuilt without turns is a member of the root.  Other columns are not
    read.  No conversations: no nodes, not even the root.
    """
    rows, convs = rebuilt(turns)
    path = paths(rows)
    nodes = path.mapInArrow(_count, "d1 long, d2 long, p1 long, p2 long, depth long, chars long, conv_id long, n_convs long")
    same = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "chars")]
    nodes = written(nodes.groupBy("d1", "d2").agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")))
    kids = nodes.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    chunk = F.floor((F.col("depth") - 1) / CHUNK)
    none = F.lit(0).cast("long")
    adds = nodes.select("conv_id", chunk.alias("chunk"), "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    totals = adds.groupBy("conv_id", "chunk").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("chunk").alias("_c"))
    # what a conversation adds in later chunks, at the last node of each chunk before
    long = totals.where("chunk > 0").groupBy("conv_id").agg(F.max("chunk").alias("top")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("chunk"))
    long = long.join(totals, ["conv_id", "chunk"], "left").na.fill(0, ["leaves", "saved"])
    later = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = long.select("conv_id", "chunk", ((F.col("chunk") + 1) * CHUNK).alias("depth"), F.sum("leaves").over(later).alias("leaves"), F.sum("saved").over(later).alias("saved")).where("leaves is not null")
    steps = path.select("conv_id", chunk.alias("chunk"), "depth", F.lit(0).alias("kind"), none.alias("leaves"), none.alias("saved"), "d1", "d2")
    values = adds.union(carried).select("conv_id", "chunk", "depth", F.lit(1).alias("kind"), "leaves", "saved", none.alias("d1"), none.alias("d2"))
    order = ["conv_id", "chunk", "depth", "kind"]
    sums = steps.union(values).repartition("conv_id", "chunk").sortWithinPartitions(*order).mapInArrow(_accumulate, "d1 long, d2 long, n_leaves long, saved_tokens long")
    sums = sums.groupBy("d1", "d2").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    # every conversation is a member of the root; its children's sums are its own
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("turns").alias("_fewest"))
    below = nodes.where("depth = 1").join(sums, ["d1", "d2"]).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    root = whole.crossJoin(below).where("n_convs > 0").select(
        none.alias("d1"), none.alias("d2"), "conv_id", none.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved_tokens", none).alias("saved_tokens"),
    )
    first = F.broadcast(convs.agg(F.min("conv_id").alias("_first")))
    parents = nodes.where("n_children > 0").select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    rest = nodes.join(sums, ["d1", "d2"])
    columns = root.columns
    top = rest.where("depth = 1").crossJoin(first).withColumn("parent_conv_id", F.col("_first")).select(columns)
    lower = rest.where("depth > 1").join(parents, ["p1", "p2"]).select(columns)
    ends = path.join(convs, "conv_id").where("depth = turns").select("d1", "d2", "conv_id")
    ends = ends_of(ends.union(convs.where("turns = 0").select(none.alias("d1"), none.alias("d2"), "conv_id")))
    out = root.union(top).union(lower).join(ends, ["d1", "d2"], "left")
    return out.withColumn("ends_sha256", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))).drop("ends")

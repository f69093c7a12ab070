"""Cutting a corpus into shards of nearly equal bytes."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import written

#: Bits of the group key that name a span: 65,536 spans first; an opened span has up to 256 inside it.
FIRST_BITS, NEXT_BITS = 16, 8
#: A span of more than this part of all bytes is opened in any case.
HEAVY = 8 / (1 << FIRST_BITS)
#: Parts of a shard whose slots are numbered separately.
SLOT_PARTS = 1024


class Span(NamedTuple):
    """The groups whose key has these first bits."""

    start: int
    bits: int
    size: int
    groups: int
    largest: int

    @property
    def end(self) -> int:
        return self.start + (1 << (64 - self.bits)) - 1

    @property
    def divisible(self) -> bool:
        return self.groups > 1 and self.bits < 64


def _summary(groups: DataFrame, bits: int, within: tuple[int, list[int]] | None = None) -> list[Span]:
    if within:
        outer, places = within
        wanted = groups.sparkSession.createDataFrame([(p,) for p in places], "_p long")
        groups = groups.join(F.broadcast(wanted), F.shiftright("key", 64 - outer) == F.col("_p"), "left_semi")
    place = F.shiftright("key", 64 - bits) if bits < 64 else F.col("key")
    rows = groups.groupBy(place.alias("p")).agg(F.sum("size"), F.count("*"), F.max("size")).collect()
    return [Span(p << (64 - bits), bits, size, n, most) for p, size, n, most in rows]


def _open(groups: DataFrame, spans: list[Span], chosen: set[Span]) -> list[Span]:
    kept = [s for s in spans if s not in chosen]
    for bits in {s.bits for s in chosen}:
        kept += _summary(groups, bits + NEXT_BITS, (bits, [s.start >> (64 - bits) for s in chosen if s.bits == bits]))
    return sorted(kept)


def _greedy(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """How many atoms lie before each shard's end if `shards` shards of this capacity hold all, else None."""
    cuts, at, start = [], 0, 0
    for _ in range(shards):
        to = bisect_right(ends, start + capacity, at)
        cuts.append(to)
        at, start = to, ends[to - 1] if to else 0
    return cuts if at == len(ends) else None


def smallest_capacity(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity at which the greedy check succeeds, by binary search, and the cuts there."""
    ends = list(accumulate(sizes))
    low, high = max(max(sizes), -(-ends[-1] // shards)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low, _greedy(ends, low, shards)


def _touched(spans: list[Span], low: int, high: int, shards: int) -> set[Span]:
    """Divisible spans in which a greedy cut can fall at some capacity from low to high.

    The j-th cut lies no further left than where the walk with `low` and undivided spans has it, and
    no further right than where the walk with `high` and spans divided at will has it.
    """
    ends = list(accumulate(s.size for s in spans))
    slow = fast = 0
    out: set[Span] = set()
    for _ in range(shards - 1):
        at = bisect_right(ends, slow + low)
        slow = ends[at - 1] if at else 0
        fast = min(fast + high, ends[-1])
        to = min(bisect_right(ends, fast), len(spans) - 1)
        if not spans[to].divisible and fast < ends[-1]:
            fast = ends[to] - spans[to].size
        out.update(s for s in spans[at : to + 1] if s.divisible)
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Last key of each shard but the last, for the contiguous partition of groups (key, size) with the least largest shard.

    Groups are ordered by key.  The driver holds sums over spans of the key, never the groups: 65,536
    spans, and finer ones inside heavy spans and those in which a cut can fall.  Taking spans as whole
    atoms gives an upper bound of the best capacity, dividing them at will a lower bound; spans
    are opened until no cut between those bounds depends on what a span holds.  Then the binary search
    over spans is exact.
    """
    spans = sorted(_summary(groups, FIRST_BITS))
    if not spans:
        return [(1 << 63) - 1] * (shards - 1)
    total = sum(s.size for s in spans)
    while heavy := {s for s in spans if s.divisible and s.size > HEAVY * total}:
        spans = _open(groups, spans, heavy)
    while True:
        high, cuts = smallest_capacity([s.size for s in spans], shards)
        low = max(max(s.largest for s in spans), -(-total // shards))
        touched = _touched(spans, low, high, shards)
        if not touched:
            return [spans[c - 1].end if c else -(1 << 63) - 1 for c in cuts[:-1]]
        spans = _open(groups, spans, touched)


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Every row of docs (doc_id, text) with its shard; rows of equal text share a shard.

    Atomic groups are the rows of one text (by a 64-bit hash of it), in the order of that hash.  A group
    of at least the average that is left gets a shard of its own, the largest first; the other groups
    are cut by the minimax contiguous partition over the shards that remain.

    Result: doc_id, text, size (UTF-8 bytes of the text plus 1), text_crc32, shard, slot (from 0 without
    gaps in each shard).  Null text: size 1, crc32 0, one group.  Repeated rows get slots of their own.
    An empty table gives no rows; shards without rows occur if there are too few groups.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select("doc_id", "text", size.alias("size"), F.xxhash64("text").alias("_key"))
    groups = written(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("size")))
    left, alone = groups.agg(F.sum("size")).first()[0] or 0, []
    for key, held in groups.orderBy(F.desc("size"), "key").limit(shards).collect():
        if len(alone) < shards - 1 and held * (shards - len(alone)) >= left:
            alone.append(key)
            left -= held
        else:
            break
    cuts = minimax_cuts(groups.where(~F.col("key").isin(alone)) if alone else groups, shards - len(alone))
    shard: Column = F.lit(len(alone))
    for cut in cuts:
        shard = shard + (F.col("_key") > max(cut, -(1 << 63))).cast("int") if cut >= -(1 << 63) else shard + 1
    for k, key in enumerate(alone):
        shard = F.when(F.col("_key") == key, k).otherwise(shard)
    part = F.pmod(F.xxhash64("doc_id", "_key"), F.lit(SLOT_PARTS))
    rows = rows.select(
        "doc_id", "text", "size", F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"), shard.cast("int").alias("shard"), part.alias("_part")
    )
    counts = rows.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id")) - 1)
    return numbered.join(counts, ["shard", "_part"]).select(
        "doc_id", "text", "size", "text_crc32", "shard", (F.col("_before") + F.col("_at")).cast("long").alias("slot")
    )

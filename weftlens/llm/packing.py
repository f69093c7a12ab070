"""Packing documents into training sequences by the best-two-fit rule."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import in_small_batches, written
from .scan import Texts, texts

#: Pieces that one task ranks, if they are all of one size.
RANKED = 1 << 18
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 1_000_000

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_HIGH = np.arange(256) >= 128


class WordIds:
    """Token ids of whole texts, from the ids of their distinct words.

    For a tokenizer that lower-cases and never joins text across white space, so a text's ids
    are its words' ids in turn.  A run of ASCII punctuation that ends a word after an ASCII letter or
    digit is a piece of its own there, and is kept apart so that fewer distinct words are met.  A word
    with "<" is left as it is, because it may hold a special token.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _parts(self, t: Texts, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pieces and which are to be taken as written."""
        starts, ends, _ = t.words()
        opens = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x3C, out=opens[1:])
        odd = opens[ends] > opens[starts]
        solid = _ALNUM[data] | _HIGH[data]
        last = np.maximum.accumulate(np.where(solid, np.arange(len(data)), -1)) if len(data) else np.zeros(0, np.int64)
        cut = last[ends - 1] + 1
        split = (cut > starts) & (cut < ends) & ~odd
        split[split] = _ALNUM[data[cut[split] - 1]]
        begin = np.sort(np.concatenate([starts, cut[split]]))
        end = np.sort(np.concatenate([ends, cut[split]]))
        return begin, end, np.isin(begin, starts[odd])

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        length = np.array([len(x) for x in ids], np.int64)
        at = len(self.flat) + np.concatenate([[0], np.cumsum(length)[:-1]]).astype(np.int64)
        self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.uint32)])
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.at = np.insert(self.at, where, at)
        self.length = np.insert(self.length, where, length)

    def of(self, t: Texts) -> Iterator[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        begin, end, odd = self._parts(t, t.data)
        data = t.lowered()
        hashes = t.span_hash(t.prefix_hash(data), begin, end)
        if odd.any():
            hashes[odd] = t.span_hash(t.prefix_hash(t.data), begin[odd], end[odd]) ^ np.uint64(0x5555555555555555)
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = np.ones(len(unique), bool) if not len(self.known) else self.known[place] != unique
        if new.any():
            raw, low = t.data.tobytes(), data.tobytes()
            at = first[new]
            self._learn(unique[new], [(raw if odd[k] else low)[begin[k] : end[k]].decode("utf-8", "replace") for k in at.tolist()])
        place = np.searchsorted(self.known, unique)
        length = self.length[place][inverse]
        at = self.at[place][inverse]
        total = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        ids = self.flat[np.repeat(at - total[:-1], length) + np.arange(total[-1])]
        edges = total[np.searchsorted(begin, t.offsets)]
        for k in range(t.n):
            yield ids[edges[k] : edges[k + 1]]


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One instance a Python worker, so that words stay known from task to task."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, closing: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and a closing id; only longer ones are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = word_ids(tokenizer)
        end = np.array([closing], np.uint32)
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            k = 0
            for t in texts(batch.column(1)):
                for ids in source.of(t):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        part = ids[start : start + capacity]
                        rows.append((k, start // capacity, start, len(part), zlib.crc32(part.tobytes())))
                    k += 1
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Bins(NamedTuple):
    """`times` bins that each hold pieces of these sizes."""

    sizes: tuple[int, ...]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Bins]:
    """All pieces in bins, from how many there are of each size.

    A bin is filled greedily, the largest piece that fits first.  Then, as long as it helps, its smallest
    piece gives way to the two unpacked ones that fill the gap it leaves best, if they fill more
    than it did.  The next bins come out the same until a size runs short, so they are counted, not repeated:
    the work follows the number of sizes (at most `capacity`), not the number of pieces.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    out: list[Bins] = []
    while sizes:
        used: dict[int, int] = {}
        held: list[int] = []

        def free(s: int) -> int:
            return left[s] - used.get(s, 0)

        def fill(gap: int) -> int:
            at = bisect_right(sizes, gap) - 1
            while at >= 0:
                s = sizes[at]
                n = min(free(s), gap // s)
                if n:
                    used[s] = used.get(s, 0) + n
                    held.extend([s] * n)
                    gap -= n * s
                at = min(at - 1, bisect_right(sizes, gap) - 1)
            return gap

        gap = fill(capacity)
        while gap and held:
            small = min(held)
            room = gap + small
            open_ = np.array([s for s in sizes[: bisect_right(sizes, room - 1)] if free(s) > 0], np.int64)
            if not len(open_):
                break
            other = np.searchsorted(open_, room - open_, "right") - 1
            same = other == np.arange(len(open_))
            if same.any():
                single = same & np.array([free(int(s)) < 2 for s in open_])
                other[single] -= 1
            sums = np.where(other >= 0, open_ + open_[other], 0)
            best = int(np.argmax(sums))
            if sums[best] <= small:
                break
            a, b = int(open_[best]), int(open_[other[best]])
            held.remove(small)
            used[small] -= 1
            for s in (a, b):
                used[s] = used.get(s, 0) + 1
                held.append(s)
            gap = fill(room - a - b)
        times = min(left[s] // n for s, n in used.items() if n)
        out.append(Bins(tuple(sorted(held, reverse=True)), times))
        for s, n in used.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
                del sizes[bisect_right(sizes, s) - 1]
    return out


def _slots(plan: list[Bins]) -> tuple[np.ndarray, ...]:
    """For runs of ranks in a size: key (size and first rank), first rank, sequence of the first, and offset."""
    rank: dict[int, int] = {}
    rows, base = [], 0
    for bins in plan:
        offset = 0
        for s in bins.sizes:
            first = rank.get(s, 0)
            rows.append(((s << 44) + first, first, base, offset))
            rank[s] = first + bins.times
            offset += s
        base += bins.times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, closing: int = 1) -> DataFrame:
    """Every row of docs (doc_id, text) in pieces, each with its sequence and its offset there.

    The driver plans from the number of pieces of each size, at most `capacity` numbers however many
    documents there are.  A piece's rank among those of its size (counted in parts, so that a
    common size is no task of its own) then names its sequence.

    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null or empty text: one piece,
    the closing id alone.  A text of any length is tokenized whole.  Repeated rows and null doc_ids are
    packed like others.  No rows: no rows.  Other columns are left out.
    """
    cut = written(pieces(docs, tokenizer, capacity, closing))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots = docs.sparkSession.sparkContext.broadcast(_slots(best_two_fit(counts, capacity)))
    parts = max(64, -(-sum(counts.values()) // RANKED))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))
    rows = cut.withColumn("_part", part)
    sums = rows.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("_at", F.row_number().over(inside) - 1).join(sums, ["length", "_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_at")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, base, offset = slots.value
        for batch in batches:
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(key, (batch.column(3).to_numpy() << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(base[at] + rank - first[at]), pa.array(offset[at])], [*batch.schema.names[:5], "sequence_id", "offset"]
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

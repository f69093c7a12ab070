"""Removal of repeated and nearly repeated lines across a corpus."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import beside, components, fresh, in_small_batches, written
from .scan import Texts, mix, slices, texts

#: Lines with fewer words are never similar to others, only equal: what short lines share is chance.
MIN_WORDS = 5
#: The fingerprint falls into this many blocks; lines meet if they have AGREE of them in common, so always if MOST_SURE bits differ.
BLOCKS, AGREE = 5, 2
MOST_SURE = BLOCKS - AGREE
#: Lines that meet are compared if at most this many of 64 bits differ.
MOST_BITS = 10
SIMILARITY = 0.9
#: Lines of a bucket that are all compared by their bits; in larger buckets all stay candidates.
SMALL = 64
#: Letters in a row that two lines have in common where a walk along both goes on after an edit.
ANCHOR = 5

_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[128:] = np.arange(128, 256)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[48:58] = 48
#: The eight bits of a byte as eight bytes, most significant first.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]
#: First bytes of three-byte characters of scripts without spaces between words (kana, Han, Hangul).
_ALONE = np.zeros(256, bool)
_ALONE[0xE3:0xEE] = True


def normalised(line: str) -> str:
    """ASCII letters lower-cased, digits as 0, other ASCII characters as single spaces."""
    return " ".join(_NORMAL[np.frombuffer(line.encode("utf-8", "replace"), np.uint8)].tobytes().decode("utf-8", "replace").split(" ")).strip() if line else ""


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: runs between spaces inside a text; a character of a script without spaces is a word of its own."""
    solid = data != 0x20
    alone = np.flatnonzero(_ALONE[data])
    alone = alone[alone + 3 <= len(data)]
    cut = np.zeros(len(data) + 1, bool)
    cut[alone] = True
    cut[alone + 3] = True
    cut[offsets] = True
    space = ~solid
    cut[:-1] |= space
    cut[1:] |= space
    starts = np.flatnonzero(solid & cut[:-1])
    ends = np.flatnonzero(solid & np.append(cut[1:-1], True)) + 1
    return starts, ends


def _simhash(words: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """SimHash of each line's set of words: words[i] is in line[i], which rises from 0 to n - 1."""
    out = np.zeros(n, np.uint64)
    for lo in range(0, n, 1 << 20):
        a, b = np.searchsorted(line, [lo, lo + (1 << 20)])
        keys = np.sort(((line[a:b] - lo).astype(np.uint64) << np.uint64(40)) | (words[a:b] >> np.uint64(24)))
        keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
        owner = (keys >> np.uint64(40)).astype(np.int64)
        bits = _SPREAD[mix(keys & np.uint64((1 << 40) - 1)).view(np.uint8).reshape(-1, 8)]
        count = np.bincount(owner)
        edge = np.cumsum(count) - count
        # eight counters in a word hold up to 255 each, so sums are taken over pieces of at most 255 words
        pieces = -(-count // 255)
        piece = np.repeat(edge, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        part = np.add.reduceat(bits, piece, axis=0).view(np.uint8).reshape(len(piece), 64)
        sums = np.add.reduceat(part, np.cumsum(pieces) - pieces, axis=0, dtype=np.int32)
        out[lo : lo + len(count)] = np.packbits(2 * sums > count[:, None], axis=1).copy().view(np.uint64)[:, 0]
    return out


class Lines:
    """The lines of some texts that are compared: text, number in the text, number of words, and hash of the words."""

    def __init__(self, t: Texts, min_words: int = MIN_WORDS):
        cuts = np.flatnonzero(t.data == 10)
        owner = np.concatenate([np.arange(t.n), np.searchsorted(t.offsets, cuts, "right") - 1])
        start = np.concatenate([t.offsets[:-1], cuts + 1])
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        first = np.searchsorted(owner, np.arange(t.n))
        number = np.arange(len(owner)) - first[owner]
        end = np.append(start[1:] - 1, 0)
        last = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        end[last] = t.offsets[owner[last] + 1]
        data = _NORMAL[t.data]
        begin, stop = _words(data, t.offsets)
        a, b = np.searchsorted(begin, start), np.searchsorted(begin, end)
        letters = np.append(0, np.cumsum(data > 57))
        some = np.flatnonzero((b - a >= min_words) | ((b > a) & (letters[end] > letters[start])))
        self.owner, self.number, self.count, self._first = owner[some], number[some], (b - a)[some], a[some]
        self._text, self._begin, self._stop, self._data, self.min_words = t, begin, stop, data, min_words

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        """For each line the hash of its words in order, and the SimHash of its set of words."""
        if not len(self.owner):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words = Texts.span_hash(self._text.prefix_hash(self._data), self._begin, self._stop)
        edges = np.cumsum(self.count) - self.count
        line = np.repeat(np.arange(len(self.count)), self.count)
        place = np.arange(len(line)) - edges[line]
        mine = words[self._first[line] + place]
        whole = mix(np.add.reduceat(mix(mine + mix(place.astype(np.uint64) + np.uint64(1))), edges) + self.count.astype(np.uint64))
        return whole.view(np.int64), _simhash(mine, line, len(self.count)).view(np.int64)


def _occurrences(keyed: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, row, line, hash, mark) of the lines to compare; those of fewer than min_words words have no mark."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(2)):
                found = Lines(t, min_words)
                whole, marks = found.hashed()
                at = pa.array(found.owner + t.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at), batch.column(1).take(at), pa.array(found.number.astype(np.int32)), pa.array(whole),
                        pa.array(marks, mask=found.count < min_words),
                    ],
                    ["doc_id", "row", "line", "hash", "mark"],
                )

    return keyed.mapInArrow(find, "doc_id long, row long, line int, hash long, mark long")


def _keys(mark: Column) -> Column:
    """The pigeonhole keys of a fingerprint: each choice of AGREE blocks, with which they are."""
    edges = [round(k * 64 / BLOCKS) for k in range(BLOCKS + 1)]
    block = [F.shiftrightunsigned(mark, edges[k]).bitwiseAND((1 << (edges[k + 1] - edges[k])) - 1) for k in range(BLOCKS)]
    out = []
    for n, chosen in enumerate(combinations(range(BLOCKS), AGREE)):
        key = F.lit(n).cast("long")
        for k in chosen:
            key = F.shiftleft(key, edges[k + 1] - edges[k]).bitwiseOR(block[k])
        out.append(key)
    return F.array(*out)


def _near_in_run(run: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Which rows have a mark near to that of another row of their run (equal values of run, which are neighbours)."""
    near = np.zeros(len(run), bool)
    _, start, size = np.unique(run, return_index=True, return_counts=True)
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        near[s : s + n] = True
    most = int(size[size <= SMALL].max(initial=1))
    at = np.flatnonzero(~near)
    for step in range(1, most):
        at = at[at + step < len(run)]
        at = at[run[at] == run[at + step]]
        hit = at[np.bitwise_count(mark[at] ^ mark[at + step]) <= MOST_BITS]
        near[hit] = True
        near[hit + step] = True
    return near


def _buckets(lines: DataFrame) -> DataFrame:
    """(key, hash, mark, head, close) of lines that share a key with one near to them; close: near to the head, a line of the bucket.

    Keys are sorted by range, so that a key of very many lines falls to several tasks; each task goes through its
    keys as a stream.  A key that may go on in another task keeps all its lines there, and a head in each.
    """
    rows = lines.where("mark is not null").select("hash", "mark", F.explode(_keys(F.col("mark"))).alias("key"))
    ordered = rows.select("key", "hash", "mark").repartitionByRange("key", "hash").sortWithinPartitions("key", "hash")
    names = ["key", "hash", "mark", "head", "close"]

    def table(key: np.ndarray, line: np.ndarray, mark: np.ndarray, head: np.ndarray, head_mark: np.ndarray) -> pa.RecordBatch:
        close = np.bitwise_count(mark ^ head_mark) <= MOST_BITS
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(line), pa.array(mark.view(np.int64)), pa.array(head), pa.array(close)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        open_, first, head = (none, none, none.view(np.uint64)), None, None

        def done(key: np.ndarray, line: np.ndarray, mark: np.ndarray, whole: np.ndarray) -> pa.RecordBatch | None:
            near = _near_in_run(key, mark) | np.isin(key, whole)
            key, line, mark = key[near], line[near], mark[near]
            if not len(key):
                return None
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            at = np.repeat(start, np.diff(np.append(start, len(key))))
            return table(key, line, mark, line[at], mark[at])

        for batch in batches:
            mine = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64))
            if head is not None:  # a large bucket goes on
                n = int(np.searchsorted(mine[0], head[0], "right"))
                if n:
                    yield table(mine[0][:n], mine[1][:n], mine[2][:n], np.full(n, head[1]), np.full(n, head[2], np.uint64))
                if n == len(mine[0]):
                    continue
                mine, head = tuple(x[n:] for x in mine), None
            key, line, mark = (np.concatenate([a, b]) for a, b in zip(open_, mine))
            if not len(key):
                continue
            if first is None:
                first = key[0]
            last = int(np.searchsorted(key, key[-1]))
            if out := done(key[:last], line[:last], mark[:last], np.array([first])):
                yield out
            open_ = (key[last:], line[last:], mark[last:])
            if len(open_[0]) > SMALL:
                yield table(*open_, np.full(len(open_[0]), open_[1][0]), np.full(len(open_[0]), open_[2][0], np.uint64))
                head, open_ = (open_[0][0], open_[1][0], open_[2][0]), (none, none, none.view(np.uint64))
        if len(open_[0]) and (out := done(*open_, open_[0][:1])):
            yield out

    return ordered.mapInArrow(meet, "key long, hash long, mark long, head long, close boolean")


def _bodies(keyed: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, body): normalised lines of the wanted hashes, each read where it occurs first; a text is read once."""
    places = lines.join(wanted, "hash").groupBy(F.col("first.row").alias("row"))
    places = written(places.agg(F.collect_list(F.struct("hash", "first.line")).alias("at")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                hashes, bodies = [], []
                for text, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    parts = text.split("\n")
                    hashes += [x["hash"] for x in at]
                    bodies += [normalised(parts[x["line"]]) for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(bodies, pa.string())], ["hash", "body"])

    found = keyed.select("row", "text").join(beside(places), "row").select("text", "at")
    return written(found.mapInArrow(fetch, "hash long, body string").dropDuplicates(["hash"]))


def _same_length(x: str, y: str, ends: bool) -> int:
    """Length of the longest common prefix of x and y, or suffix, by halving."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if (x[len(x) - mid : len(x) - lo] == y[len(y) - mid : len(y) - lo]) if ends else x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _pairs_of_letters(x: str) -> np.ndarray:
    """How many neighbouring letters of each kind x has; kinds are dealt to 1024 counters."""
    code = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount((code[:-1] * np.uint32(31) + code[1:]) & np.uint32(1023), minlength=1024)


def walked(x: str, y: str, most: int) -> bool:
    """Whether a walk along x and y finds a way of at most `most` edits from one to the other; if not, there may still be one.

    Where they part, the walk goes on at the nearest place where both have the same ANCHOR letters; what lies between counts as
    edits, as many as the longer side has letters.  The radius of the search doubles and never passes the edits left, so a walk
    costs what the lines and the edits that they have are long, where a table of distances would cost their product.
    """
    i = j = 0
    while max(len(x) - i, len(y) - j) > most:
        step = 16
        while i < len(x) and x[i : i + step] == y[j : j + step]:
            i, j, step = i + step, j + step, 2 * step
        same = _same_length(x[i : i + step], y[j : j + step], False)
        i, j = i + same, j + same
        if i >= len(x) or j >= len(y):
            return max(len(x) - i, len(y) - j) <= most
        radius, found = 2, None
        while not found:
            reach = min(radius, most)
            for s in range(reach + 1):
                if s > reach:
                    break
                t = y.find(x[i + s : i + s + ANCHOR], j, j + reach + ANCHOR) - j
                if 0 <= t <= reach and (not found or max(s, t) < reach):
                    found, reach = (s, t), max(s, t)
            if not found and radius >= most:
                return False
            radius *= 2
        i, j, most = i + found[0], j + found[1], most - reach
    return True


def between(x: str, y: str, similarity: float) -> tuple[str, str, int]:
    """x and y without what they have in common at their ends, and the edits that similar ones have at most.

    -1 if there must be more (one edit changes at most four counts of neighbouring letters); two empty strings if there can't be,
    or a walk finds that there aren't.
    """
    most = int((1 - similarity + 1e-9) * max(len(x), len(y)))
    if abs(len(x) - len(y)) > most:
        return "", "", -1
    k = _same_length(x, y, False)
    x, y = x[k:], y[k:]
    k = _same_length(x, y, True)
    x, y = x[: len(x) - k], y[: len(y) - k]
    if walked(x, y, most):
        return "", "", most
    if np.abs(_pairs_of_letters(x) - _pairs_of_letters(y)).sum() > 4 * most:
        return "", "", -1
    return x, y, most


def _verified(pairs: DataFrame, bodies: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of line hashes whose normalised lines have edit similarity of at least `similarity`."""
    x, y = bodies.select(F.col("hash").alias("a"), F.col("body").alias("x")), bodies.select(F.col("hash").alias("b"), F.col("body").alias("y"))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                rows = [between(a, b, similarity) for a, b in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
                left, right, most = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(most, pa.int32())], ["a", "b", "x", "y", "most"])

    sides = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    cut = sides.mapInArrow(trim, "a long, b long, x string, y string, most int")
    return cut.where("most >= 0").where("x = '' and y = '' or levenshtein(x, y, most) >= 0").select("a", "b")


def _groups(keyed: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """(node, root) for lines that a chain of similar lines connects.

    All lines of a bucket are compared with the bucket's head; then, where a bucket still has lines of several
    groups, the lines of different groups with each other.
    """
    shared = written(_buckets(lines))
    bodies = _bodies(keyed, lines, shared.select("hash").distinct())
    pairs = shared.where("close and hash <> head").select(F.least("hash", "head").alias("a"), F.greatest("hash", "head").alias("b")).distinct()
    pairs = written(pairs)
    first = written(_verified(pairs, bodies, similarity))
    labels = components(first)
    named = shared.select("key", "hash", "mark").join(labels.withColumnRenamed("node", "hash"), "hash", "left").withColumn("comp", F.coalesce("root", "hash"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    named = written(named.select("key", "hash", "mark", "comp").join(mixed, "key"))
    x, y = named.alias("x"), named.alias("y")
    near = F.bit_count(F.col("x.mark").bitwiseXOR(F.col("y.mark"))) <= MOST_BITS
    again = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & near)
    again = again.select(F.least("x.hash", "y.hash").alias("a"), F.greatest("x.hash", "y.hash").alias("b")).distinct()
    return components(first.union(_verified(again.join(pairs, ["a", "b"], "left_anti"), bodies, similarity)))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs (doc_id, text, ...) without repeated lines; adds n_lines (lines compared) and n_removed.

    Lines (split at line feeds) are normalised and hashed; equal ones are one line at any length, if they hold a letter
    or min_words words.  Different lines of at least min_words words are similar if the normalised lines have an edit similarity
    (1 - distance / longer length) of at least `similarity`, and are found if the SimHashes of their sets of words share
    two of five blocks (which is sure where at most 3 of 64 bits differ) and differ in at most 10 bits; tests and README
    give the recall against edit similarity alone.  A word is a run between ASCII characters other than letters and
    digits; a character of Chinese, Japanese or Korean is a word.  Of each connected group one occurrence stays: the first by
    doc_id (null last), then line.  Other lines stay as they are.

    Null and empty texts stay.  Rows equal in doc_id and text count as one document and come out equal.
    Columns named n_lines or n_removed are replaced; all others are kept, whatever their names.  No rows: no rows.
    """
    row, gone_ = fresh(docs.columns, "row"), fresh(docs.columns, "gone")
    hashed = in_small_batches(docs).withColumn(row, F.xxhash64("doc_id", "text"))
    keyed = hashed.select("doc_id", F.col(row).alias("row"), "text")
    occurrences = written(_occurrences(keyed, min_words))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")
    lines = occurrences.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("held"), F.first("mark").alias("mark"))
    lines = written(lines)
    groups = _groups(keyed, lines, similarity)
    rooted = lines.join(groups.withColumnRenamed("node", "hash"), "hash", "left").where("held > 1 or root is not null")
    rooted = written(rooted.select("hash", "root", "first"))
    best = written(rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("best")))
    repeated = written(rooted.join(best, "root", "left").select("hash", F.coalesce("best", "first").alias("best")))
    gone = occurrences.join(repeated, "hash").where((F.col("row") != F.col("best.row")) | (F.col("line") != F.col("best.line")))
    lists = written(gone.groupBy(F.col("row").alias(row)).agg(F.collect_set("line").alias(gone_)))
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    at = [c.lower() for c in kept].index("text")
    joined = hashed.select(*kept, row).join(beside(lists), row, "left").select(*kept, gone_)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                found = Lines(next(texts(part.column(at), 1 << 62)), min_words)
                n_lines = np.bincount(found.owner, minlength=part.num_rows)
                out, removed = [], []
                for text, gone in zip(part.column(at).to_pylist(), part.column(len(kept)).to_pylist()):
                    drop = set(gone or ())
                    out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop) if drop else text)
                    removed.append(len(drop))
                columns = list(part.columns[:-1])
                columns[at] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64())], [*kept, "n_lines", "n_removed"])

    return joined.mapInArrow(rebuild, joined.drop(gone_).schema.add("n_lines", "long").add("n_removed", "long"))

"""Removal of byte strings that occur earlier in a corpus, by Burrows-Wheeler order built column by column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .jobs import written
from .scan import Texts, slices, texts

#: Bytes of the grams by which equal strings find each other; a string holds LENGTH - GRAM + 1 of them.
GRAM = 32
#: Fragments of a bucket, about, in which suffixes are sorted together; a group of more than LARGE falls apart into its strings.
BUCKET, LARGE = 16_384, 16_384


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of keys[i:i + width] for each i that has so many, by running minima of blocks from both sides."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, keys.dtype)
    pad = -len(keys) % width
    block = np.concatenate([keys, np.full(pad, np.iinfo(keys.dtype).max, keys.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(block, 1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def fragments(t: Texts, length: int) -> tuple[np.ndarray, ...]:
    """Runs of strings (of `length` bytes, inside one text) that have their least gram in common.

    Returns text, first start, number of starts, distance from the first start to the gram, hash of the gram, and hash of all bytes of the run.  Which gram of
    a string is the least depends on its bytes alone (the leftmost of equals), so equal strings lie in runs
    with equal grams, at equal distances from them.
    """
    none = (np.zeros(0, np.int64),) * 6
    if len(t.data) < length:
        return none
    sums = t.prefix_hash(t.data)
    at = np.arange(len(t.data) - GRAM + 1)
    grams = t.span_hash(sums, at, at + GRAM)
    low = np.uint64((1 << max(22, int(len(grams)).bit_length())) - 1)
    anchor = (sliding_least((grams & ~low) | at.astype(np.uint64), length - GRAM + 1) & low).astype(np.int64)
    starts = np.arange(len(anchor))
    text = np.searchsorted(t.offsets, starts, "right") - 1
    inside = starts + length <= t.offsets[text + 1]
    starts, text, anchor = starts[inside], text[inside], anchor[inside]
    if not len(starts):
        return none
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    whole = t.span_hash(sums, begin, begin + count - 1 + length)
    return text[first], begin - t.offsets[text[first]], count, anchor[first] - begin, grams[anchor[first]].view(np.int64), whole.view(np.int64)


def repeats(rows: list[bytes], ahead: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, number of starts) of the runs of strings of `length` bytes that are also in a row of lower rank, as far from its gram.

    Rows are laid with their grams, `ahead` bytes from their starts, in one column.  From the last column to the first, each round
    inserts one symbol of every row (the multi-document construction of the Burrows-Wheeler transform by columns, after Bauer, Cox
    and Rosone): the symbols in the order of the suffixes behind them are the transform's column; sorting them by
    value, the sort being stable, gives the order of the longer suffixes.  The common prefix of two neighbours that have the same
    symbol is one more than the least of the common prefixes between them in the order before; else it is zero.
    Neighbours with a common prefix of `length` or more start with the same string.
    """
    size = np.array([len(r) for r in rows], np.int64)
    m, base = len(rows), int(ahead.max(initial=0))
    width = int((base - ahead + size).max(initial=0))
    symbols = np.zeros((width, m), np.uint16)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbols[np.repeat(base - ahead, size) + inside, np.repeat(np.arange(m), size)] = np.frombuffer(b"".join(rows), np.uint8).astype(np.uint16) + 1
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    later = np.zeros((m, base + 2), bool)
    for column in range(width - 1, -1, -1):
        mine = symbols[column][order]
        place = np.argsort(mine, kind="stable")
        mine = mine[place]
        k = np.flatnonzero((mine[1:] == mine[:-1]) & (mine[1:] > 0)) + 1
        longer = np.zeros(m + 1, np.int32)
        if len(k):
            between = np.stack([place[k - 1] + 1, place[k] + 1], 1).reshape(-1)
            longer[k] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[place], longer
        if column <= base and (common >= length).any():
            run = np.flatnonzero(common[:m] < length)
            least = np.minimum.reduceat(rank[order], run)
            again = rank[order] > np.repeat(least, np.diff(np.append(run, m)))
            later[order[again], column + 1] = True
    step = np.diff(later.astype(np.int8), axis=1, append=0)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first - (base - ahead[row]), last - first


FOUND = "gram long, whole long, doc_id long, row long, start long, n long, ahead long"


def _occurrences(keyed: DataFrame, length: int) -> DataFrame:
    """Fragments of all texts; of equal ones in a batch the first, and the others as bytes to remove (gram null, n bytes)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(t.first, *fragments(t, length)) for t in texts(batch.column(2))]
            if not parts:
                continue
            text = np.concatenate([p[0] + p[1] for p in parts])
            start, n, ahead, gram, whole = (np.concatenate([p[k] for p in parts]) for k in range(2, 7))
            ids = batch.column(0)
            blank = np.asarray(ids.is_null())
            docs, row = ids.fill_null(0).to_numpy(), batch.column(1).to_numpy()
            place = np.empty(len(docs), np.int64)
            keys = np.stack([blank.astype(np.int64), docs, row], 1)
            place[:] = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
            order = np.lexsort((start, place[text], whole))
            text, start, n, ahead, gram, whole = (x[order] for x in (text, start, n, ahead, gram, whole))
            again = np.zeros(len(whole), bool)
            again[1:] = whole[1:] == whole[:-1]
            first = np.flatnonzero(~again)[np.cumsum(~again) - 1] if len(whole) else np.zeros(0, np.int64)
            twin = again & (place[text] == place[text[first]]) & (start == start[first])  # the same document in another row
            gone = again & ~twin
            held = ~again
            g_text, g_start, g_end = text[gone], start[gone], start[gone] + n[gone] - 1 + length
            order = np.lexsort((g_start, g_text))
            g_text, g_start, g_end = g_text[order], g_start[order], g_end[order]
            fresh = np.ones(len(g_text), bool)
            fresh[1:] = (g_text[1:] != g_text[:-1]) | (g_start[1:] > g_end[:-1])
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(g_text))[: len(heads)] - 1
            at = pa.array(np.concatenate([text[held], g_text[heads]]))
            none = [None] * len(heads)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([pa.array(gram[held]), pa.array(none, pa.int64())]),
                    pa.concat_arrays([pa.array(whole[held]), pa.array(none, pa.int64())]),
                    ids.take(at), batch.column(1).take(at),
                    pa.array(np.concatenate([start[held], g_start[heads]])), pa.array(np.concatenate([n[held], g_end[tails] - g_start[heads]])),
                    pa.array(np.concatenate([ahead[held], np.zeros(len(heads), np.int64)])),
                ],
                ["gram", "whole", "doc_id", "row", "start", "n", "ahead"],
            )

    return keyed.select("doc_id", "_row", "text").mapInArrow(find, FOUND)


def _told_apart(found: DataFrame) -> DataFrame:
    """Fragments whose gram occurs again, with `place` (1: the first of equal ones) and `kin` (different fragments with the gram).

    Rows without a gram pass through, each under a key of its own.
    """
    keyed = found.withColumn("_key", F.coalesce("gram", F.xxhash64("row", "start", "n")))
    by_gram, equal = Window.partitionBy("_key"), Window.partitionBy("_key", "whole")
    order = equal.orderBy(F.col("doc_id").isNull(), "doc_id", "row", "start")
    again = keyed.withColumn("_c", F.count("gram").over(by_gram)).where("_c > 1 or gram is null")
    again = again.withColumn("place", F.when(F.col("gram").isNotNull(), F.rank().over(order)).otherwise(0))
    return again.withColumn("kin", F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).over(by_gram)).drop("_c", "_key")


def _read(keyed: DataFrame, wanted: DataFrame, length: int, apart: bool) -> DataFrame:
    """wanted with the bytes of each fragment; with `apart`, its strings one by one, each under its own hash as gram.  A text is read once."""
    parts = wanted.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_set(F.struct("start", "n", "ahead", "gram", "whole")).alias("parts"))
    parts = written(parts)
    names = ["gram", "whole", "doc_id", "row", "start", "n", "ahead"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 0):
                out: list[list[np.ndarray]] = []
                ids, bodies = [], []
                for text, doc, row, held in zip(*(c.to_pylist() for c in some.columns)):
                    raw = text.encode()
                    for x in held:
                        body = raw[x["start"] : x["start"] + x["n"] - 1 + length]
                        if not apart:
                            out.append([np.array([v]) for v in (x["gram"], x["whole"], row, x["start"], x["n"], x["ahead"])])
                            ids.append(doc)
                            bodies.append(body)
                            continue
                        t, at = Texts(np.frombuffer(body, np.uint8), np.array([0, len(body)]), 0), np.arange(x["n"])
                        string = t.span_hash(t.prefix_hash(t.data), at, at + length).view(np.int64)
                        one = np.ones(len(at), np.int64)
                        out.append([string, string, row * one, x["start"] + at, one, 0 * one])
                        ids += [doc] * len(at)
                if not out:
                    continue
                gram, whole, row, start, n, ahead = (np.concatenate(c) for c in zip(*out))
                columns = [pa.array(gram), pa.array(whole), pa.array(ids, pa.int64()), pa.array(row), pa.array(start), pa.array(n), pa.array(ahead)]
                yield pa.RecordBatch.from_arrays(columns + ([] if apart else [pa.array(bodies, pa.binary())]), names + ([] if apart else ["body"]))

    text = keyed.select(F.col("_row").alias("row"), "text")
    joined = text.join(parts, "row").select("text", "doc_id", "row", "parts")
    return joined.mapInArrow(cut, FOUND + ("" if apart else ", body binary"))


def _variants(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(row, start, n): bytes of strings in `wanted` that another fragment with the same gram has earlier."""
    wanted = written(wanted.select("gram", "whole", "doc_id", "row", "start", "n", "ahead"))
    buckets = max(1, -(-wanted.count() // BUCKET))

    def resolve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["gram", "row", "start"]).reset_index(drop=True)  # a document that is there twice is one
        order = part.assign(_blank=part["doc_id"].isna()).sort_values(["_blank", "doc_id", "row", "start"]).index.to_numpy()
        rank = np.empty(len(part), np.int64)
        rank[order] = np.arange(len(part))
        row, at, count = repeats([bytes(b) for b in part["body"]], part["ahead"].to_numpy(), rank, length)
        return pd.DataFrame({"row": part["row"].to_numpy()[row], "start": part["start"].to_numpy()[row] + at, "n": count - 1 + length}).astype("int64")

    body = _read(keyed, wanted, length, False).withColumn("_bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)))
    return body.groupBy("_bucket").applyInPandas(resolve, "row long, start long, n long")


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of docs (doc_id, text).

    Removes each byte covered by a string of `length` bytes that also starts earlier: in a smaller doc_id, or
    earlier in the same document.  kept is the remaining bytes.

    Equal strings are brought together by their least gram: a text falls into fragments, runs of strings with the same one.
    Of equal fragments all but the first are repeats as a whole.  Different fragments that share a gram
    go to a bucket, whose suffixes are sorted by building the Burrows-Wheeler transform of the collection column by
    column, with the common prefixes of neighbours; those of `length` or more are repeats.  A gram with more than LARGE
    different fragments falls apart into its strings, which are told apart by their hashes alone.  Other columns are left out.

    Null text: no bytes.  Rows equal in doc_id and text are one document.  A null doc_id comes after all others.
    Documents with the same id and other texts are ordered by a hash.  No rows: no rows.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_row"))
    found = _occurrences(keyed, length)
    apart = written(_told_apart(found))
    gone = apart.where("gram is null").select("row", "start", "n")
    gone = gone.union(apart.where("gram is not null and place > 1").select("row", "start", (F.col("n") - 1 + length).alias("n")))
    several = apart.where("gram is not null and place = 1 and kin > 1")
    large = written(_told_apart(_read(keyed, several.where(F.col("kin") > LARGE), length, True)))
    gone = gone.union(large.where("place > 1").select("row", "start", F.lit(length).cast("long").alias("n")))
    gone = gone.union(_variants(keyed, several.where(F.col("kin") <= LARGE), length))
    spans = gone.groupBy(F.col("row").alias("_row")).agg(F.collect_set(F.struct("start", "n")).alias("_gone"))
    joined = keyed.join(spans, "_row", "left").select("doc_id", "text", F.col("_gone.start").alias("_start"), F.col("_gone.n").alias("_n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for text, starts, sizes in zip(*(c.to_pylist() for c in part.columns[1:])):
                    raw = (text or "").encode()
                    kept, at, removed, n_spans = [], 0, 0, 0
                    for a, n in sorted(zip(starts or (), sizes or ())):
                        if a > at or not n_spans:
                            kept.append(raw[at:a])
                            n_spans += 1
                            at = a
                        if a + n > at:
                            removed += a + n - at
                            at = a + n
                    kept.append(raw[at:])
                    rest = b"".join(kept)
                    rows.append((len(raw), removed, n_spans, hashlib.sha256(rest).hexdigest(), rest))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string()), pa.array(columns[4], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

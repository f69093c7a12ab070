"""Redaction by a table of secrets of any size.

A secret that is replaced inside a text has 16 bytes at least, so its first 16 bytes have a hash.  The hashes of all secrets set bits of one
filter of a fixed size; a text's places whose bit is set are joined with the secrets by hash, and what really stands there by its bytes.  Secrets go
through joins only: nothing that a task holds grows with their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import INSIDE, tag
from ..functions.text import EMAIL, JWT
from ..lineage import written

#: Bits of the filter (16 MB).
FILTER_BITS = 27
#: Strings that are tags themselves.
TAG = r"\{\{redacted:[^{}]+\}\}"

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each INSIDE bytes that stand together."""
    n = len(data) - INSIDE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.zeros(n + 8, np.uint64)
    for k in range(8):
        eight |= data[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    h = eight[:n] * _A + (eight[8:] ^ (eight[8:] >> np.uint64(29))) * _B
    h ^= h >> np.uint64(32)
    h *= _A
    return h ^ (h >> np.uint64(29))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [int(_hashes(np.frombuffer(v[:INSIDE], np.uint8))[0]) for v in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64), pa.int64())], ["value", "label", "h"])


def occurrences(texts: DataFrame, secrets: DataFrame) -> DataFrame:
    """(id, at, value, label) of every place of secrets (value, label) in texts (id, text); at is the byte where one begins, -1 if it is the whole text.

    Secrets of less than INSIDE bytes are found as the whole text only.  Places may overlap.  Values are different; of a value with several labels
    the smallest counts.
    """
    known = secrets.where("value is not null and value <> ''").groupBy(F.col("value").cast("binary").alias("value")).agg(F.min("label").alias("label"))
    long = written(known.where(F.octet_length("value") >= INSIDE).mapInArrow(_prefixes, "value binary, label string, h long"))
    bit = F.col("h").bitwiseAND((1 << FILTER_BITS) - 1) + 1  # bits are counted from 1
    maps = long.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    held = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in maps.toLocalIterator():  # at most 16 MB, however many secrets there are
        held[(r.k - 1) * 4096 : (r.k - 1) * 4096 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    spark = texts.sparkSession
    bits = spark.sparkContext.broadcast(held)
    most = long.agg(F.max(F.octet_length("value"))).first()[0] or 0

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("h", pa.int64()), ("part", pa.binary())])
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py().encode() if text.is_valid else b""
                h = _hashes(np.frombuffer(raw, np.uint8))
                low = h & np.uint64((1 << FILTER_BITS) - 1)
                at = np.flatnonzero(bits.value[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
                if len(at):
                    parts = [raw[k : k + most] for k in at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array(at), pa.array(h[at].view(np.int64)), pa.array(parts, pa.binary())], schema=schema)

    near = texts.select("id", "text").mapInArrow(places, "id long, at long, h long, part binary")
    # many secrets may begin alike: a place is joined with their lengths first, then with what it holds in each
    lengths = long.select("h", F.octet_length("value").alias("n")).distinct()
    here = near.join(lengths, "h").where(F.octet_length("part") >= F.col("n")).select("id", "at", F.substring("part", F.lit(1), F.col("n")).alias("value"))
    inside = here.join(long.select("value", "label"), "value").select("id", "at", "value", "label")
    whole = texts.select("id", F.col("text").cast("binary").alias("_t"), F.xxhash64("text").alias("_x")).where("_t is not null")
    whole = whole.select("id", "_x", F.octet_length("_t").alias("_n")).join(known.withColumns({"_x": F.xxhash64(F.col("value").cast("string")), "_n": F.octet_length("value")}), ["_x", "_n"])
    return inside.unionByName(whole.select("id", F.lit(-1).cast("long").alias("at"), "value", "label"))


_PATTERNS = (("jwt", re.compile(JWT)), ("email", re.compile(EMAIL)))


def _replaced(text: str, found: list[dict], key: str) -> str:
    """A text whose secrets are replaced from the left, the longest of those at one place, then tokens, then mail addresses."""
    if not text or re.fullmatch(TAG, text):
        return text
    raw = text.encode()
    out, at = [], 0
    for f in found:
        if f["at"] < 0 and raw == f["value"]:
            return tag(f["label"], text, key)
        if f["at"] >= at:
            out += [raw[at : f["at"]], tag(f["label"], f["value"].decode(), key).encode()]
            at = f["at"] + len(f["value"])
    text = b"".join([*out, raw[at:]]).decode()
    for label, pattern in _PATTERNS:
        text = pattern.sub(lambda m: tag(label, m[0], key), text)
    return text


def redacted(rows: DataFrame, column: str, secrets: DataFrame, key: str) -> DataFrame:
    """Rows whose text column has secrets (value, label), tokens and mail addresses replaced by tags that are equal for equal values.

    A text that is a secret becomes its tag.  Else secrets of INSIDE bytes and more are replaced from the left; of those that begin at one place the
    longest is.  Nulls stay, and so do tags.  Rows that are equal stay equal.
    """
    names = {c.lower() for c in rows.columns}
    fresh = lambda n: n if n not in names else fresh(n + "_")
    row, found = fresh("_row"), fresh("_found")
    fixed = written(rows.withColumn(row, F.monotonically_increasing_id()))
    at = occurrences(fixed.select(F.col(row).alias("id"), F.col(column).alias("text")), secrets)
    order = F.array_sort(F.collect_list(F.struct("at", (-F.octet_length("value")).alias("_n"), "value", "label")))
    listed = at.groupBy(F.col("id").alias(row)).agg(order.alias(found))
    kept = [c for c in rows.columns]
    both = fixed.join(listed, row, "left").select(*kept, found)
    place = kept.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else _replaced(t, f or [], key) for t, f in zip(batch.column(place).to_pylist(), batch.column(len(kept)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == place else batch.column(k) for k in range(len(kept))], kept)

    return both.mapInArrow(run, rows.schema)

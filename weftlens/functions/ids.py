"""Identifiers derived from content."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMESPACE = "weftlens/v1"


def hash_id(kind: str, canonical: Column, namespace: str = NAMESPACE) -> Column:
    """12 hex digits that depend on the kind and the canonical text alone."""
    return F.substring(F.sha2(F.concat(F.lit(f"{namespace}/{kind}|"), canonical), 256), 1, 12)


def hash_order(value: Column) -> Column:
    """A fixed pseudo-random order of values, for samples that don't depend on input order."""
    return F.sha2(value, 256)


def hash_samples(values: DataFrame, key: list[str], value: str, most: int) -> DataFrame:
    """(key, examples): up to `most` distinct values of each key, the first in hash order.

    Ranks are cut in each task before they are shuffled, so a key's values are never gathered.
    """
    best = Window.partitionBy(*key).orderBy(hash_order(F.col(value)), value)
    top = values.select(*key, value).distinct().withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most)
    listed = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_r", value))).alias("_l"))
    return listed.select(*key, F.transform("_l", lambda x: x[value]).alias("examples"))


def result_id(recordings: DataFrame, hosts: list[str] | None = None) -> str:
    """The id of a result over recordings (session, exchanges) and a filter of hosts: the same inputs, in any order, give the same.

    Recordings are digested by sums of hashes, not gathered.
    """
    parts = recordings.agg(F.count("*"), F.sum(F.xxhash64("session", "exchanges").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("exchanges", "session"))).first()
    kept = ",".join(sorted({h.strip().lower().strip(".") for h in hosts or []} - {""}))
    return "cl_" + hashlib.sha256(f"{NAMESPACE}/input|{':'.join(map(str, parts))}|{kept}".encode()).hexdigest()[:12]

"""Secrets replaced by tags that stay equal for equal values."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .rewrite import rewritten
from .text import EMAIL, JWT, secret_location

#: Shorter secrets are replaced only where they are the whole string.
INSIDE = 16


def tag(label: str, value: str, key: str) -> str:
    return "{{redacted:" + label + ":" + hmac.new(key.encode(), value.encode(), hashlib.sha256).hexdigest()[:12] + "}}"


def secrets(values: DataFrame) -> DataFrame:
    """(value, label) of values (value, part, name) at places that carry credentials; the smallest label of each."""
    found = values.where(secret_location(F.col("part"), F.col("name")) & (F.col("value") != ""))
    label = F.when(F.col("name") == "", F.col("part")).otherwise(F.concat_ws(".", "part", "name"))
    return found.groupBy("value").agg(F.min(label).alias("label"))


def secret_counts(values: DataFrame) -> DataFrame:
    """(part, secrets): how many different secrets are first named at each kind of place."""
    return secrets(values).groupBy(F.substring_index("label", ".", 1).alias("part")).agg(F.count("*").alias("secrets"))


def _swap(known: dict[str, str], key: str) -> Callable[[str], str]:
    inside = sorted((v for v in known if len(v.encode()) >= INSIDE), key=lambda v: (-len(v), v))
    one = re.compile("|".join([*(re.escape(v) for v in inside), f"(?P<jwt>{JWT})", f"(?P<email>{EMAIL})"]))
    found = lambda m: tag(known.get(m[0]) or ("jwt" if m["jwt"] else "email"), m[0], key)
    return lambda t: tag(known[t], t, key) if t in known else one.sub(found, t)


def redacted(text: Column, known: dict[str, str], key: str) -> Column:
    """Text with known secrets (value: label), tokens and mail addresses replaced by tags.

    `known` goes to every task: it is for the secrets of one session, not of a corpus.
    """
    swap = _swap(known, key)
    return F.udf(lambda t: None if t is None else swap(t), StringType(), useArrow=True)(text)


def redacted_json(text: Column, known: dict[str, str], key: str) -> Column:
    """As redacted, for every string of a JSON document by itself, keys too; what isn't JSON is redacted as text."""
    swap = _swap(known, key)

    def run(document: str | None) -> str | None:
        if document is None:
            return None
        try:
            return json.dumps(rewritten(json.loads(document), swap), ensure_ascii=False)
        except ValueError:
            return swap(document)

    return F.udf(run, StringType(), useArrow=True)(text)


def redacted_table(rows: DataFrame, known: dict[str, str], key: str) -> DataFrame:
    """Every text column of rows redacted, also in arrays of texts."""
    swap = _swap(known, key)
    one = F.udf(lambda t: None if t is None else swap(t), StringType(), useArrow=True)
    many = F.udf(lambda ts: None if ts is None else [None if t is None else swap(t) for t in ts], ArrayType(StringType()), useArrow=True)
    kinds = {f.name: f.dataType for f in rows.schema}
    changed = {n: one(F.col(n)) for n, t in kinds.items() if t == StringType()} | {n: many(F.col(n)) for n, t in kinds.items() if t == ArrayType(StringType())}
    return rows.withColumns(changed) if changed else rows

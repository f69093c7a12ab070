"""JSON documents compared, rewritten and rendered, as text in and text out."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text, parse_int=float), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return None


def canonical_json(text: Column) -> Column:
    """A document in one form: keys sorted, no spaces, numbers by value (1, 1.0 and 1e0 are alike); null if it isn't JSON."""
    return F.udf(_canonical, StringType(), useArrow=True)(text)


def same_json(a: Column, b: Column) -> Column:
    """Whether two documents are the same whatever their layout, the order of keys and the form of numbers; null if either isn't JSON."""
    return canonical_json(a) == canonical_json(b)


def same_items(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same items as often, in any order."""
    return F.array_sort(a) == F.array_sort(b)


def rewritten(value: Any, swap: Callable[[str], str]) -> Any:
    """A parsed document with every string, keys too, put through swap."""
    if isinstance(value, str):
        return swap(value)
    if isinstance(value, list):
        return [rewritten(x, swap) for x in value]
    if isinstance(value, dict):
        return {swap(k): rewritten(x, swap) for k, x in value.items()}
    return value


def rendered(value: Any) -> str:
    """A document as files hold it: two spaces a level, keys as they come, every character as itself, a line end."""
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"

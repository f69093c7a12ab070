"""Structure of JSON and form bodies: scalars with their places, and shapes that merge.

A JSON literal is kept as it is written, which Spark's own readers don't do; so this is Python inside Arrow batches.
"""

from __future__ import annotations

import json
import json.scanner
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched
from typing import Any
from urllib.parse import unquote_plus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How much of a recorded body is read (fixed values); containers reads bodies whole.
MOST_NODES, MOST_DEPTH, MOST_ELEMENTS = 20_000, 24, 200

SCALARS = "array<struct<path:string,pattern:string,type:string,value:string>>"
PARSED = f"shape string, truncated boolean, error string, scalars {SCALARS}"


class Literal(str):
    """A number as written."""


def _numbers(text: str) -> Literal:
    return Literal(text)


def _refuse(text: str) -> None:
    raise ValueError(text)


def type_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, Literal):
        return "integer" if re.fullmatch(r"-?\d+", value) and -(2**63) <= int(value) < 2**63 else "number"
    return {dict: "object", list: "array"}.get(type(value), "string")


def merge(a: Any, b: Any) -> Any:
    """Shape of values that have either shape: a type name, {"field": shape}, or [shape] ([None]: no element seen)."""
    if a == b or b is None:
        return a
    if a is None:
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a.get(k), b.get(k)) for k in sorted({*a, *b})}
    if isinstance(a, list) and isinstance(b, list):
        return [merge(a[0], b[0])]
    if {*map(str, (a, b))} == {"integer", "number"}:
        return "number"
    return "any"


def canonical(shape: Any) -> str:
    if isinstance(shape, dict):
        return "{" + ",".join(f"{k}:{canonical(v)}" for k, v in sorted(shape.items())) + "}"
    return f"[{canonical(shape[0])}]" if isinstance(shape, list) else shape or ""


def walk(value: Any) -> tuple[Any, list[tuple[str, str, str, str]], bool]:
    """Shape of a parsed body, its scalars (nulls have none), and whether a budget cut it short."""
    scalars: list[tuple[str, str, str, str]] = []
    state = {"nodes": 0, "cut": False}

    def step(v: Any, path: str, pattern: str, depth: int) -> Any:
        state["nodes"] += 1
        if state["nodes"] > MOST_NODES or depth > MOST_DEPTH:
            state["cut"] = True
            return None
        if isinstance(v, dict):
            dot = "." if path else ""
            return {k: step(x, f"{path}{dot}{k}", f"{pattern}{dot}{k}", depth + 1) for k, x in v.items()}
        if isinstance(v, list):
            state["cut"] |= len(v) > MOST_ELEMENTS
            inner = None
            for k, x in enumerate(v[:MOST_ELEMENTS]):
                inner = merge(inner, step(x, f"{path}[{k}]", f"{pattern}[]", depth + 1))
            return [inner]
        kind = type_of(v)
        if kind != "null":
            scalars.append((path, pattern, kind, {True: "true", False: "false"}[v] if kind == "bool" else str(v)))
        return kind

    shape = step(value, "", "", 0)
    return shape, scalars, state["cut"]


def parse_json(text: str) -> Any:
    return json.loads(text, parse_int=_numbers, parse_float=_numbers, parse_constant=_refuse)


#: A number of either type, where only its type is wanted.
INTEGER, NUMBER = Literal("integer"), Literal("number")


def _integer(text: str) -> Literal:
    return INTEGER if len(text) < 19 or len(text) < 21 and -(2**63) <= int(text) < 2**63 else NUMBER


TYPED = {"parse_int": _integer, "parse_float": lambda _: NUMBER, "parse_constant": _refuse}


def shape_of(text: str) -> Any:
    """The shape that walk(parse_json(text)) gives, within the same budget, without scalars and their places."""
    nodes = 0

    def step(v: Any, depth: int) -> Any:
        nonlocal nodes
        nodes += 1
        if nodes > MOST_NODES or depth > MOST_DEPTH:
            return None
        kind = type(v)
        if kind is str:
            return "string"
        if kind is Literal:
            return str(v)
        if kind is dict:
            return {k: step(x, depth + 1) for k, x in v.items()}
        if kind is list:
            inner = None
            for x in v[:MOST_ELEMENTS]:
                inner = merge(inner, step(x, depth + 1))
            return [inner]
        return "null" if v is None else "bool"

    return step(json.loads(text, **TYPED), 0)


def _nested(text: str) -> Any:
    """json.loads of a text that nests deeper than C recurses: the library's own reader in Python, whose calls lie on the heap."""
    decoder, before = json.JSONDecoder(**TYPED), sys.getrecursionlimit()
    decoder.scan_once = json.scanner.py_make_scanner(decoder)
    sys.setrecursionlimit(before + 3 * (text.count("[") + text.count("{")))
    try:
        return decoder.decode(text)
    finally:
        sys.setrecursionlimit(before)


def whole_shape(text: str) -> Any:
    """The shape of a JSON text with all elements of its arrays, at any size and depth: values that stand at one place are looked at together, so the walk neither merges nor recurses."""
    try:
        value = json.loads(text, **TYPED)
    except RecursionError:
        value = _nested(text)
    out: list[Any] = [None]
    places: list[tuple[list[Any], Any, Any]] = [([value], out, 0)]
    while places:
        values, holder, key = places.pop()
        kinds = {*map(type, values)}
        kind = kinds.pop() if len(kinds) == 1 else None
        if kind is dict:
            fields = defaultdict(list)
            for v in values:
                for name, x in v.items():
                    fields[name].append(x)
            holder[key] = dict.fromkeys(fields)
            places += [(held, holder[key], name) for name, held in fields.items()]
        elif kind is list:
            holder[key] = [None]
            if inner := [x for v in values for x in v]:
                places.append((inner, holder[key], 0))
        elif kind is Literal:
            holder[key] = "number" if NUMBER in values else "integer"
        else:
            holder[key] = {str: "string", bool: "bool", type(None): "null"}.get(kind, "any")
    return out[0]


def parse_form(text: str) -> dict[str, Any]:
    out: dict[str, list[str]] = {}
    for part in text.split("&"):
        if part:
            if re.search(r"%(?![0-9A-Fa-f]{2})", part):
                raise ValueError(part)
            name, _, value = part.partition("=")
            out.setdefault(unquote_plus(name), []).append(unquote_plus(value))
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def parsed_body(text: str | None, kind: str | None) -> dict[str, Any]:
    """A row of PARSED: an opaque or unreadable body has no shape, and says why."""
    if not text or kind not in ("json", "form"):
        return {"shape": "", "truncated": False, "error": None, "scalars": [], "tree": None}
    try:
        shape, scalars, cut = walk(parse_json(text) if kind == "json" else parse_form(text))
    except (ValueError, RecursionError) as e:
        return {"shape": "", "truncated": False, "error": type(e).__name__, "scalars": [], "tree": None}
    return {"shape": canonical(shape), "truncated": cut, "error": None, "scalars": [dict(zip(("path", "pattern", "type", "value"), s)) for s in scalars], "tree": json.dumps(shape)}


def body_structures(bodies: DataFrame) -> DataFrame:
    """(ref, shape, truncated, error, scalars) of bodies (ref, text, kind); kinds other than json and form are opaque."""
    scalar = pa.struct([(name, pa.string()) for name in ("path", "pattern", "type", "value")])
    types = {"shape": pa.string(), "truncated": pa.bool_(), "error": pa.string(), "scalars": pa.list_(scalar)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parsed_body(t, k) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([r[name] for r in rows], kind) for name, kind in types.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["ref", *types])

    return bodies.select(F.col("ref").cast("string"), "text", "kind").mapInArrow(run, "ref string, " + PARSED)


def merged_shapes(bodies: DataFrame, key: str) -> DataFrame:
    """(key, shape): what all JSON bodies (key, text) of a key have in common; merges in each batch first, then by key."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found: dict[str, Any] = {}
            for k, t in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                try:
                    found[k] = merge(found.get(k), shape_of(t))
                except (ValueError, TypeError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(v) for v in found.values()], pa.string())], [key, "tree"])

    def whole(rows: pa.Table) -> pa.Table:
        out = None
        for tree in rows.column("tree").to_pylist():
            out = merge(out, json.loads(tree))
        return pa.table({key: pa.array([rows.column(key)[0].as_py()], pa.string()), "shape": pa.array([canonical(out)], pa.string())})

    return bodies.select(F.col(key).cast("string"), "text").mapInArrow(part, f"{key} string, tree string").groupBy(key).applyInArrow(whole, f"{key} string, shape string")


#: Types of fields that hold one value (fixed values).
SCALAR_TYPES = ("string", "integer", "number", "bool", "null")


def _kind(shape: Any) -> str:
    """A field's type as rows have it: a scalar type, any, object, array, or items for an array of objects."""
    if isinstance(shape, dict):
        return "object"
    if isinstance(shape, list):
        return "items" if isinstance(shape[0], dict) else "array"
    return shape or "any"


def _containers(shape: Any) -> Iterator[tuple[str, bool, int | None, dict[str, Any]]]:
    places: list[tuple[Any, str, bool, int | None]] = [(shape, "body", False, 0)]
    while places:
        shape, path, item, level = places.pop()
        if isinstance(shape, dict):
            yield path, item, level, shape
            places += [(inner, f"{path}.{name}", False, None if level is None else level + 1) for name, inner in shape.items() if isinstance(inner, (dict, list))]
        elif isinstance(shape, list):
            places.append((shape[0], f"{path}[]", isinstance(shape[0], dict), None))


#: Rows of an Arrow batch of containers.
ROWS_A_BATCH = 10_000

FIELDS = "ref string, root string, container string, item boolean, level int, field string, type string"


def containers(bodies: DataFrame, column: str = "text", beside: str = "") -> DataFrame:
    """One row for each field of each object in the shape of whole JSON bodies (ref, text), or of their shapes (ref, tree) as body records have them; one walk finds all.

    root (array, object, or the body's scalar type), container (as body.a.b[].c), item (whether it is the elements of an array), level (objects
    above it, null below an array), field and type (a scalar type, any, object, array, items for an array of objects).  An object without
    fields, and a body without objects, give one row with no field.  Bodies that aren't JSON give none.  `beside`: a column of texts that goes along with a body.
    """
    kinds = [("ref", pa.string()), ("root", pa.string()), ("container", pa.string()), ("item", pa.bool_()), ("level", pa.int32()), ("field", pa.string()), ("type", pa.string())]
    also = [beside] if beside else []
    schema = pa.schema([*kinds, *((name, pa.string()) for name in also)])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[Any, ...]]:
        for ref, text, *own in zip(*(c.to_pylist() for c in batch.columns)):
            try:
                shape = json.loads(text) if column == "tree" else whole_shape(text)
            except (ValueError, TypeError, RecursionError):
                continue
            root, held = "array" if isinstance(shape, list) else _kind(shape), False
            for path, item, level, fields in _containers(shape):
                held = True
                for name, inner in fields.items() or [(None, None)]:
                    yield ref, root, path, item, level, name, None if name is None else _kind(inner), *own
            if not held:
                yield ref, root, None, None, None, None, None, *own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batched(rows(batch), ROWS_A_BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), schema.types)], schema=schema)

    return bodies.select(F.col("ref").cast("string"), column, *also).mapInArrow(run, FIELDS + "".join(f", `{name}` string" for name in also))


def arrays_of_objects(bodies: DataFrame) -> DataFrame:
    """(ref, path, scalars) of every array of objects in JSON bodies (ref, text): its place, as .a.b[], and how many fields of its objects are scalars."""
    items = containers(bodies).where("item")
    return items.groupBy("ref", F.substring("container", 5, (1 << 31) - 1).alias("path")).agg(F.count_if(F.col("type").isin(*SCALAR_TYPES)).cast("int").alias("scalars"))

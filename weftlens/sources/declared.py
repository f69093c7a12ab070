"""Documents read strictly by a declaration: one walk gives every issue with its place, fills in defaults, and says what names a document defines and refers to.

Documents are JSON, or YAML where a reader for it is installed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import spread

Rule = Callable[[dict[str, Any]], list[tuple[str, str]]]


@dataclass(frozen=True, kw_only=True)
class Node:
    """What all declarations have: whether a value must be there, what stands for one that isn't, and in which space of names it defines or refers to one."""

    required: bool = False
    default: Any = None
    defines: str = ""
    refers: str = ""


@dataclass(frozen=True)
class Text(Node):
    pattern: str = ""
    one_of: tuple[str, ...] = ()
    blank: bool = True


@dataclass(frozen=True)
class Number(Node):
    whole: bool = False
    least: float | None = None
    most: float | None = None


@dataclass(frozen=True)
class Flag(Node):
    pass


@dataclass(frozen=True)
class Anything(Node):
    pass


@dataclass(frozen=True)
class Items(Node):
    of: Node = field(default_factory=Text)
    least: int = 0
    unique: bool = False


@dataclass(frozen=True)
class Names(Node):
    """An object whose keys are names, each with a value of one kind; with keys, they are names of that space."""

    of: Node = field(default_factory=Anything)
    keys: Node = field(default_factory=Node)


@dataclass(frozen=True)
class Table(Node):
    """An object of known keys; rules look at it as a whole, and give (key, issue)."""

    fields: dict[str, Node] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()


Found = tuple[str, str, str]
#: Kinds of rows that a walk gives.
ISSUE, DEFINES, REFERS = "issue", "defines", "refers"


def walk(node: Node, value: Any, path: str = "") -> tuple[Any, list[Found]]:
    """The value with defaults, and rows (kind, path, text): issues, and space:name of the names that are defined or referred to."""
    out: list[Found] = []
    say = lambda text, at=path: out.append((ISSUE, at, text))
    if value is None:
        if node.required:
            say("is required")
        if node.default is None and not isinstance(node, Table):
            return None, out
        if node.default is not None:
            return node.default, out
        value = {}
    kind_of = {Text: "text", Number: "a number", Flag: "true or false", Items: "a list", Names: "an object", Table: "an object"}
    fits = {
        Text: isinstance(value, str), Number: isinstance(value, (int, float)) and not isinstance(value, bool) and (not getattr(node, "whole", False) or value == int(value)), Flag: isinstance(value, bool),
        Items: isinstance(value, list), Names: isinstance(value, dict), Table: isinstance(value, dict),
    }
    if not fits.get(type(node), True):
        say(f"must be {'a whole number' if isinstance(node, Number) and node.whole else kind_of[type(node)]}")
        return value, out
    below = lambda key: f"{path}.{key}" if path else str(key)
    if isinstance(node, Text):
        if not value.strip() and (node.required or not node.blank):
            say("is empty")
        elif node.pattern and not re.fullmatch(node.pattern, value):
            say(f"{value!r} doesn't match {node.pattern}")
        elif node.one_of and value not in node.one_of:
            say(f"{value!r} is not one of {', '.join(node.one_of)}")
    elif isinstance(node, Number):
        if node.least is not None and value < node.least:
            say(f"is less than {node.least:g}")
        if node.most is not None and value > node.most:
            say(f"is more than {node.most:g}")
    elif isinstance(node, Items):
        if len(value) < node.least:
            say(f"needs at least {node.least}")
        kept, seen = [], set()
        for k, x in enumerate(value):
            clean, more = walk(node.of, x, f"{path}[{k}]")
            out += more
            key = json.dumps(x, sort_keys=True, default=str)
            if node.unique and key in seen:
                say(f"{x!r} is listed twice", f"{path}[{k}]")
            seen.add(key)
            kept.append(clean)
        value = kept
    elif isinstance(node, Names):
        kept = {}
        for key in sorted(value):
            if node.keys.defines or node.keys.refers:
                out.append((DEFINES, below(key), f"{node.keys.defines}:{key}") if node.keys.defines else (REFERS, below(key), f"{node.keys.refers}:{key}"))
            kept[key], more = walk(node.of, value[key], below(key))
            out += more
        value = kept
    elif isinstance(node, Table):
        for key in sorted(set(value) - set(node.fields)):
            say("is not known", below(key))
        kept = {}
        for key, inner in node.fields.items():
            kept[key], more = walk(inner, value.get(key), below(key))
            out += more
        for rule in node.rules:
            out += [(ISSUE, below(key) if key else path, text) for key, text in rule(kept)]
        value = kept
    if isinstance(value, str) and value.strip():
        if node.defines:
            out.append((DEFINES, path, f"{node.defines}:{value}"))
        if node.refers:
            out.append((REFERS, path, f"{node.refers}:{value}"))
    return value, out


def _parsed(text: str | None) -> Any:
    if text is None or not text.strip():
        raise ValueError("an empty document")
    try:
        return json.loads(text)
    except ValueError:
        if text.lstrip()[:1] in "{[":
            raise
    try:
        import yaml
    except ImportError as e:
        raise ValueError("not JSON, and no reader for YAML is installed") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"not YAML: {e}") from e


READ = "name string, value string, kind string, path string, text string"


def read(documents: DataFrame, declaration: Node) -> DataFrame:
    """(name, value, kind, path, text) of documents (name, text): a row of kind `value` with the document as JSON, defaults filled in, and a row for each issue and name that the walk finds.

    A document that can't be read has one issue, and no value.  Documents are dealt over all tasks first: a small file of them takes long to walk.
    """
    schema = pa.schema([(n.split()[0], pa.string()) for n in READ.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    value, found = walk(declaration, _parsed(text))
                except (ValueError, RecursionError) as e:
                    rows.append((name, None, ISSUE, "", f"can't be read: {str(e)[:200]}"))
                    continue
                rows.append((name, json.dumps(value, sort_keys=True, default=str), "value", None, None))
                rows += [(name, None, *f) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 5, schema=schema)

    return spread(documents.select(F.col("name").cast("string"), "text")).mapInArrow(run, READ)


def issues(found: DataFrame, known: DataFrame | None = None, across: tuple[str, ...] = ()) -> DataFrame:
    """(name, path, issue) of what read() found: issues of the walk, names that are referred to but not defined, and names that more than one document defines.

    A name must be defined in its own document, or be in known (space, ref).  across: spaces whose names must differ between documents.
    """
    own = found.where(F.col("kind") == ISSUE).select("name", "path", F.col("text").alias("issue"))
    defined = found.where(F.col("kind") == DEFINES).select("name", "text").distinct()
    open_ = found.where(F.col("kind") == REFERS).select("name", "path", "text").join(defined, ["name", "text"], "left_anti")
    if known is not None:
        open_ = open_.join(known.select(F.concat_ws(":", "space", "ref").alias("text")).distinct(), "text", "left_anti")
    missing = open_.select("name", "path", F.concat(F.lit("unknown "), F.regexp_replace("text", ":", " ")).alias("issue"))
    shared = found.where((F.col("kind") == DEFINES) & F.substring_index("text", ":", 1).isin(*across)).select("name", "path", "text")
    first = shared.groupBy("text").agg(F.min("name").alias("_first"), F.count_distinct("name").alias("_n")).where("_n > 1")
    twice = shared.join(first, "text").where(F.col("name") != F.col("_first"))
    return own.union(missing).union(twice.select("name", "path", F.concat(F.regexp_replace("text", ":", " "), F.lit(" is also in "), F.col("_first"))))


# ---------------------------------------------------------------- the declarations (names, limits and patterns are fixed values)

ID = r"[a-z0-9][a-z0-9._-]*"
#: Ways in which answers can be scored.
SCORERS = ("fields",)
ADAPTERS = ("fake", "llama")


def _inside(value: dict[str, Any]) -> list[tuple[str, str]]:
    """Files of a scenario lie in its own folder."""
    out = []
    for key in ("har", "goal", "expected"):
        depth, name = 0, value.get(key) or ""
        for part in name.split("/"):
            depth += {"": 0, ".": 0, "..": -1}.get(part, 1)
            if depth < 0 or name.startswith("/"):
                out.append((key, f"{name!r} lies outside the folder"))
                break
    return out


def _normalized(value: dict[str, Any]) -> list[tuple[str, str]]:
    """Only fields that are asked for are normalised."""
    asked = value.get("required_fields") or []
    return [(f"normalizers.{n}", "is not a required field") for n in sorted(value.get("normalizers") or {}) if n not in asked]


def _asks(value: dict[str, Any]) -> list[tuple[str, str]]:
    return [] if value.get("required_fields") else [("required_fields", "needs at least 1")]


def _stage(steps: int, seconds: int) -> Table:
    return Table(fields={"max_steps": Number(whole=True, least=1, default=steps), "timeout_seconds": Number(whole=True, least=1, default=seconds), "max_tokens": Number(whole=True, least=0, default=0)})


NORMALIZER = Table(fields={
    "case": Text(one_of=("lower", "upper")), "whitespace": Text(one_of=("trim", "collapse")), "numeric_tolerance": Number(least=0), "date": Text(), "url": Flag(default=False),
    "currency": Flag(default=False), "unordered": Flag(default=False),
})
SCENARIO = Table(
    fields={
        "id": Text(required=True, pattern=ID, defines="id"), "name": Text(required=True), "version": Number(required=True, whole=True, least=1), "tags": Items(), "har": Text(default="session.har"),
        "goal": Text(default="goal.md"), "expected": Text(default="expected.json"),
        "evaluation": Table(
            fields={"type": Text(required=True, one_of=SCORERS), "required_fields": Items(Text(blank=False), unique=True, default=[]), "allow_extra_fields": Flag(default=True), "normalizers": Names(NORMALIZER)},
            rules=(_normalized, _asks),
        ),
        "limits": Table(fields={"generate": _stage(200, 600), "answer": _stage(20, 90)}),
    },
    rules=(_inside,),
)


def _adapter(value: dict[str, Any]) -> list[tuple[str, str]]:
    """What each adapter needs, and what belongs to the other one."""
    kind, local = value.get("adapter"), ("model_path", "context_size", "gpu_layers", "threads", "seed")
    out = []
    if kind == "fake" and not value.get("replies"):
        out.append(("replies", "needs at least 1"))
    if kind == "llama" and not value.get("model_path"):
        out.append(("model_path", "is required"))
    if kind != "fake" and value.get("replies"):
        out.append(("replies", "is for the fake adapter only"))
    return out + [(k, "is for the llama adapter only") for k in local if kind != "llama" and value.get(k)]


def _different(value: dict[str, Any]) -> list[tuple[str, str]]:
    ids = [m.get("id") for m in value.get("models") or [] if isinstance(m, dict)]
    return [(f"models[{k}].id", f"{x!r} is used twice") for k, x in enumerate(ids) if x and x in ids[:k]]


REGISTRY = Table(
    fields={"models": Items(Table(
        fields={
            "id": Text(required=True, pattern=ID), "adapter": Text(required=True, one_of=ADAPTERS), "max_tokens": Number(whole=True, least=0, default=0), "temperature": Number(least=0, most=2), "replies": Items(),
            "model_path": Text(), "context_size": Number(whole=True, least=0, default=0), "gpu_layers": Number(whole=True), "threads": Number(whole=True, least=0, default=0), "seed": Number(whole=True, least=0, default=0),
        }, rules=(_adapter,)), least=1, required=True)},
    rules=(_different,),
)

_family, _slot, _entity = Text(refers="family"), Text(refers="slot"), Text(refers="entity")


def _one_role(value: dict[str, Any]) -> list[tuple[str, str]]:
    """A family has one role."""
    seen: dict[str, str] = {}
    out = []
    for role, ids in sorted((value.get("roles") or {}).items()):
        for x in ids or []:
            if x in seen:
                out.append((f"roles.{role}", f"family {x} is labelled {seen[x]} too"))
            seen.setdefault(x, role)
    return out


DESCRIPTION = Table(
    fields={
        "case": Text(required=True), "evidence": Text(required=True, refers="run"), "review": Text(), "notes": Items(), "roles": Names(Items(_family)),
        "entities": Items(Table(fields={"name": Text(required=True, defines="entity"), "names": Items(), "identity": Items(_slot), "fields": Items(), "relations": Items(Table(fields={"kind": Text(required=True), "target": _entity}))})),
        "not_identity": Items(_slot),
        "operations": Items(Table(fields={
            "name": Text(required=True), "role": Text(required=True), "families": Items(_family), "required": Items(Table(fields={"name": Text(required=True), "slots": Items(_slot)})),
            "outputs": Items(Table(fields={"entity": _entity, "many": Flag(default=False)}))})),
        "prerequisites": Table(fields={"consumers": Items(_family), "accept": Items(Table(fields={"carrier": Text(required=True), "producers": Items(_family), "kinds": Items(least=1), "why": Text()}))}),
    },
    rules=(_one_role,),
)

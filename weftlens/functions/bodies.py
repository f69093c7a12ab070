"""Stored bodies: content codings undone, and JSON, form and multipart bodies read into shapes and scalars."""

from __future__ import annotations

import email
import email.policy
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text
from .shape import PARSED, parsed_body

#: Bodies of more bytes are not read, and of a part of a multipart body no more than this (fixed values).
MOST_BYTES, MOST_PART = 8 << 20, 1 << 20
RECORD = f"ref string, side string, kind string, media string, size long, size_class string, text string, {PARSED}, tree string"


#: What a body may take once its coding is undone.
MOST_DECODED = 4 * MOST_BYTES


def _inflated(content: bytes, wbits: int) -> bytes:
    """Inflated content of one or more members, in steps, so that a small body can't fill the memory of a task."""
    out = bytearray()
    while content:
        one = zlib.decompressobj(wbits)
        out += one.decompress(content, MOST_DECODED + 1 - len(out))
        if len(out) > MOST_DECODED:
            raise ValueError(f"body over {MOST_DECODED} bytes when decoded")
        if not one.eof:
            raise EOFError("ends before its end")
        content = one.unused_data.lstrip(b"\0") if wbits > 0 else b""
    return bytes(out)


def decoded(content: bytes, coding: str | None) -> bytes:
    """The content without its codings, undone in the reverse order of the header; ValueError for one that can't be, or is too large."""
    for name in reversed([c.strip().lower() for c in (coding or "").split(",") if c.strip()]):
        if name in ("gzip", "x-gzip", "deflate"):
            try:
                content = _inflated(content, -zlib.MAX_WBITS if name == "deflate" else zlib.MAX_WBITS | 16)
            except (EOFError, zlib.error) as e:
                raise ValueError(f"{name.removeprefix('x-')}: {e}") from e
        elif name != "identity":
            raise ValueError(f"unsupported content coding {name!r}")
    return content


def multipart(content: bytes, boundary: str) -> dict[str, Any]:
    """A row like PARSED: fields are strings, files opaque by media type; of a name only the first part counts."""
    if not boundary:
        raise ValueError("multipart body without a boundary")
    head = f'Content-Type: multipart/form-data; boundary="{boundary}"\r\n\r\n'.encode()
    fields: dict[str, str] = {}
    scalars = []
    for part in email.message_from_bytes(head + content, policy=email.policy.HTTP).iter_parts():
        file = part.get_filename()
        name = part.get_param("name", header="content-disposition") or file or ""
        if name in fields:
            continue
        body = (part.get_payload(decode=True) or b"")[:MOST_PART]
        if file:
            fields[name] = f"opaque({part.get_content_type() if part['content-type'] else ''})"
            continue
        fields[name] = "string"
        scalars.append({"path": name, "pattern": name, "type": "string", "value": body.decode("utf-8", "replace")})
    shape = "multipart{" + ",".join(f"{k}:{v}" for k, v in sorted(fields.items())) + "}"
    return {"shape": shape, "truncated": False, "error": None, "scalars": sorted(scalars, key=lambda s: (s["path"], s["value"]))}


def record(content: bytes | None, size: int | None, media: str, kind: str, boundary: str, coding: str | None) -> dict[str, Any]:
    """Kind, text and parsed structure of one body; what can't be read is opaque and says why."""
    empty = {"kind": "none", "text": None, "shape": "", "truncated": False, "error": None, "scalars": [], "tree": None}
    if not size:
        return empty
    opaque = empty | {"kind": "opaque", "shape": f"opaque({media})"}
    if kind != "opaque" and size > MOST_BYTES:
        return opaque | {"error": f"body of {size} bytes over the {MOST_BYTES}-byte parse limit"}
    if content is None:
        return opaque | ({} if kind == "opaque" else {"error": "body not stored"})
    try:
        plain = decoded(content, coding)
        if kind == "multipart":
            return empty | multipart(plain, boundary) | {"kind": kind}
        if kind == "opaque":
            return opaque | {"text": plain.decode("utf-8", "replace")}
        found = parsed_body(plain.decode("utf-8", "replace"), kind)
    except ValueError as e:
        return opaque | ({} if kind == "opaque" else {"error": str(e)})
    return opaque | {"error": found["error"]} if found["error"] else empty | found | {"kind": kind}


def body_records(bodies: DataFrame) -> DataFrame:
    """RECORD rows of bodies (ref, side, content, size, content_type, content_encoding), content as it crossed the wire or null.

    Opaque bodies keep their text only where they may be searched for values.  A size of null or 0 is no body.
    """
    media = text.media_type(F.col("content_type"))
    boundary = F.regexp_extract("content_type", r'(?i)boundary="?([^";]+)', 1)
    rows = bodies.select(
        "ref", "side", "content", F.col("size").cast("long").alias("size"), media.alias("media"), text.body_kind(media).alias("_kind"), F.coalesce(boundary, F.lit("")).alias("_boundary"),
        "content_encoding", text.size_class(F.col("size")).alias("size_class"),
    )
    scalar = pa.struct([(name, pa.string()) for name in ("path", "pattern", "type", "value")])
    types = {"kind": pa.string(), "text": pa.string(), "shape": pa.string(), "truncated": pa.bool_(), "error": pa.string(), "scalars": pa.list_(scalar), "tree": pa.string()}
    names = ["ref", "side", "kind", "media", "size", "size_class", "text", "shape", "truncated", "error", "scalars", "tree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 64):  # a few bodies at a time: they may be large
                batch = whole.slice(k, 64)
                given = zip(*(batch.column(n).to_pylist() for n in ("content", "size", "media", "_kind", "_boundary", "content_encoding")))
                found = [record(*row) for row in given]
                columns = {n: pa.array([r[n] for r in found], kind) for n, kind in types.items()}
                columns |= {n: batch.column(n) for n in ("ref", "side", "media", "size", "size_class")}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return rows.mapInArrow(run, RECORD)

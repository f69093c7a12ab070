"""Results and revisions as tables, with a marker that says that they are whole."""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.privacy import redacted_table

VERSION = 1


MANIFEST = "number int, run string, output string, rows long, digest string, version int"


def table_digest(rows: DataFrame) -> str:
    """A SHA-256 of a table, whatever the order of its rows and columns; names, nulls and repeats count.

    Each row is hashed as JSON with its nulls.  The hashes are added up in eight parts, which combine before they are shuffled, and the sums are hashed.
    """
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    hashed = rows.select(F.sha2(line, 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    sums = hashed.agg(F.count("*"), *parts).first()
    return hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()


def _manifests(spark: SparkSession, folder: str) -> list:
    try:
        rows = spark.read.schema(MANIFEST).json(f"{folder}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    last = max((r.number for r in rows), default=0)
    return [r for r in rows if r.number == last]


def write_result(outputs: dict[str, DataFrame], folder: str) -> None:
    """Writes each output as Parquet below a run of its own, then the manifest that names the run: readers see the old result or the new one, whole."""
    spark = next(iter(outputs.values())).sparkSession
    before = _manifests(spark, folder)
    number, run = (before[0].number if before else 0) + 1, f"run_{uuid.uuid4().hex}"
    rows = []
    for name, df in outputs.items():
        df.write.parquet(f"{folder}/{run}/{name}")
        held = spark.read.parquet(f"{folder}/{run}/{name}")
        rows.append((number, run, name, held.count(), table_digest(held), VERSION))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")


def read_result(spark: SparkSession, folder: str, check: bool = False) -> dict[str, DataFrame]:
    """The outputs of the last complete result; with check, only if they are what was written."""
    manifest = _manifests(spark, folder)
    if not manifest or any(r.version != VERSION for r in manifest):
        raise ValueError(f"{folder}: no complete result of version {VERSION}")
    found = {r.output: spark.read.parquet(f"{folder}/{r.run}/{r.output}") for r in manifest}
    if check and (odd := [r.output for r in manifest if table_digest(found[r.output]) != r.digest]):
        raise ValueError(f"{folder}: {odd} is not what was written")
    return found


#: What each output is known by.
IDS = {"families": ("family", "family"), "links": ("link", "link"), "variants": ("variant", "variant"), "steps": ("observation", "ref"), "episodes": ("session", "session")}


def references(outputs: dict[str, DataFrame]) -> DataFrame:
    """(kind, ref) of everything that a result's rows can be referred to by."""
    rows = None
    for name, (kind, column) in IDS.items():
        if name in outputs:
            one = outputs[name].select(F.lit(kind).alias("kind"), F.col(column).cast("string").alias("ref")).distinct()
            rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("a result without families, links, variants, steps or episodes")
    return rows


def write_redacted(outputs: dict[str, DataFrame], folder: str, known: dict[str, str], key: str) -> None:
    """A copy of a result in which secrets (value: label), tokens and mail addresses are tags; ids stay, because they are hashes."""
    kept = {column for _, column in IDS.values()} | {"from", "to"}
    clean = {}
    for name, df in outputs.items():
        ids = [c for c in df.columns if c in kept]
        hidden = redacted_table(df.select([F.struct(*ids).alias("_ids")] + [c for c in df.columns if c not in kept]), known, key) if ids else redacted_table(df, known, key)
        clean[name] = hidden.select(*(f"_ids.{c}" if c in kept else c for c in df.columns)) if ids else hidden
    write_result(clean, folder)


def append_ledger(rows: DataFrame, folder: str, run: str) -> None:
    """Adds rows to a ledger of JSON lines, below their run."""
    rows.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(folder)


def read_ledger(spark: SparkSession, folder: str, schema: str, run: str | None = None) -> DataFrame:
    """Rows of a ledger, of one run or of all."""
    rows = spark.read.schema(f"{schema}, run string").json(folder)
    return rows if run is None else rows.where(F.col("run") == run)


def markdown(report: DataFrame, title: str) -> str:
    """A report (a few rows: kinds, measures or models) as a Markdown table in the order of its first column."""
    rows = report.orderBy(report.columns[0]).collect()
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + " --- |" * len(report.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


class Conflict(ValueError):
    """Another writer has committed a revision meanwhile."""


INDEX = "revision int, digest string, run string"


def _entries(spark: SparkSession, folder: str) -> list:
    try:
        return sorted(spark.read.schema(INDEX).json(f"{folder}/index/*.json").collect(), key=lambda r: r.revision)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []


def _claim(spark: SparkSession, path: str, line: str) -> bool:
    """Makes a new file of one line in one step; false if it is there already."""
    jvm = spark._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        return False
    with_line = fs.create(draft, False)
    with_line.write(bytearray(line.encode()))
    with_line.close()
    try:
        # a file is renamed whole, and never over one that is there
        return bool(fs.rename(draft, target)) if not fs.exists(target) else False
    finally:
        fs.delete(draft, False)


def commit_revision(nodes: DataFrame, folder: str, base: int | None = None) -> tuple[int, bool]:
    """Adds (node, content) as the next revision and returns its number; an unchanged description adds none.

    The rows are written to a folder of their own first; the revision is there as soon as its entry in the index is, and that is made in one step.  A
    writer that dies before leaves rows that nothing refers to: see drop_orphans.  With base, the revision that the rows were derived from, a
    commit on top of any other is a Conflict; so is one whose number another writer claims at the same moment.
    """
    spark = nodes.sparkSession
    entries = _entries(spark, folder)
    last = entries[-1] if entries else None
    if base is not None and base != (last.revision if last else 0):
        raise Conflict(f"based on revision {base}, but the last is {last.revision if last else 0}")
    run = f"rows_{uuid.uuid4().hex}"
    nodes.write.parquet(f"{folder}/{run}")
    digest, number = table_digest(spark.read.parquet(f"{folder}/{run}")), last.revision + 1 if last else 1
    if last and last.digest == digest:
        _delete(spark, f"{folder}/{run}")
        return last.revision, False
    if not _claim(spark, f"{folder}/index/{number:08d}.json", json.dumps({"revision": number, "digest": digest, "run": run}) + "\n"):
        raise Conflict(f"revision {number} was committed meanwhile")
    return number, True


def load_revision(spark: SparkSession, folder: str, number: int) -> DataFrame:
    """A revision, checked against the digest it was committed with."""
    known = [r for r in _entries(spark, folder) if r.revision == number]
    if not known:
        raise ValueError(f"no revision {number}")
    nodes = spark.read.parquet(f"{folder}/{known[0].run}")
    if table_digest(nodes) != known[0].digest:
        raise ValueError(f"revision {number} is not what was committed")
    return nodes


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_orphans(spark: SparkSession, folder: str, older_than: float = 24 * 3600) -> list[str]:
    """Deletes rows of commits that never came to stand and are older than so many seconds; names what it deleted."""
    known = {r.run for r in _entries(spark, folder)}
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in fs.listStatus(root)]
    gone = sorted(n for n, changed in found if n.startswith("rows_") and n not in known and time.time() - changed >= older_than)
    for name in gone:
        _delete(spark, f"{folder}/{name}")
    return gone

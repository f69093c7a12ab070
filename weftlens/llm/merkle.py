"""Manifest of a dataset: Merkle trees of its rows by source, with a version of the tree for every altered row.

A node is the SHA-256 of up to three nodes below it.  The tree is persistent: altering a row makes a version that shares every
node but the altered leaf and its ancestors, which are copied.  Leaves are laid out in aligned blocks of 3^6; a task holds a
block's subtree, copies paths inside it, and continues every version along the block's own way to the root, which upper rounds over
blocks of blocks have found.  So no task sees a whole tree, and no version passes through one task at the top.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import beside, written
from .places import numbered

FAN = 3
#: Levels that a block spans; a block holds at most FAN ** SPAN nodes of its lowest level.
SPAN = 6
BLOCK = FAN**SPAN
#: The tree over the subroots of all sources.
TOP = ""

Way = list[tuple[str, str]]


def _h(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of the values one after another, each as its length in bytes, a colon and its text; null is a hyphen."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def _levels(nodes: list[str], of: int) -> list[list[str]]:
    """A block's subtree from its lowest nodes up, where the whole tree has `of` nodes on the lowest level."""
    levels = [nodes]
    while of > 1 and len(levels) <= SPAN:
        below = levels[-1]
        levels.append([_h(below[k : k + FAN]) for k in range(0, len(below), FAN)])
        of = -(-of // FAN)
    return levels


def _way(levels: list[list[str]], k: int) -> Way:
    """Siblings left and right of node k and of its ancestors inside a block, joined on either side."""
    out = []
    for below in levels[:-1]:
        first = k - k % FAN
        out.append(("".join(below[first:k]), "".join(below[k + 1 : first + FAN])))
        k //= FAN
    return out


def _copied(leaf: str, way: Way) -> list[str]:
    """The nodes of a version: the altered leaf, and a copy of each of its ancestors."""
    nodes = [leaf]
    for left, right in way:
        nodes.append(_h((left, nodes[-1], right)))
    return nodes


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """One row a block: nodes (tree, place, of, hash, ...) of BLOCK consecutive places in order."""
    rows = F.array_sort(F.collect_list(F.struct("place", "hash", *more))).alias("rows")
    return written(nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.first("of").alias("of"), rows))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches, one block at a time in memory."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper node of each block, as a node of the next round."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("of", pa.int64()), ("hash", pa.string())])
    for r in _each(batches):
        yield _batch(schema, [(r["tree"], r["block"], -(-r["of"] // BLOCK), _levels([x["hash"] for x in r["rows"]], r["of"])[-1][0])])


NODE = "tree string, place long, of long, hash string"
WAY = "array<struct<left string, right string>>"
_WAY = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _climb(blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of blocks from the given lowest ones up, and the root of each tree (tree, hash)."""
    rounds, roots = [blocks], None
    while True:
        tops = written(rounds[-1].select("tree", "block", "of", "rows").mapInArrow(_tops, NODE))
        done = tops.where("of = 1").select("tree", "hash")
        roots = done if roots is None else roots.union(done)
        if tops.where("of > 1").isEmpty():
            return rounds, roots
        rounds.append(_blocks(tops.where("of > 1")))


def _ways(named: bool):
    """For each lowest node of upper blocks its way to the root, as that of a block below: the one at its place, or the only one of the tree it names."""

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("way", _WAY)])
        for r in _each(batches):
            levels = _levels([x["hash"] for x in r["rows"]], r["of"])
            above = [(w["left"], w["right"]) for w in r["way"] or ()]
            found = [[{"left": a, "right": b} for a, b in [*_way(levels, k), *above]] for k in range(len(levels[0]))]
            yield _batch(schema, [(x["source"], 0, way) if named else (r["tree"], x["place"], way) for x, way in zip(r["rows"], found)])

    return ways


def _with_ways(blocks: DataFrame, ways: DataFrame | None) -> DataFrame:
    if ways is None:
        return blocks.withColumn("way", F.lit(None).cast(WAY))
    return blocks.join(beside(written(ways)), ["tree", "block"], "left")


def _descend(rounds: list[DataFrame], ways: DataFrame | None) -> DataFrame:
    """The lowest blocks with the way from each to the root; `ways` (tree, block, way) has what lies above the trees' roots."""
    for k in range(len(rounds) - 1, 0, -1):
        below = _with_ways(rounds[k], ways).mapInArrow(_ways(named=False), f"tree string, block long, way {WAY}")
        # a tree whose root is lower than this round is still told of what lies above it
        ways = below if ways is None else below.union(ways.join(rounds[k].select("tree").distinct(), "tree", "left_anti"))
    return _with_ways(rounds[0], ways)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of a block's leaves, and a version of the tree for each."""
    text = pa.string()
    schema = pa.schema([("doc_id", pa.int64()), ("leaf", text), ("tree", text), ("place", pa.int64()), ("proof_sha256", text), ("copied", pa.list_(text))])
    for r in _each(batches):
        levels = _levels([x["hash"] for x in r["rows"]], r["of"])
        above = [(w["left"], w["right"]) for w in r["way"] or ()]
        rows = []
        for k, x in enumerate(r["rows"]):
            way = [*_way(levels, k), *above]
            rows.append((x["doc_id"], x["hash"], r["tree"], x["place"], _h(side for step in way for side in step), _copied(x["altered"], way)))
        yield _batch(schema, rows)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of blocks but those that belong to the next round, with their level and place in the whole tree."""
    schema = pa.schema([("tree", pa.string()), ("level", pa.int32()), ("place", pa.int64()), ("hash", pa.string())])
    for r in _each(batches):
        levels = _levels([x["hash"] for x in r["rows"]], r["of"])
        whole = -(-r["of"] // FAN ** (len(levels) - 1)) == 1
        rows = [(r["tree"], r["low"] + k, r["block"] * FAN ** (SPAN - k) + j, node) for k, level in enumerate(levels if whole else levels[:-1]) for j, node in enumerate(level)]
        yield _batch(schema, rows)


def altered_text(doc_id: Column, text: Column) -> Column:
    """The text that tampering leaves: without its line ends if the CRC of doc_id is even; else as it is."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.translate(text, "\n", "")).otherwise(text)


def _source(tree: str) -> Column:
    return F.when(F.col(tree) != "-", F.substring(tree, 2, (1 << 31) - 1)).alias("source")


class Manifest:
    """The trees of docs (doc_id, source, lang, n_chars, text), and versions of them for rows whose text is found altered.

    altered is an expression of the text as found (by default altered_text).  Rows of a source are ordered by doc_id (null first), those with
    equal doc_id by leaf; repeated rows are leaves of their own.  A null source is a source; null texts stay null when altered.  Other
    columns, whatever their names, are not covered.  No rows: no nodes and no rows.
    """

    def __init__(self, docs: DataFrame, altered: Column | None = None):
        found = altered if altered is not None else altered_text(F.col("doc_id"), F.col("text"))
        covered = lambda text: leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
        tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
        leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), covered(F.col("text")).alias("hash"), covered(found).alias("altered"))
        self.rounds, subroots = _climb(_blocks(numbered(leaves, ["tree"], ["doc_id", "hash"]), "doc_id", "altered"))
        self.subroots = written(subroots)
        ordered = numbered(self.subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("source"), "hash"), ["tree"], ["source"])
        self.top_rounds, self.root = _climb(_blocks(ordered, "source"))

    def rows(self) -> DataFrame:
        """Every row with its leaf, its proof, and the version of the tree that its altered text makes.

        doc_id, source, place (in the source, from 0), leaf, subroot (of the source), root, proof_sha256 (of the siblings on the way to the
        root), copied (the nodes of the row's version: its leaf as found, then copies of its ancestors up to the version's root; all other
        nodes are shared), folded_root (the last of them), verified (whether that is the root).
        """
        tops = _descend(self.top_rounds, None).mapInArrow(_ways(named=True), f"tree string, block long, way {WAY}")
        schema = "doc_id long, leaf string, tree string, place long, proof_sha256 string, copied array<string>"
        out = _descend(self.rounds, written(tops)).mapInArrow(_leaves, schema)
        out = out.join(beside(self.subroots.withColumnRenamed("hash", "subroot")), "tree").crossJoin(F.broadcast(self.root.select(F.col("hash").alias("root"))))
        folded = F.element_at("copied", -1)
        return out.select("doc_id", _source("tree"), "place", "leaf", "subroot", "root", "proof_sha256", "copied", folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))

    def nodes(self) -> DataFrame:
        """All nodes of the sources' trees: source, level (leaves at 0), place, hash."""
        schema = "tree string, level int, place long, hash string"
        parts = [r.select("tree", "block", "of", "rows", F.lit(k * SPAN).alias("low")).mapInArrow(_nodes, schema) for k, r in enumerate(self.rounds)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.select(_source("tree"), "level", "place", "hash")

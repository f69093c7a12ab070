import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from weftlens.llm.merkle import Manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    sources = defaultdict(list)
    for i, text, lang, source, n in rows:
        found = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        sources[source].append((i is not None, i or 0, leaf((i, source, lang, n, text)), leaf((i, source, lang, n, found)), i))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(sources[s])]) for s in order}
    top = levels_of([trees[s][-1][0] for s in order])
    out = []
    for place, s in enumerate(order):
        for k, x in enumerate(sorted(sources[s])):
            proof, node = [], x[3]
            for levels, at in ((trees[s], k), (top, place)):
                for below in levels[:-1]:
                    first = at - at % 3
                    left, right = "".join(below[first:at]), "".join(below[at + 1 : first + 3])
                    proof += [left, right]
                    node = h((left, node, right))
                    at //= 3
            out.append((str(x[4]), x[2], trees[s][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(out)


def found(manifest):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in manifest.rows().collect())


def test_against_plain_trees(docs, corpus):
    assert found(Manifest(docs)) == brute([c[:5] for c in corpus])


@pytest.fixture(scope="module")
def many():
    """Sources of every height around a block: 1, 2, 3, 4, 729, 730 and 2,300 rows."""
    rng = random.Random(3)
    sizes = {"one": 1, "two": 2, "three": 3, "four": 4, "block": 729, "over": 730, "long": 2300, None: 10}
    rows = [(s, f"t{rng.randint(0, 9)}\n{rng.randint(0, 9)}" if rng.random() < 0.9 else None) for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    return [(k, text, rng.choice(["en", None]), s, None if text is None else len(text)) for k, (s, text) in enumerate(rows)]


def test_many_blocks(spark, many):
    df = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    manifest = Manifest(df)
    rows = manifest.rows().collect()
    assert sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows) == brute(many)
    nodes = {(r.source, r.level, r.place): r.hash for r in manifest.nodes().collect()}
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append((r.place, r.leaf))
    for source, leaves in sources.items():
        levels = levels_of([x for _, x in sorted(leaves)])
        assert {k[1:]: v for k, v in nodes.items() if k[0] == source} == {(k, j): x for k, level in enumerate(levels) for j, x in enumerate(level)}
    for r in rows:  # a version copies one node a level, and nothing where nothing was altered
        height = len(levels_of([x for _, x in sorted(sources[r.source])])) + len(levels_of(["x"] * len(sources))) - 1
        assert len(r.copied) == height and r.verified == (r.copied[0] == r.leaf)


def test_no_rows(no_docs):
    assert Manifest(no_docs).rows().count() == 0


def test_one_row(spark):
    df = spark.createDataFrame([(2, "a\nb", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert found(Manifest(df)) == brute([(2, "a\nb", None, None, 3)])


def test_hot_ids_and_reruns(spark):
    rows = [(None, f"x{k % 7}", "en", "s", 2) for k in range(1500)] + [(k, "same", "en", "s", 4) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(Manifest(df)) == found(Manifest(df.repartition(7))) == brute(rows)

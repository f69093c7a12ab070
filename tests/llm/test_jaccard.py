import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from weftlens.llm import jaccard, scan

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("size,percent,block", [(4, 85, 256), (5, 80, 3)])
def test_components_equal_brute_force(docs, corpus, size, percent, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    out = jaccard.jaccard_components(docs, size, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out) == brute([(c[0], c[1]) for c in corpus], size, percent)


def test_chains_across_groups(spark, words, monkeypatch):
    """Texts that drift word by word: neighbours link, ends don't; a passage is shared by unlike texts."""
    monkeypatch.setattr(jaccard, "BLOCK", 5)
    monkeypatch.setattr(jaccard, "LONG", 4)
    rng = random.Random(4)
    rows, text = [], [rng.choice(words) for _ in range(60)]
    for i in range(40):
        rows.append((i, " ".join(text)))
        text[rng.randrange(60)] = rng.choice(words)
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows += [(100 + i, passage + " " + " ".join(rng.choice(words) for _ in range(rng.choice([5, 9, 40])))) for i in range(40)]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out) == brute(rows, 4, 85)


def test_group_bound_holds_between_its_ends(spark, monkeypatch):
    """Sets of 18, 19 and 20 in one group: 18 and 19 share 17 of 20, which neither end of the sizes tells."""
    monkeypatch.setattr(jaccard, "_frequency_classes", lambda docs, size: np.zeros(1 << jaccard.SKETCH_BITS, np.uint8))
    passage = "bbe cha ajg hgb hbc feb fjb bec ccd jfd fbi egh efh idh bce bbd ggg gca hcg cgh"
    rows = [(1, f"{passage} bbe"), (2, f"{passage} hhe adj"), (3, "fbf eaf bhd cgd jfc gbc iii hei dfc dcd fjb bec ccd jfd chi icg eji dhf gaf aje iib hce dch")]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in out) == brute(rows, 4, 85) == [("1", 18, 1), ("2", 19, 1), ("3", 20, 3)]


@pytest.mark.parametrize("percent", [80, 85])
def test_group_bound_covers_every_size(spark, percent):
    sizes = spark.range(1, 60).selectExpr("id as n").crossJoin(spark.range(1, 80).selectExpr("id as b")).crossJoin(spark.range(1, 12).selectExpr("id as c"))
    sizes = sizes.where(f"100 * least(n, b) >= {percent} * greatest(n, b)").where(jaccard._enough("c", "n", "b", percent))
    ends = sizes.selectExpr("*", "explode(sequence(greatest(b - 3, 1), b)) as lo").selectExpr("*", "explode(sequence(b, b + 3)) as hi")
    assert ends.where(f"not {jaccard._any_enough('c', 'n', 'lo', 'hi', percent)}").count() == 0 < ends.count()


def test_keep_one(docs, corpus):
    out = jaccard.keep_one(docs, 4, 85).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "size"}
    ids = [r.doc_id for r in out]
    assert ids.count(7) == 1 and not {*ids} & set(range(200, 260)) and ids.count(3) == 1
    assert {400, 401, 402, 403, 404, None} <= {*ids}


def test_empty(no_docs):
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_words_and_slices():
    column = pa.array(["a b", None, "", " x\ty\n", "é\x0bü ", "q" * 50], pa.string())
    for slice_bytes in (1, 7, 1 << 20):
        got = []
        for t in scan.texts(column.slice(1), slice_bytes):
            starts, ends, first = t.words()
            for k in range(t.n):
                got.append([bytes(t.data[a:b]).decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])])
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in column.slice(1).to_pylist()]
    t = next(scan.texts(pa.array(["ab ab ba"])))
    a, b, c = t.span_hash(t.prefix_hash(t.data), *t.words()[:2])
    assert a == b != c and isinstance(a, np.uint64)

import re
from collections import defaultdict

import pytest

from weftlens.llm import mixing


def expected_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_targets_and_taken(docs, corpus):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(corpus)
    sizes, taken = defaultdict(int), defaultdict(int)
    for c in corpus:
        sizes[c[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", c[1] or ""))
    want = expected_targets(sizes)
    for r in rows:
        source = r.row.source
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source]
        assert 0 <= r.taken <= 2 * r.size and r.row.size == 1
        taken[source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_reruns_agree(docs):
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, mixing.mix(docs.repartition(7)).collect()))


def test_copies_hold_what_is_taken(docs):
    mixed = mixing.mix(docs).cache()
    out = mixing.copies(mixed).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "size"}
    assert all(r.n_chars == len(r.text) for r in out)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out) == mixed.agg({"taken": "sum"}).first()[0]


def test_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0

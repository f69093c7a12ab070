import hashlib
import random

import numpy as np
import pytest

from weftlens.llm import suffixes


def brute(rows, length):
    """By (doc_id, text): bytes, removed, spans and hash."""
    docs = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, out = set(), {}
    for k, (blank, i, t) in enumerate(docs):
        raw = t.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[None if blank else i, t] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def test_repeats_of_aligned_rows():
    """Rows with a gram in common, against a comparison of all strings that stand as far from it."""
    rng = random.Random(5)
    for _ in range(60):
        length, letters = rng.randint(3, 6), rng.choice([b"ab", b"a", b"abc\x00\xff"])
        rows, ahead = [], []
        for _ in range(rng.randint(1, 30)):
            left, right = rng.randint(0, 5), rng.randint(2, 7)
            rows.append(bytes(rng.choice(letters) for _ in range(left)) + b"GG" + bytes(rng.choice(letters) for _ in range(right)))
            ahead.append(left)
        rank = np.array(rng.sample(range(100), len(rows)))
        want = set()
        for k, (r, a) in enumerate(zip(rows, ahead)):
            for s in range(min(a + 1, len(r) - length + 1)):
                others = (o[b - a + s : b - a + s + length] for o, b, low in zip(rows, ahead, rank) if low < rank[k] and b - a + s >= 0)
                if r[s : s + length] in list(others):
                    want.add((k, s))
        row, start, count = suffixes.repeats(rows, np.array(ahead), rank, length)
        got = [(int(r), int(s) + j) for r, s, n in zip(row, start, count) for j in range(n)]
        assert len(got) == len(set(got)) and set(got) == want


def test_sliding_least():
    x = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    for w in (1, 3, 10, 100):
        assert suffixes.sliding_least(x, w).tolist() == [min(x[k : k + w]) for k in range(101 - w)]
    assert len(suffixes.sliding_least(x, 101)) == 0


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = prose(40), prose(90)
    out = [(i, prose(rng.randint(1, 60)) + " " + passage + " " + prose(rng.randint(0, 30))) for i in range(40)]
    for i in range(40, 70):
        w = base.split()
        w[rng.randrange(90)] = rng.choice(words)
        out.append((i, " ".join(w)))
    out += [(70 + i, out[5][1]) for i in range(20)] + [(95, base + base), (96, "ab" * 400), (97, "x" * 300), (98, "x" * 99), (99, "x" * 100)]
    out += [(100, None), (101, ""), (None, out[7][1]), out[8], out[8], (8, passage + " other text of id 8")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("large", [4096, 3])
def test_against_brute_force(spark, rows, large, monkeypatch):
    monkeypatch.setattr(suffixes, "LARGE", large)
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(3)
    out = suffixes.remove_repeats(frame, 100).collect()
    want = brute([r for r in rows if r[0] != 8], 100)
    plain = suffixes.remove_repeats(frame.where("doc_id <> 8 or doc_id is null"), 100).collect()
    assert len(out) == len(rows)
    texts = {}
    for (i, t), found in want.items():
        texts.setdefault(i, set()).add(found)
    for r in plain:
        assert tuple(r[1:5]) in texts[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256


def test_no_rows(no_docs):
    assert suffixes.remove_repeats(no_docs).count() == 0

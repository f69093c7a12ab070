import random
import re

import numpy as np
import pyarrow as pa
import pytest

from weftlens.llm import lines
from weftlens.llm.scan import texts


def marks(line):
    return [int(x[0]) for x in lines.Lines(next(texts(pa.array([line]))), 1).hashed()]


def meet(a, b):
    """Whether fingerprints share two of five blocks and differ in ten bits at most."""
    a, b = a & (2**64 - 1), b & (2**64 - 1)
    edges = [0, 13, 26, 38, 51, 64]
    same = sum((a >> lo) % (1 << (hi - lo)) == (b >> lo) % (1 << (hi - lo)) for lo, hi in zip(edges, edges[1:]))
    return same >= 2 and (a ^ b).bit_count() <= 10


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        nxt = [i + 1]
        for j, y in enumerate(b):
            nxt.append(min(row[j] + (x != y), row[j + 1] + 1, nxt[-1] + 1))
        row = nxt
    return row[-1]


def brute(rows, min_words=5, similarity=0.9):
    """Texts that stay, by (doc_id, text)."""
    counts = lambda x: len(lines.normalised(x).split()) >= min_words or re.search(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]", x)
    seen = sorted({(i is None, i or 0, t or "", k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if counts(x)})
    norm = [lines.normalised(s[4]) for s in seen]
    mark = {n: marks(n)[1] for n in set(norm)}
    root = list(range(len(seen)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(seen)):
        for j in range(i):
            a, b = norm[i], norm[j]
            long = min(len(a.split()), len(b.split())) >= min_words
            if a == b or long and meet(mark[a], mark[b]) and 1 - distance(a, b) / max(len(a), len(b)) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    gone = {(s[0], s[1], s[2], s[3]) for i, s in enumerate(seen) if find(i) != i}
    return {(i, t): t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i is None, i or 0, t, k) not in gone) for i, t in rows}


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(9)
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [line(40) for _ in range(6)]

    def near(x):
        w = x.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w)

    chain = [base[0]]
    for _ in range(8):
        chain.append(near(chain[-1]))
    out = [(i, "\n".join([line(12), rng.choice(base), rng.choice(chain), near(rng.choice(base)), "", "Too short"])) for i in range(40)]
    out += [(50, "Total: 17 of 20 words, on PAGE 3"), (51, "total 99 of 11 words on page 4!"), (52, "total 99 of 11 words on page 4!\ntotal 99 of 11 words on page 4!")]
    out += [(60, None), (61, ""), (62, "\n\n"), (None, base[1] + "\nnull id, last of all in the order"), out[3], out[3], (63, line(3000)), (5, "another text with the same id")]
    return out


def test_against_brute_force(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, lang string, n_lines int").repartition(3)
    out = lines.dedup_lines(frame).collect()
    want = brute(rows)
    texts_by_id = {}
    for (i, t), kept in want.items():
        texts_by_id.setdefault(i, set()).add(kept)
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "lang", "n_lines", "n_removed"}
    for r in out:
        assert r.text in texts_by_id[r.doc_id], r.doc_id
    assert {i: r.n_removed for r in out if (i := r.doc_id) in (50, 51, 52)} == {50: 0, 51: 1, 52: 2}


def test_marks(words):
    rng = random.Random(1)
    text = "\n".join(["a b c d e", "", "A, b? c d e!", "x y", "12 34", " ".join(rng.choice(words) for _ in range(30))])
    t = next(texts(pa.array(["", text, None, text + "\n"])))
    found = lines.Lines(t, 5)
    whole, mark = found.hashed()
    assert found.owner.tolist() == [1] * 4 + [3] * 4 and found.number.tolist() == [0, 2, 3, 5] * 2 and found.count.tolist() == [5, 5, 2, 30] * 2
    assert whole[0] == whole[1] == whole[4] != whole[2] == whole[6] and mark[3] == mark[7]
    assert re.sub(" +", " ", lines.normalised("A-b  c9é")) == "a b c0é" and isinstance(whole[0], np.int64)


def test_simhash_of_many_words():
    rng = np.random.default_rng(3)
    sizes = [1, 3, 255, 256, 700, 2]
    line = np.repeat(np.arange(len(sizes)), sizes)
    words = rng.integers(0, 1 << 63, len(line)).astype(np.uint64)
    words = np.concatenate([words, words[5:9]])  # repeated words of a line count once
    line = np.concatenate([line, line[5:9]])
    order = np.argsort(line, kind="stable")
    got = lines._simhash(words[order], line[order], len(sizes))
    for k in range(len(sizes)):
        own = lines.mix(np.unique(words[line == k] >> np.uint64(24)))
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(0)
        assert int(got[k]) == int(np.packbits(2 * bits > len(own)).view(np.uint64)[0])


def test_words_of_scripts_without_spaces():
    found = lines.Lines(next(texts(pa.array(["所有权利 均予保留 abc\né à b", None]))), 5)
    assert found.count.tolist() == [9, 3]


@pytest.mark.parametrize("x,y,want", [("abcdef", "abxdef", ("c", "x")), ("aaaa", "aaaaa", ("", "a")), ("", "", ("", "")), ("abab", "ab", ("ab", ""))])
def test_between(x, y, want):
    assert lines.between(x, y, 0.0)[2] >= 0
    k, m = lines._same_length(x, y, False), max(len(x), len(y))
    a, b = x[k:], y[k:]
    k = lines._same_length(a, b, True)
    assert (a[: len(a) - k], b[: len(b) - k]) == want and m >= len(want[0])


def test_verification_is_edit_similarity(words):
    rng = random.Random(4)
    for _ in range(200):
        x = " ".join(rng.choice(words) for _ in range(rng.randint(5, 14)))
        y = list(x)
        for _ in range(rng.randint(0, 12)):
            y[rng.randrange(len(y))] = rng.choice(["", "q", "zz"])
        y = "".join(y)
        a, b, most = lines.between(x, y, 0.9)
        similar = most >= 0 and (not a and not b or distance(a, b) <= most)
        assert similar == (1 - distance(x, y) / max(len(x), len(y)) >= 0.9 - 1e-12)


def test_few_edits_in_long_lines_leave_no_table_of_distances(words):
    rng = random.Random(6)
    for n in (40, 400, 6000):
        x = [rng.choice(words) for _ in range(n)]
        y = list(x)
        y[1], y[n // 2], y[-2] = "qqq", "", "zzzz"
        a, b = " ".join(x), " ".join(y)
        assert lines.between(a, b, 0.9) == ("", "", int(0.1 * max(len(a), len(b)) + 1e-6))


def test_a_walk_finds_no_fewer_edits_than_there_are():
    rng = random.Random(11)
    found = 0
    for _ in range(400):
        x = "".join(rng.choice("ab c") for _ in range(rng.randint(0, 60)))
        y = list(x)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(y))
            y[at : at + rng.randint(0, 2)] = rng.choice(["", "q", "ab"])
        y = "".join(y)
        most = rng.randint(0, 12)
        if lines.walked(x, y, most):
            found += 1
            assert distance(x, y) <= most, (x, y, most)
    assert found > 100 and lines.walked("", "", 0) and not lines.walked("", "a", 0) and lines.walked("", "a", 1)


def test_recall_against_edit_similarity_alone(words):
    """Of lines in which one word is replaced and that are still similar, this share is found."""
    rng = random.Random(8)
    found = {}
    for n in (16, 25, 40, 80):
        hits = []
        while len(hits) < 150:
            x = [rng.choice(words) for _ in range(n)]
            y = list(x)
            y[rng.randrange(n)] = rng.choice(words)
            a, b = " ".join(x), " ".join(y)
            if a != b and 1 - distance(a, b) / max(len(a), len(b)) >= 0.9:
                hits.append(meet(marks(a)[1], marks(b)[1]))
        found[n] = sum(hits) / len(hits)
    assert found[16] > 0.35 and found[25] > 0.5 and found[40] > 0.65 and found[80] > 0.8, found


def test_a_large_bucket_over_tasks_and_batches(spark, words):
    """Near copies of one line beyond a batch and beyond SMALL, in buckets dealt over several tasks."""
    rng = random.Random(6)
    base = [rng.choice(words) for _ in range(120)]
    name = lambda i: "".join("qvwxyz"[i // 6**k % 6] for k in range(4))
    rows = [(i, " ".join([*base[:60], name(i), *base[61:]])) for i in range(400)]
    kept = {"spark.sql.execution.arrow.maxRecordsPerBatch": "50", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # all lie within four letters of each other; a line whose fingerprint strays from all others may stay
    assert len(out) == 400 and 0 in {r.doc_id for r in out if r.text} and sum(bool(r.text) for r in out) <= 4


def test_clashing_names(spark):
    line = "one two three four five six"
    rows = [(1, line, 7, 8, 9, 10), (2, line, 7, 8, 9, 10)]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, row int, gone int, _row int, line int")).collect()
    assert {(r.doc_id, r.text, r.row, r.gone, r._row, r.line) for r in out} == {(1, line, 7, 8, 9, 10), (2, "", 7, 8, 9, 10)}


def test_query_joins_equal_short_lines(spark, tmp_path):
    from weftlens.llm.queries import op2_fuzzy_lines

    zh = "所有权利均予保留未经许可不得转载"
    rows = [(1, f"All rights reserved.\n17\n{zh}\n\none two three four"), (2, f"all RIGHTS reserved\n42\n{zh}\n\none two three five"), (None, "All rights reserved!")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in op2_fuzzy_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, rows[0][1]), 2: (3, 2, "42\n\none two three five"), None: (1, 1, "")}


def test_no_rows(no_docs):
    assert lines.dedup_lines(no_docs).count() == 0

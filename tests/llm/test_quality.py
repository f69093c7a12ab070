import re

import numpy as np
import pyarrow as pa

from weftlens.llm import quality, scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w, at, covered, seen, dup = WORD.findall(text or ""), {}, set(), set(), 0
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    for found in at.values():
        if len(found) > 1:
            for k in found:
                covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    for x in lines:
        dup += x in seen
        seen.add(x)
    closed = sum(WORD.findall(x)[-1][-1] in ".!?\"')" for x in lines)
    letters = sum(any(c.isascii() and c.isalpha() or ord(c) > 127 for c in x) for x in w)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(lines), closed, letters, sum(c.isascii() and c.isdigit() for x in w for c in x), len(set(w))]


ODD = [
    None, "", "\n", "a\n", "\n\na\n a \na", "x y z\nx y z\n\nx y z", "é ü\r\né ü\r\n", "a b c d e f g h " * 3, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8 x",
    "# * $ %\x0b& | < >", " a\na ", "word." + " tail" * 30,
]


def test_counts_equal_brute_force(spark, docs, corpus):
    for size in (1, 40, 1 << 20):
        column = pa.array([*ODD, *ODD[::-1]], pa.string())
        got = np.concatenate([quality.measure(t) for t in scan.texts(column, size)])
        assert got.tolist() == [brute(x) for x in [*ODD, *ODD[::-1]]]
    out = quality.counts(docs).collect()
    assert sorted([str(r[0]), *r[1:]] for r in out) == sorted([str(c[0]), *brute(c[1])] for c in corpus)


def plain_em(rows, rules, rounds):
    """The same model one document and one rule at a time."""
    good, says = 0.8, [[0.02, 0.3] for _ in range(rules)]
    for _ in range(rounds):
        weight = []
        for votes in rows:
            both = [good, 1 - good]
            for k, v in enumerate(votes):
                for c in (0, 1):
                    both[c] *= 1.0 if v == 0 else says[k][c] if v < 0 else 1 - says[k][c]
            weight.append([x / sum(both) for x in both])
        good = min(max(sum(w[0] for w in weight) / len(rows), 0.0001), 0.9999)
        new = []
        for k in range(rules):
            rate = []
            for c, start in enumerate((0.02, 0.3)):
                bad = start + sum(w[c] for w, votes in zip(weight, rows) if votes[k] < 0)
                any_ = 1 + sum(w[c] for w, votes in zip(weight, rows) if votes[k])
                rate.append(min(max(bad / any_, 0.0001), 0.9999))
            new.append(rate)
        says = new
    return good, says


def drawn(rng, n, good_share, bad_if_good, bad_if_bad):
    kind = rng.random(n) < good_share
    says = np.where(kind[:, None], bad_if_good, bad_if_bad)
    votes = np.where(rng.random((n, len(bad_if_good))) < says, -1, 1) * (rng.random((n, len(bad_if_good))) < 0.8)
    return kind, votes


def test_estimate_equals_a_plain_em():
    rng = np.random.default_rng(2)
    _, votes = drawn(rng, 400, 0.8, np.array([0.02, 0.05, 0.1, 0.3]), np.array([0.9, 0.6, 0.5, 0.35]))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    a = quality.estimate(patterns.astype(float), counts.astype(float))
    good, says = plain_em(votes.tolist(), 4, 400)
    assert abs(a.good - good) < 1e-4 and np.allclose(a.says_bad, says, atol=1e-4)


def test_accuracies_are_recovered():
    rng = np.random.default_rng(1)
    right, wrong = np.array([0.9, 0.7, 0.5, 0.6, 0.4]), np.array([0.01, 0.02, 0.05, 0.1, 0.2])
    kind, votes = drawn(rng, 40_000, 0.85, wrong, right)
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    a = quality.estimate(patterns.astype(float), counts.astype(float))
    assert abs(a.good - 0.85) < 0.03 and np.allclose([x for x, _ in a.says_bad], wrong, atol=0.03) and np.allclose([y for _, y in a.says_bad], right, atol=0.06)
    # of the rules that speak against a document, a weak one alone is overruled
    odds = np.log((1 - a.good) / a.good) + (votes > 0) @ [np.log((1 - y) / (1 - x)) for x, y in a.says_bad] + (votes < 0) @ [np.log(y / x) for x, y in a.says_bad]
    verdict, all_pass = odds <= 0, (votes >= 0).all(1)
    assert (verdict == kind).mean() > (all_pass == kind).mean() + 0.1


def test_no_documents_to_learn_from():
    assert quality.estimate(np.zeros((0, 3)), np.zeros(0)) == (0.8, [(0.02, 0.3)] * 3)


def test_judge_equals_a_plain_model(spark, docs):
    """Rules voted by another engine, and the plain EM, give each document's probability and verdict."""
    import duckdb

    out = quality.judge(docs).toPandas()
    sql = ", ".join(f"CASE WHEN {r.good} THEN 1 WHEN {r.bad} THEN -1 ELSE 0 END" for r in quality.RULES)
    votes = duckdb.sql(f"SELECT {sql} FROM out").fetchall()
    open_ = [v for v, failed in zip(votes, out.base_failed) if not failed]
    good, says = plain_em(open_, len(quality.RULES), 3000)
    for v, r in zip(votes, out.itertuples()):
        both = [good, 1 - good]
        for k, x in enumerate(v):
            for c in (0, 1):
                both[c] *= 1.0 if x == 0 else says[k][c] if x < 0 else 1 - says[k][c]
        p = both[0] / sum(both)
        assert abs(p - r.p_good) < 1e-4 and (r.kept == (not r.base_failed and p >= 0.5) or abs(p - 0.5) < 1e-4)


def test_judge(spark, docs, corpus, words):
    out = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(out) == len({c[0] for c in corpus})
    for i in (400, 401, 402, 403):
        assert out[i].base_failed and not out[i].kept
    for r in out.values():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    clean = [r for i, r in out.items() if i is not None and i < 120 and r.n_words >= 50]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)


def test_empty(no_docs):
    assert quality.judge(no_docs).count() == 0

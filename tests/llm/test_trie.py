import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from weftlens.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, d1 string"  # with columns that clash


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + turns[h:]
    return out


def brute(rows):
    """Nodes from a dictionary of whole prefixes, their sums from the ends of the prefixes up."""
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    ids, last = {(): 0}, {0: 0}
    parent, depth = {0: None}, {0: 0}
    for c in sorted(convs):
        node = 0
        members[0].append(c)
        for turn in convs[c]:
            key = (node, turn)
            if key not in ids:
                ids[key] = len(ids)
                parent[ids[key]], depth[ids[key]], last[ids[key]] = node, depth[node] + 1, len(turn[1])
            node = ids[key]
            members[node].append(c)
        ends[node].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in parent:
        if parent[n] is not None:
            kids[parent[n]] += 1
    for n in sorted(parent, key=lambda n: -depth[n]):
        leaves[n] += not kids[n]
        saved[n] += (len(members[n]) - 1) * last[n]
        if parent[n] is not None:
            leaves[parent[n]] += leaves[n]
            saved[parent[n]] += saved[n]
    if not convs:
        return []
    sha = lambda n: hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()
    out = [(members[n][0], depth[n], None if parent[n] is None else members[parent[n]][0], len(members[n]), kids[n], leaves[n], saved[n], sha(n)) for n in parent]
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(parts)
    out = trie.prefix_trie(df).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out), key=str) == brute(rows)
    assert len({(r.d1, r.d2) for r in out}) == len(out)


def some(rng, conv, n):
    return [(conv, k, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "long text"])) for k in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [r for c in [*range(150), 277, 301, 399, -5, -250, -200] for r in some(rng, c, rng.randint(1, 9))]
    rows += [(c, None, "user", "same") for c in range(500, 620) for _ in range(2)]  # groups of equal conversations, equal turns
    rows += [(7, 1, "user", "tie"), (7, 1, "user", "tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    check(spark, rows)


def test_long_conversations_and_common_turns(spark):
    rng = random.Random(5)
    rows = [(100, k, "user", f"t{k % 11}") for k in range(9000)] + [(101, k, "user", f"t{k % 11}") for k in range(9000)]
    rows += [(c, 0, "system", "the same start") for c in range(1000, 4000)]
    rows += [(c, 1, "user", rng.choice("abc")) for c in range(1000, 4000) if c % 3]
    rows += [(102, k, "user", f"t{k % 11}" if k < 5000 else "x") for k in range(6000)]
    check(spark, rows, 7)


def test_no_rows(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x")], SCHEMA)).count() == 0


def test_one_conversation_without_turns(spark):
    # conversation c takes over h turns of one that isn't there, and has h turns or fewer of its own
    conv = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    check(spark, [(conv, 0, "user", "gone")])


def test_slots():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 70000):
        hi, lo = rng.integers(0, 1 << 63, n).astype(np.uint64), rng.integers(0, 4, n).astype(np.uint64)
        table = trie.SlotTable(hi, lo)
        assert sorted(table.slots(hi, lo).tolist()) == list(range(n))
        assert (table.slots(hi, lo + np.uint64(9)) == -1).all()

import random
import zlib
from collections import defaultdict

from weftlens.llm import sharding


def test_rows_groups_and_slots(docs, corpus):
    rows = sharding.shard_by_bytes(docs, 16).collect()
    by = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in rows), key=by) == sorted(((c[0], c[1]) for c in corpus), key=by)
    homes, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        homes[r.text].add(r.shard)
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 16
    assert all(len(s) == 1 for s in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute(sizes, shards):
    """Smallest largest sum over all contiguous partitions."""
    best = {0: 0}
    for _ in range(shards):
        nxt = dict(best)
        for at, most in best.items():
            run = 0
            for to in range(at, len(sizes)):
                run += sizes[to]
                nxt[to + 1] = min(nxt.get(to + 1, 1 << 60), max(most, run))
        best = nxt
    return best[len(sizes)]


def test_capacity_is_the_minimax():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.choice([1, 2, 5, 9, 40]) for _ in range(rng.randint(1, 24))]
        shards = rng.randint(1, 6)
        assert sharding.smallest_capacity(sizes, shards)[0] == brute(sizes, shards)


def test_cuts_from_spans_are_exact(spark):
    rng = random.Random(8)
    for n in (1, 5, 300):
        groups = [(rng.getrandbits(64) - (1 << 63) if k % 3 else (7 << 40) + rng.getrandbits(30), rng.randint(1, 50)) for k in range(n)]
        groups = list({k: (k, s) for k, s in groups}.values())
        cuts = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, size long"), 5)
        loads = defaultdict(int)
        for k, s in groups:
            loads[sum(k > c for c in cuts)] += s
        assert max(loads.values()) == brute([s for _, s in sorted(groups)], 5)


def test_shards_are_near_equal(spark, words):
    """Many texts of like sizes, one text with a third of all bytes aside: the largest shard is near the average of the others."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60)))) for i in range(4000)]
    rows += [(10_000 + i, "the same text in a third of all rows, and always the same") for i in range(2000)]
    loads = defaultdict(int)
    for r in sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 16).collect():
        loads[r.shard] += r.size
    hot = sum(len(t.encode()) + 1 for i, t in rows if i >= 10_000)
    rest = [v for v in loads.values() if v != hot]
    assert len(loads) == 16 and len(rest) == 15 and max(rest) <= 1.02 * sum(rest) / 15


def test_query_columns(spark, tmp_path, docs, corpus):
    from weftlens.llm.queries import op4_sharding

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op4_sharding(spark, str(tmp_path)).collect()
    assert set(rows[0].asDict()) >= {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    assert len(rows) == len(corpus) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(r.size for r in rows) == sorted(len((c[1] or "").encode()) + 1 for c in corpus)


def test_empty(no_docs):
    assert sharding.shard_by_bytes(no_docs, 16).count() == 0

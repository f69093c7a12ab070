import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftlens.llm import packing, queries


@pytest.fixture(scope="module")
def path():
    return queries.tokenizer_path()


@pytest.fixture(scope="module")
def direct(path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_ids_are_the_tokenizers(path, direct):
    odd = ["it's don't, ''s", "x<|endoftext|>y <|ENDOFTEXT|>, <|startoftext|>", "á Å ́b İX Σας ΣΑΣ", "“Quote,” end... 12,345!", "a　b\x85c", None, ""]
    ids = packing.WordIds(path)
    for _ in range(2):
        got = [x.tolist() for t in packing.texts(pa.array(odd, pa.string())) for x in ids.of(t)]
        assert got == [direct(x) for x in odd]


def test_pack(docs, corpus, path, direct):
    out = packing.pack(docs, path, 512).collect()
    want = Counter()
    for c in corpus:
        ids = np.array(direct(c[1]) + [1], "<u4")
        for s in range(0, len(ids), 512):
            want[str(c[0]), s // 512, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())] += 1
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= 1.05 * -(-sum(r.length for r in out) // 512) + 1


def test_plan_holds_every_piece_and_replaces_the_smallest():
    rng = random.Random(2)
    for _ in range(50):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(1, 300)))
        plan = packing.best_two_fit(counts, 100)
        held = Counter()
        for b in plan:
            assert sum(b.sizes) <= 100
            for s in b.sizes:
                held[s] += b.times
        assert held == counts
    # greedy takes 60 + 30 and leaves 10 empty; 25 + 15 fill what 30 leaves
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0].sizes == (60, 25, 15)


def test_empty(no_docs, path):
    assert packing.pack(no_docs, path).count() == 0

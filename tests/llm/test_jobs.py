import random

import pyarrow as pa
import pytest

from weftlens.llm import jaccard, jobs, langid, lines, packing
from weftlens.llm.jobs import components

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def brute(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, find(i)) for i in root)


def test_components(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 160)]
    for edges in (path + star + [(7, 7), (3, 4), (4, 3)], [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)], [(5, 5)]):
        out = components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted((r.node, r.root) for r in out.collect()) == brute(edges)


@pytest.fixture
def limit(spark):
    """Sets the session's limit of bytes in an Arrow batch; None: as it is without one."""
    before = spark.conf.get(BATCH, None)

    def put(value):
        spark.conf.unset(BATCH) if value is None else spark.conf.set(BATCH, value)

    yield put
    put(before)


@pytest.mark.parametrize(
    "step",
    [
        lines.dedup_lines,
        lambda d: langid.keep_identified(d, langid.Model([], None, None)),
        lambda d: langid.fit(d) and None,
        lambda d: jaccard.keep_one(d, size=5, percent=80),
        lambda d: packing.pieces(d, "unread"),
    ],
)
def test_batches_are_bounded_in_bytes(spark, limit, tmp_path, step):
    """What a Python worker gets at once doesn't grow with the length of the rows; a limit of the session's own stays."""
    texts = "repeat(concat(id, ' line of a text\n'), if(id = 9, 400000, 200))"
    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", f"{texts} text", "if(id < 20, 'en', null) lang")
    limit(None)
    step(docs.limit(20))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    seen = docs.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in seen) == 4000 and len(seen) >= 4
    assert max(r.bytes for r in seen) < jobs.BATCH_BYTES + 7_500_000  # a batch ends with the row that passes the limit
    assert sorted(r.bytes for r in seen)[-2] < jobs.BATCH_BYTES + 100_000
    limit("1000000")
    jobs.in_small_batches(docs)
    assert spark.conf.get(BATCH) == "1000000"


def test_batches_change_no_results(spark, docs, limit):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    model = langid.fit(docs)
    found = []
    for value in ("1", "2147483646"):
        limit(value)
        steps = [lines.dedup_lines(docs), langid.keep_identified(docs, model), jaccard.keep_one(docs, size=5, percent=80)]
        found.append([sorted(map(repr, x.collect())) for x in steps])
    assert found[0] == found[1]

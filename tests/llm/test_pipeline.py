import importlib.util
import pathlib
import random
import re
import zlib
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, docs, corpus):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null").distinct().cache()
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, "").cache()
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in before.schema]
            assert all(r.n_chars == len(r.text) for r in kept[name])
    ids = {name: [r.doc_id for r in rows] for name, rows in kept.items()}
    clean = {c[0] for c in corpus if c[0] is not None and c[0] < 120}
    assert not {400, 401, 402, 405} & {*ids["language_id"]} and clean <= {*ids["language_id"]}
    assert clean <= {*ids["line_dedup"]} and not {*range(200, 260)} & {*ids["line_dedup"]}
    seen = Counter(x for r in kept["line_dedup"] for x in r.text.split("\n") if len(x.split()) > 6)
    assert max(seen.values()) == 1
    assert len(ids["jaccard_join"]) == len({*ids["jaccard_join"]}) and {*ids["jaccard_join"]} <= {*ids["line_dedup"]}
    words = sum(len(WORD.findall(r.text)) for r in kept["jaccard_join"])
    assert abs(sum(len(WORD.findall(r.text)) for r in kept["mixing"]) - 1.5 * words) <= 4
    assert max(Counter(ids["mixing"]).values()) == 2
    assert Counter(r.doc_id for r in kept["packing"] if r.piece == 0) == Counter(ids["mixing"])


def test_run(spark, tmp_path, docs):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        held.sort()
        assert all(a + b == c for (a, b), (c, _) in zip(held, held[1:])) and held[-1][0] + held[-1][1] <= 4096


def plain(name):
    """A test module beside this one, for its plain versions."""
    path = pathlib.Path(__file__).with_name(f"{name}.py")
    spec = importlib.util.spec_from_file_location(f"plain_{name}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, _row string, size int, gone int"


@pytest.fixture(scope="module")
def rows(words):
    """Prose in two alphabets with copies, near copies, repeated lines, ties, nulls, a repeated row and columns with clashing names."""
    rng = random.Random(21)
    other = ["".join(rng.choice("mnopqrst") for _ in range(rng.randint(3, 7))) for _ in range(200)]
    prose = lambda w, n: "\n".join(" ".join(rng.choice(w) for _ in range(14)) for _ in range(n))
    out = [(i, prose(other if i % 3 == 0 else words, rng.randint(2, 6)), "bb" if i % 3 == 0 else "aa", rng.choice(["s0", "s1", None])) for i in range(36)]
    base = prose(words, 6).replace("\n", " ").split()
    for i in range(40, 46):
        near = list(base)
        near[i] = rng.choice(words)
        cut = rng.randint(30, 50)  # other lines, the same words
        out.append((i, " ".join(near[:cut]) + "\n" + " ".join(near[cut:]), "aa", "s1"))
    out += [(50, out[1][1] + "\n" + prose(words, 1), "aa", "s0"), (51, out[4][1], "aa", "s2"), (60, None, None, None), (61, "", "aa", "s0"), (62, "17 %%", None, "s1"), (None, prose(words, 2), "aa", "s0"), out[5]]
    return [(i, t, lang, s, None if t is None else len(t), 1, "x", 2, 3) for i, t, lang, s in out]


def test_stages_equal_plain_versions(spark, rows):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    run = lambda name, frame: stages[name](spark, frame, "").cache()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")

    # language: the same model, a text at a time
    from weftlens.llm import langid

    model, tongue = langid.fit(docs), plain("test_langid")
    kept = run("language_id", docs)
    want = []
    for r in docs.collect():
        if r.text and any(c.isalpha() for c in r.text):
            active, share = tongue.plain(r.text, model)
            if len(active) == 1 or share.max() >= 0.5:
                want.append(r)
    assert Counter(kept.collect()) == Counter(want)

    # lines: brute force over all pairs of lines
    lines = plain("test_lines")
    before = [(r.doc_id, r.text) for r in kept.collect()]
    left = lines.brute(before)
    deduped = run("line_dedup", kept)
    assert deduped.columns == docs.columns
    want = Counter((i, left[i, t]) for i, t in before if left[i, t] == t or (left[i, t] or "").strip())
    assert Counter((r.doc_id, r.text) for r in deduped.collect()) == want
    assert all(r.n_chars == len(r.text) and (r.row, r._row, r["size"], r.gone) == (1, "x", 2, 3) for r in deduped.collect())

    # near copies: all pairs of shingle sets
    def shingles(text):
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    mine = sorted(set(deduped.select("doc_id", "text").collect()), key=key)
    root = list(range(len(mine)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(r.text) for r in mine]
    for i in range(len(mine)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [r for k, r in enumerate(mine) if find(k) == k or not sets[k] or r.doc_id is None]
    joined = run("jaccard_join", deduped)
    assert sorted(((r.doc_id, r.text) for r in joined.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])) == sorted(map(tuple, want), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len(want) < len(mine) and joined.columns == docs.columns

    # mixing: the SQL of the mix, and the words that each document gives
    import duckdb

    from weftlens.llm.queries import OP10_SQL

    documents = joined.select("doc_id", "text", "source").toArrow()  # noqa: F841
    taken = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, sum(taken) FROM ({OP10_SQL}) GROUP BY doc_id").fetchall() if r[1]}
    mixed = run("mixing", joined)
    words_of = Counter()
    for r in mixed.collect():
        words_of[r.doc_id] += len(WORD.findall(r.text))
    assert dict(words_of) == {k: int(v) for k, v in taken.items()} and mixed.columns == docs.columns

    # packing: the tokenizer itself on whole texts
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = Counter()
    for r in mixed.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r.doc_id, piece, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    packed = stages["packing"](spark, mixed, "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in b) <= 4096 and sorted(b)[0][0] == 0 and all(x + n == y for (x, n), (y, _) in zip(sorted(b), sorted(b)[1:])) for b in bins.values())


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlens.llm import langid

TONGUES = {"xx": "abcdefg", "yy": "nopqrst", "zz": "éüßäöaeiou"}


def prose(rng, tongue, n):
    letters = TONGUES[tongue]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, tongue := rng.choice([*TONGUES]), rng.randint(5, 80)), tongue) for i in range(300)]
    rows += [(500, None, "xx"), (501, "", None), (502, "12 %% 34", "yy"), (503, prose(rng, "xx", 60) + " " + prose(rng, "zz", 140), "zz"), (504, "№ ٣", "yy"), (None, "abc def", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_mixtures(labelled):
    model = langid.fit(labelled.where(~langid.held_out(F.col("doc_id"))))
    assert model.languages == ["xx", "yy", "zz"]
    rows = {r.doc_id: r for r in labelled.join(langid.identify(labelled, model).withColumnRenamed("doc_id", "_d"), F.col("doc_id").eqNullSafe(F.col("_d"))).collect()}
    test = [r for i, r in rows.items() if i is not None and i < 300 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 40 and np.mean([r.lang == r.lang_pred for r in test]) > 0.95
    for i in (500, 501, 502, 504):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    mixed = rows[503]
    assert mixed.lang_pred == "zz" and abs(mixed.score - 0.7) < 0.05 and [x[:4] for x in mixed.languages.split()] == ["zz:0", "xx:0"]
    assert rows[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_stage_keeps_columns(labelled):
    model = langid.fit(labelled)
    kept = langid.keep_identified(labelled.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "lang", "score"]
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {500, 501, 502, 504} and 503 in ids and len(ids) == 302


def test_grams_stay_inside_texts():
    import pyarrow as pa

    from weftlens.llm.scan import texts

    column = ["ab", "", "B a", "é"]
    whole = next(texts(pa.array(column)))
    bucket, starts, first = langid._grams(whole)
    one_by_one = [langid._grams(next(texts(pa.array([x]))))[0].tolist() for x in column]
    assert bucket.tolist() == sum(one_by_one, []) and np.diff(first).tolist() == [1, 0, 2, 1] and len(starts) == 4


def plain(text, model):
    """The same inference a word and a language at a time: main language, its share among the selected ones, and these."""
    fold = "".join(chr(langid._FOLD[b]) for b in text.encode())
    words = [[model.logp[(((ord(f" {w} "[k - 1]) << 16 | ord(f" {w} "[k]) << 8 | ord(f" {w} "[k + 1])) * 2654435761) % 2**32) >> 16] for k in range(1, len(w) + 1)] for w in fold.split()]
    logs = np.array([np.sum(np.array(w, dtype=np.float64), 0) for w in words])
    like = np.exp(logs - logs.max(1, keepdims=True))

    def em(active):
        share = np.array([1.0 if k in active else 0.0 for k in range(len(model.languages))]) / len(active)
        for round_ in range(4000):
            part = like * share
            part /= part.sum(1, keepdims=True)
            new = part.mean(0)
            done = round_ % 4 == 3 and np.abs(new - share).max() <= langid.STILL
            share = new
            if done:
                break
        return share, np.log((like * share).sum(1)).sum()

    every, _ = em(range(len(model.languages)))
    active = [int(logs.sum(0).argmax())]
    share, reached = em(active)
    for _ in range(len(model.languages) - 1):
        trial = [*active, max((k for k in range(len(model.languages)) if k not in active), key=lambda k: every[k])]
        got, gain = em(trial)
        if gain - reached <= np.log(len(words)) / 2 + 2:
            break
        active, share, reached = trial, got, gain
    return active, share


def test_mixture_equals_a_plain_one():
    import pyarrow as pa

    from weftlens.llm.scan import texts

    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.full(6, 0.3), langid.BUCKETS) + 1e-4).astype(np.float32)
    model = langid.Model([f"l{k}" for k in range(6)], logp, np.log(np.full(6, 1 / 6)))
    words = ["".join(rng.choice(list("abcdefg")) for _ in range(rng.integers(1, 5))) for _ in range(300)]
    column = [" ".join(rng.choice(words[k * 50 : (k % 3 + k + 1) * 50], n)) for k in (0, 1, 2, 4) for n in (1, 3, 20, 150)]
    _, _, shares = langid.infer(next(texts(pa.array(column))), model)
    several = 0
    for text, got in zip(column, shares):
        active, share = plain(text, model)
        assert np.allclose(got, share, atol=1e-6), text
        several += len(active) > 1
    assert several > 3


def test_five_languages_in_a_text():
    """No number of languages is the most that a text may have."""
    import pyarrow as pa

    from weftlens.llm.scan import texts

    logp = np.full((langid.BUCKETS, 5), np.log(1e-6), np.float32)
    parts = ["aaa", "bbb", "ccc", "ddd", "eee"]
    for k, p in enumerate(parts):
        bucket, _, _ = langid._grams(next(texts(pa.array([p]))))
        logp[bucket, k] = np.log(0.3)
    model = langid.Model([p[0] for p in parts], logp, np.log(np.full(5, 0.2)))
    _, _, shares = langid.infer(next(texts(pa.array([" ".join(parts * 30)]))), model)
    assert np.allclose(shares[0], 0.2, atol=0.01)


def test_nothing_to_learn(spark, no_docs):
    model = langid.fit(no_docs)
    assert langid.identify(no_docs, model).count() == 0
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert langid.identify(one, model).first()[1:3] == ("und", 0.0)

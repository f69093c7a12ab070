"""Language identification by mixture inference over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import in_small_batches
from .scan import Texts, texts

BUCKETS = 1 << 16
#: Labelled rows of a language that the model is fitted on, at most (chosen by a hash of doc_id).
ROWS_A_LANGUAGE = 20_000
#: Expectation-maximisation of a text ends when no language's share moves by more than this in a round.
STILL = 0.001
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


class Model(NamedTuple):
    languages: list[str]
    logp: np.ndarray  # BUCKETS x languages
    prior: np.ndarray


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4 == 2


def _grams(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the byte trigram around every letter byte, where each run of letters begins among them, and each text's first run."""
    data = np.full(len(t.data) + 2 * t.n + 2, 0x20, np.uint8)
    at = np.arange(len(t.data)) + 2 * np.repeat(np.arange(t.n), np.diff(t.offsets)) + 1
    data[at] = _FOLD[t.data]
    letter = data != 0x20
    where = np.flatnonzero(letter)
    code = (data[where - 1].astype(np.uint32) << 16) | (data[where].astype(np.uint32) << 8) | data[where + 1]
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    starts = np.flatnonzero(~letter[where - 1])
    edges = np.append(t.offsets[:-1] + 2 * np.arange(t.n), len(data))
    return bucket, starts, np.searchsorted(where[starts], edges)


def fit(labelled: DataFrame, rows_a_language: int = ROWS_A_LANGUAGE) -> Model:
    """Trigram probabilities of each language from (doc_id, text, lang); at most about rows_a_language rows of each."""
    rows = in_small_batches(labelled).select("doc_id", "text", "lang").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    most = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1 << 20, -(-rows_a_language * (1 << 20) // counts[k])))])
    sample = rows.where(draw < most[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(BUCKETS, np.int64) for k in languages}
        for batch in batches:
            for k in batch.column(0).unique().to_pylist():
                mine = batch.filter(pa.array([x == k for x in batch.column(0).to_pylist()]))
                for t in texts(mine.column(1)):
                    sums[k] += np.bincount(_grams(t)[0], minlength=BUCKETS)
        found = [k for k in languages if sums[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([sums[k].tobytes() for k in found], pa.binary())], ["lang", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in part["counts"])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "counts": [total.tobytes()]})

    schema = "lang string, counts binary"
    sums = {r.lang: np.frombuffer(r.counts, np.int64) for r in sample.mapInArrow(count, schema).groupBy("lang").applyInPandas(add, schema).collect()}
    smooth = 0.1
    table = np.stack([sums.get(k, np.zeros(BUCKETS, np.int64)) + smooth for k in languages], 1)
    prior = np.array([counts[k] for k in languages], float)
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32), np.log(prior / prior.sum()))


def _em(like: np.ndarray, begin: np.ndarray, owner: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the active languages of each text, and its log likelihood, from relative likelihoods of its words."""
    share = active / active.sum(1, keepdims=True)
    left, some, at, edge = np.arange(len(begin)), like, owner, begin
    n = np.diff(np.append(begin, len(like)))[:, None]
    while len(left):
        for _ in range(4):
            before = share[left]
            part = some * before[at]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            share[left] = np.add.reduceat(part, edge) / n[left]
        moved = np.abs(share[left] - before).max(1) > STILL
        keep = moved[at]
        left, some = left[moved], some[keep]
        at = np.repeat(np.arange(len(left)), n[left, 0])
        edge = np.cumsum(n[left, 0]) - n[left, 0]
    return share, np.add.reduceat(np.log(np.maximum((like * share[owner]).sum(1), 1e-300)), begin)


def infer(t: Texts, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: number of its main language (-1: no letter), score, and the proportions of its languages.

    Words are draws from a mixture of languages; a word's likelihood in a language is the product
    over its trigrams.  The set of languages grows from the best single one by the language with the largest
    share in the mixture of all, as long as log likelihood rises by more than log(words) / 2 + 2.
    """
    best = np.full(t.n, -1)
    score, shares = np.zeros(t.n), np.zeros((t.n, len(model.languages)))
    bucket, starts, first = _grams(t)
    some = np.flatnonzero(first[1:] > first[:-1])
    if not len(some) or not model.languages:
        return best, score, shares
    logs = np.stack([np.add.reduceat(model.logp[:, k][bucket], starts) for k in range(len(model.languages))], 1).astype(np.float64)
    begin = first[some]
    count = first[some + 1] - begin
    owner = np.repeat(np.arange(len(some)), count)
    single = np.add.reduceat(logs, begin)
    top = logs.max(1, keepdims=True)
    like = np.exp(logs - top)
    base = np.add.reduceat(top[:, 0], begin)
    every, _ = _em(like, begin, owner, np.ones_like(single))
    chosen = single.argmax(1)
    active = np.zeros_like(single)
    active[np.arange(len(some)), chosen] = 1
    share, reached = active.copy(), single.max(1) - base
    going = np.arange(len(some))
    for _ in range(len(model.languages) - 1):
        ahead = np.where(active[going] > 0, -1, every[going])
        trial = active[going]
        trial[np.arange(len(going)), ahead.argmax(1)] = 1
        mine = np.isin(owner, going)
        place = np.searchsorted(going, owner[mine])
        edge = np.searchsorted(place, np.arange(len(going)))
        got, gain = _em(like[mine], edge, place, trial)
        better = gain - reached[going] > np.log(count[going]) / 2 + 2
        keep = going[better]
        active[keep], share[keep], reached[keep] = trial[better], got[better], gain[better]
        going = keep
        if not len(going):
            break
    odds = single + model.prior
    odds = np.exp(odds - odds.max(1, keepdims=True))
    odds /= odds.sum(1, keepdims=True)
    alone = active.sum(1) == 1
    best[some] = np.where(alone, odds.argmax(1), share.argmax(1))
    score[some] = np.where(alone, odds.max(1), share.max(1))
    shares[some] = share
    return best, np.clip(np.round(score, 6), 0, 1), shares


def _lettered(t: Texts, k: int) -> bool:
    return any(c.isalpha() for c in t.data[t.offsets[k] : t.offsets[k + 1]].tobytes().decode("utf-8", "replace"))


def _predictions(column: pa.Array, model: Model) -> Iterator[tuple[str, float, str]]:
    """(language, score, languages with their shares) of each text."""
    for t in texts(column, max(1 << 16, (4 << 20) // max(1, len(model.languages)))):
        best, score, shares = infer(t, model)
        plain = np.zeros(len(t.data) + 1, np.int64)
        np.cumsum((_FOLD[t.data] != 0x20) & (t.data < 128), out=plain[1:])
        ascii_letters = plain[t.offsets[1:]] > plain[t.offsets[:-1]]
        for k in range(t.n):
            if best[k] < 0 or not (ascii_letters[k] or _lettered(t, k)):
                yield UNKNOWN, 0.0, ""
            else:
                held = sorted(((-round(float(s), 3), model.languages[j]) for j, s in enumerate(shares[k]) if s > 0))
                yield model.languages[best[k]], float(score[k]), " ".join(f"{name}:{-s:.3f}" for s, name in held)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for every row of docs (doc_id, text), from the whole text alone.

    lang_pred is the language with the largest share; score is that share if several languages were
    selected, else the probability of the language against the other single ones.  `languages` lists the
    selected set with shares.  A null text, one without a letter, or a model without languages: `und`, 0.  Repeated rows each
    give a row; other columns are left out, whatever their names.  No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_predictions(batch.column(1), shared.value))
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.string())],
                ["doc_id", "lang_pred", "score", "languages"],
            )

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is known with a score of `least` or more, all columns as they are; repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([name != UNKNOWN and score >= least for name, score, _ in _predictions(batch.column(at), shared.value)], pa.bool_()))

    return in_small_batches(docs).mapInArrow(run, docs.schema)

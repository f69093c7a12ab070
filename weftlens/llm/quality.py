"""Quality rules combined by weak supervision."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import written
from .scan import Texts, texts, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[[ord(c) for c in ".!?\"')"]] = True
_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE < 58)
_LETTER = ((_BYTE >= 65) & (_BYTE < 91)) | ((_BYTE >= 97) & (_BYTE < 123)) | (_BYTE >= 128)
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_closed_lines", "n_letter_words", "n_digit_chars", "n_distinct_words")


def _within(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def _owned(count: int, owner: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, minlength=count).astype(np.int64)


def _repeated(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once in their text, and which occurred in it before."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    many = again.copy()
    many[:-1] |= again[1:]
    out, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    out[order], later[order] = many, again  # the sort is stable: of equal keys the first stays first
    return out, later


def measure(t: Texts) -> np.ndarray:
    """COUNTS of each text, a row a text."""
    data, n = t.data, t.n
    starts, ends, first = t.words()
    owner = np.repeat(np.arange(n), np.diff(first))
    sums = t.prefix_hash(data)
    words = t.span_hash(sums, starts, ends)
    runs, begin = windows(words, first, WINDOW)
    run_owner = np.repeat(np.arange(n), np.diff(begin))
    many, _ = _repeated(runs, run_owner)
    cover = np.zeros(len(words) + WINDOW + 1, np.int64)
    at = (np.arange(len(runs)) - begin[run_owner] + first[run_owner])[many]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    repeat = (np.cumsum(cover)[: len(words)] > 0).astype(np.int64)

    filled = t.offsets[:-1] < t.offsets[1:]
    cuts = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate([t.offsets[:-1][filled], (cuts + 1)[~np.isin(cuts + 1, t.offsets[1:])]]))
    line_owner = np.searchsorted(t.offsets, line_starts, "right") - 1
    line_ends = np.append(line_starts[1:] - 1, len(data))
    last = np.append(line_owner[1:] != line_owner[:-1], True)[: len(line_starts)]
    tail = t.offsets[line_owner + 1]
    ends_open = np.where(data[np.maximum(tail - 1, 0)] == 10, tail - 1, tail) if len(data) else tail
    line_ends = np.where(last, np.maximum(ends_open, line_starts), line_ends)
    word_at = np.searchsorted(starts, line_starts)
    word_to = np.searchsorted(starts, line_ends)
    held = word_to > word_at
    ls, le, lo = line_starts[held], line_ends[held], line_owner[held]
    _, later = _repeated(t.span_hash(sums, ls, le), lo)
    last_byte = data[ends[word_to[held] - 1] - 1] if held.any() else np.zeros(0, np.uint8)
    _, seen = _repeated(words, owner)
    chars = _within((data & 0xC0) != 0x80, starts, ends)
    letters = _within(_LETTER[data], starts, ends)
    digits = _within(_DIGIT[data], starts, ends)
    columns = [
        np.diff(first), _owned(n, owner, chars), _within(_SYMBOL[data], t.offsets[:-1], t.offsets[1:]), _owned(n, lo[later]), _owned(n, owner, repeat),
        _owned(n, lo), _owned(n, lo[_CLOSES[last_byte]]), _owned(n, owner[letters > 0]), _owned(n, owner, digits), _owned(n, owner[~seen]),
    ]
    return np.stack(columns, 1)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(t) for t in texts(batch.column(1))]
            rows = np.concatenate(parts) if parts else np.zeros((0, len(COUNTS)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], ["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")


class Rule(NamedTuple):
    """Votes 1 where `good` holds, else -1 where `bad` holds, else abstains (0)."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.good), 1).when(F.expr(self.bad), -1).otherwise(0)


RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "20 * n_symbols < n_words", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines > 1 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_runs", "n_words >= 20 and 100 * n_repeat_words <= n_words", "100 * n_repeat_words > 15 * n_words"),
    Rule("closed_lines", "10 * n_closed_lines >= 7 * n_lines and n_lines > 0", "10 * n_closed_lines <= 2 * n_lines"),
    Rule("letters", "10 * n_letter_words >= 9 * n_words and n_words > 0", "10 * n_letter_words < 7 * n_words"),
    Rule("digits", "50 * n_digit_chars <= word_chars and word_chars > 0", "10 * n_digit_chars > word_chars"),
    Rule("variety", "n_words >= 20 and 4 * n_distinct_words >= n_words", "n_words >= 50 and 10 * n_distinct_words < n_words"),
)


class Accuracies(NamedTuple):
    """The share of good documents, and for each rule how often its votes say "bad" of good and of bad documents."""

    good: float
    says_bad: list[tuple[float, float]]


#: Before any document is seen: most are good, and a rule seldom speaks against a good one.
START = Accuracies(0.8, [(0.02, 0.3)])


def estimate(votes: np.ndarray, weights: np.ndarray, tolerance: float = 1e-9) -> Accuracies:
    """Expectation-maximisation (Dawid and Skene) over vote patterns (patterns x rules, in -1, 0, 1) with their numbers of documents.

    Documents are good or bad; a rule's votes are independent given which; an abstention says nothing.  Each rule starts as
    START says, which counts as much as one document of either class, and rates stay within 0.0001 of 0 and 1.  Rounds go on
    until no rate moves by more than tolerance.  No documents: START.
    """
    rules = votes.shape[1]
    start = np.tile(np.array(START.says_bad[0]), (rules, 1)).T
    says, good = start.copy(), START.good
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    total = weights.sum()
    while total:
        logs = np.log([[good], [1 - good]]) + np.log(1 - says) @ yes.T + np.log(says) @ no.T
        p = np.exp(logs - logs.max(0))
        w = p / p.sum(0) * weights
        new = np.clip((w @ no + start) / (w @ (yes + no) + 1), 0.0001, 0.9999)
        share = float(np.clip(w[0].sum() / total, 0.0001, 0.9999))
        moved = max(abs(share - good), float(np.abs(new - says).max(initial=0)))
        says, good = new, share
        if moved <= tolerance:
            break
    return Accuracies(good, [(float(x), float(y)) for x, y in says.T])


def posterior(a: Accuracies, votes: list[Column]) -> Column:
    """Probability that a document with these votes is good."""
    odds = F.lit(math.log((1 - a.good) / a.good))
    for vote, (good, bad) in zip(votes, a.says_bad):
        odds = odds + F.when(vote > 0, math.log((1 - bad) / (1 - good))).when(vote < 0, math.log(bad / good)).otherwise(0.0)
    return 1 / (1 + F.exp(odds))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Every row of docs (doc_id, text) with its counts, base_failed, p_good and kept; other columns are left out.

    The rules vote or abstain; their accuracies are estimated from the numbers of documents with each
    pattern of votes (3 ** rules patterns at most, whatever the corpus) over all rows that base_failed doesn't decide.
    kept: not base_failed, and the posterior probability of being good is `least` or more.  Null or blank text: no words,
    base_failed.  Repeated rows count each time.  No rows: no rows.
    """
    found = written(counts(docs))
    names = [f"_v{k}" for k in range(len(rules))]
    voted = found.withColumns({name: rule.vote() for name, rule in zip(names, rules)}).withColumn("base_failed", base_failed())
    patterns = voted.where("not base_failed").groupBy(*names).count().collect()
    votes = np.array([[r[n] for n in names] for r in patterns], float).reshape(-1, len(rules))
    accuracies = estimate(votes, np.array([r["count"] for r in patterns], float))
    out = voted.withColumn("p_good", F.round(posterior(accuracies, [F.col(n) for n in names]), 6))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least)).drop(*names)

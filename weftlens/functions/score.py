"""Ratios and comparisons of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, rounded half away from zero to three digits; 0 without a whole."""
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 3))


def coverage(covered: Column, relevant: Column) -> Column:
    """covered / relevant cut, not rounded, to three digits; 0 without a whole."""
    return F.when(relevant == 0, 0.0).otherwise(F.floor(covered * 1000 / relevant) / 1000)


def number(text: Column, currency: bool = False) -> Column:
    return F.try_cast(F.regexp_replace(text, r"[^0-9.\-]", ""), "double") if currency and hasattr(F, "try_cast") else (F.regexp_replace(text, r"[^0-9.\-]", "") if currency else text).try_cast("double")


def numbers_equal(want: Column, got: Column, tolerance: float = 0.0) -> Column:
    return F.abs(want - got) <= tolerance + 1e-9 * F.greatest(F.lit(1.0), F.abs(want))


def plain_text(text: Column, case: bool = True, whitespace: bool = True) -> Column:
    """Text as compared: lower case and single spaces, if asked."""
    if whitespace:
        text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.lower(text) if case else text


DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")
YES, NO = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def date(text: Column) -> Column:
    """The day a text names in one of the usual forms, or null."""
    day = F.regexp_replace(F.trim(text), r"T.*$", "")
    return F.coalesce(*[F.try_to_date(day, f) for f in DATE_FORMATS])


def truth(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*YES), True).when(word.isin(*NO), False)


def fields_pass(matches: Column, extra: Column, allow_extra: Column) -> Column:
    """Whether an answer passes: all required fields match, and others only if they are allowed."""
    return F.forall(matches, lambda m: m) & (allow_extra | (F.size(extra) == 0))


def first_fit(want: Column, got: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Whether two arrays hold the same items in any order, if each wanted item, in turn, takes the first one left that `same` accepts.

    `same` need not be transitive (numbers within a tolerance aren't), so what an item takes matters to those after it.  A null item is the same
    as a null only.  A null array is the same as nothing.
    """
    def accepts(w: Column, g: Column) -> Column:
        return F.coalesce(same(w, g), F.lit(False)) | (w.isNull() & g.isNull())

    def take(state: Column, w: Column) -> Column:
        k = F.array_position(F.transform(state["left"], lambda g: accepts(w, g)), True)
        return F.struct(F.filter(state["left"], lambda _, i: i + 1 != k).alias("left"), (state["fits"] & (k > 0)).alias("fits"))

    begin = F.struct(F.filter(got, lambda g: F.lit(True)).alias("left"), F.lit(True).alias("fits"))
    return F.coalesce((F.size(want) == F.size(got)) & F.aggregate(want, begin, take, lambda s: s["fits"]), F.lit(False))


def in_order(want: Column, got: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Whether two arrays hold the same items in the same order, by `same`."""
    pairs = F.zip_with(want, got, lambda w, g: F.coalesce(same(w, g), F.lit(False)) | (w.isNull() & g.isNull()))
    return F.coalesce((F.size(want) == F.size(got)) & F.forall(pairs, lambda m: m), F.lit(False))

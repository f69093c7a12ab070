"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the random key that name its range: 4096 ranges in each source, each sorted on its own.
RANGE_DIGITS = 3


def words_in(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, weigh `weights` in turn and share `share` times all sizes.
    A target stops at `most` times its source's size and the excess goes to the others by weight, until
    none is above.  That is the level L with sum(min(most * size, L * weight)) = the whole: with the
    sources sorted by size / weight, L follows from running sums.  One row a source goes through here,
    never the documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    rows = sources.withColumn("_n", F.row_number().over(order) - 1).withColumn(
        "_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    )
    by_need = Window.orderBy(F.col("source_size") / F.col("_w"), "_n")
    rows = rows.select(
        "source",
        "source_size",
        "_w",
        F.row_number().over(by_need).alias("_k"),
        F.sum(F.col("source_size") * most).over(by_need.rowsBetween(Window.unboundedPreceding, -1)).alias("_capped"),
        F.sum("_w").over(by_need.rowsBetween(0, Window.unboundedFollowing)).alias("_open"),
        (F.sum("source_size").over(Window.partitionBy()) * share).alias("_whole"),
    )
    level = (F.col("_whole") - F.coalesce("_capped", F.lit(0.0))) / F.col("_open")
    rows = rows.withColumn("_level", level).withColumn("_free", F.col("source_size") * most >= F.col("_level") * F.col("_w"))
    first = F.min(F.when(F.col("_free"), F.struct("_k", "_level"))).over(Window.partitionBy())["_level"]
    rows = rows.withColumn("_cut", first)
    cap = F.col("source_size").cast("double") * most
    return rows.select(
        "source", "source_size", F.when(F.col("_cut").isNull(), cap).otherwise(F.least(cap, F.col("_cut") * F.col("_w"))).alias("target")
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Every row of docs (doc_id, text, source, ...) with what the mix takes of it.

    Each row gets a hash-random key.  Rows are sorted by key within ranges of the key in each source;
    running sums of sizes inside a range, added to the sums of the ranges before it, give each row's
    place in its source.  A source is repeated whole as often as its budget allows; the last epoch is
    cut at the exact word, so the row at the cut is taken in part.

    Result: row (a struct of all columns of docs), doc_id, size, source_size, target, taken, epochs (whole times
    taken), part (words of the last, partial copy: 0 to size).  The same rows give the same result.
    Null text: size 0, never taken.  Null source: a source of its own.  Repeated rows are rows of their
    own.  An empty table gives no rows.  Columns of docs with the names of results stay apart, inside row.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id")).cast("binary"))
    place = F.substring(key, 1, RANGE_DIGITS)
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", words_in(F.col("text")).alias("size"), key.alias("_key"), place.alias("_range"))
    ranges = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    before = F.sum("_sum").over(Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("source", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    starts = (
        starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.source", "_range", "_before", "source_size", "target")
    )
    inside = Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("r").join(
        starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._range") == F.col("s._range"))
    )
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least("size", budget - whole * F.col("source_size") - F.col("_before") - F.col("_inside")))
    return rows.select(
        "row", "doc_id", "size", "source_size", "target",
        (whole * F.col("size") + part).cast("long").alias("taken"), whole.alias("epochs"), part.cast("long").alias("part"),
    )


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself from mix()'s rows: one row for each copy taken, with the columns that docs had.

    A partial copy holds its first words, single-spaced; n_chars, where docs had it, is its length then.
    """
    names = mixed.schema["row"].dataType.names
    whole = F.when(F.col("part") == F.col("size"), F.col("epochs") + 1).otherwise(F.col("epochs"))
    whole = F.when(F.col("size") == 0, 0).otherwise(whole)
    full = mixed.withColumn("_n", whole).where("_n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(WORD), F.lit(0)), 1, F.col("part").cast("int")), " ")
    some = mixed.where("part > 0 and part < size").withColumn("row", F.col("row").withField("text", cut))
    if "n_chars" in names:
        some = some.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(mixed.schema["row"].dataType["n_chars"].dataType)))
    return full.select("row").union(some.select("row")).select(*[F.col("row").getField(n).alias(n) for n in names])

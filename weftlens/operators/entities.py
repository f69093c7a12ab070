"""Entities of an interface from the structure of its responses: what lists hold, what keys stand for, their fields and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shape import SCALAR_TYPES
from ..functions.text import clean_name, last_name, singular
from ..lineage import beside, written
from .decisions import ranked_names
from .semantics import nesting

#: A list's objects are an entity if they have so many scalar fields.
LEAST_FIELDS = 3


#: Sources of a field that are listed, in order; all are counted.
MOST_SOURCES = 20


def merged_fields(fields: DataFrame, key: list[str], most: int = MOST_SOURCES) -> DataFrame:
    """Scalar fields by key from rows (*key, field, type, count, source): type (any if several, null if there is none), nulls, observations, the first sources, n_sources.

    A source's rows are one before fields are looked at, and written once; types are bits, so counting needs no sort.
    """
    rows, null = fields.where(F.col("type").isin(*SCALAR_TYPES)), SCALAR_TYPES.index("null")
    bit = F.coalesce(*(F.when(F.col("type") == t, 1 << i) for i, t in enumerate(SCALAR_TYPES)))
    counts = F.sum(F.when(F.col("type") == "null", F.col("count")).otherwise(0)).alias("nulls"), F.sum("count").alias("observations")
    each = written(rows.groupBy(*key, "field", "source").agg(F.bit_or(bit).alias("_t"), *counts))
    types = F.bit_or("_t").bitwiseAND(~(1 << null))
    one = F.coalesce(*(F.when(types == 1 << i, t) for i, t in enumerate(SCALAR_TYPES)), F.lit("any"))
    out = each.groupBy(*key, "field").agg(
        F.when(types == 0, "null").otherwise(one).alias("type"), F.sum("nulls").alias("nulls"), F.sum("observations").alias("observations"), F.count("source").alias("n_sources")
    )
    first = Window.partitionBy(*key, "field").orderBy("source")
    top = each.select(*key, "field", "source").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= most)
    return out.join(top.groupBy(*key, "field").agg(F.array_sort(F.collect_list("source")).alias("sources")), [*key, "field"])


def item_fields(structure: DataFrame, variants: DataFrame, least: int = LEAST_FIELDS) -> DataFrame:
    """(host, container, field, type, nulls, observations, n_sources, sources) of the entities in lists, whatever route returned them.

    structure: shape.containers by variant; variants: (ref, host, count) of those to be looked at.  The arrays of objects at one
    path of a host are one entity; a variant's array counts if its objects have at least `least` scalar fields there.  Structure is read once,
    and dealt once by ref, for its fields and for its variants, which meet by sorting.
    """
    fields = Window.partitionBy("ref", "container")
    items = structure.where("item").select("ref", "container", "field", "type", F.col("type").isin(*SCALAR_TYPES).alias("_s")).repartition("ref")
    rows = items.withColumn("_n", F.count_if("_s").over(fields)).where(F.col("_n") >= least).join(variants.select("ref", "host", "count").hint("merge"), "ref")
    source = F.concat("ref", F.lit("#response."), "container", F.lit("."), "field").alias("source")
    return merged_fields(rows.select("host", "container", "field", "type", "count", source), ["host", "container"])


def item_entities(fields: DataFrame) -> DataFrame:
    """(host, container, parent, names) of item_fields: the list that a list stands in, and names by rank from the last two keys of its place."""
    places = fields.select("host", "container").distinct()
    parents = nesting(places.withColumnRenamed("container", "path")).withColumnRenamed("path", "container")
    parts = F.split(F.regexp_replace("container", r"\[\]\z", ""), r"\.")
    own = F.struct(clean_name(singular(F.element_at(parts, -1))).alias("name"), F.lit(2).alias("_v"))
    above = F.when(F.size(parts) > 2, F.struct(clean_name(singular(F.regexp_replace(F.get(parts, F.size(parts) - 2), r"\[\]\z", ""))).alias("name"), F.lit(1).alias("_v")))
    votes = places.select("host", "container", F.inline(F.array_compact(F.array(own, above)))).where("name is not null")
    return parents.join(_names(votes.select("host", "container", "name", F.explode(F.array_repeat(F.lit(1), F.col("_v"))))), ["host", "container"], "left")


def _names(votes: DataFrame) -> DataFrame:
    """(host, container, names) from votes (host, container, name), the most voted first."""
    ranked = ranked_names(votes.select(F.struct("host", "container").alias("subject"), "name"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"])
    return ranked.groupBy("subject").agg(listed.alias("names")).select("subject.*", "names")


def keyed_fields(producers: DataFrame, structure: DataFrame, variants: DataFrame) -> DataFrame:
    """(entity, field, type, nulls, observations, n_sources, sources) of entities that keys stand for.

    producers: (entity, family, path) of fields that return a key, as body.orders[].customer: the object that holds it is the entity as
    that family returns it.  variants: (ref, family, count).  Structure and variants meet by sorting: their files are far smaller than their rows,
    so by file size Spark would send either of them whole through the driver.
    """
    held = written(producers.select("entity", "family", F.regexp_replace("path", r"\.[^.]*\z", "").alias("container")).distinct())
    wanted = structure.select("ref", "container", "field", "type").join(beside(held.select("container")), "container", "left_semi")
    rows = wanted.join(variants.select("ref", "family", "count").hint("merge"), "ref").join(beside(held), ["family", "container"])
    source = F.concat("family", F.lit("/"), "ref", F.lit("#"), "container", F.lit("."), "field").alias("source")
    return merged_fields(rows.select("entity", "field", "type", "count", source), ["entity"])


def key_name_votes(consumers: DataFrame, producers: DataFrame) -> DataFrame:
    """(subject, name) for each slot that names what a key stands for, for ranked_names.

    consumers: (entity, part, pattern, before) of request slots, before being the path segment in front of a path slot; producers: (entity, path)
    of response fields.  A query or body key names the entity, and so does the literal in front of a path slot.
    """
    name: Column = F.when(F.col("part") == "path", singular(F.col("before"))).otherwise(last_name(F.col("pattern")))
    asked = consumers.select(F.col("entity").alias("subject"), clean_name(name).alias("name"))
    given = producers.where(F.startswith("path", F.lit("body."))).select("entity", clean_name(last_name(F.col("path"))))
    return asked.union(given).where("name is not null")

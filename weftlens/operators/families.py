"""Path templates and request families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import url
from ..functions.ids import hash_id, hash_samples
from ..lineage import written

#: So many different siblings of a class make it a slot.
SIBLINGS = 3


def route_templates(paths: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """(method, host, segments, template, slots) of every different path.

    Level by level: among paths with the same template so far, segments of one class become a slot if
    there are at least `siblings` different ones; else the segment stays as it is.  One aggregate and join a
    level, on different paths only; each level is written, so plans don't grow with depth.
    """
    rows = written(paths.select("method", "host", "segments").distinct())
    depth = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    rows = rows.withColumn("_made", F.lit("")).withColumn("_slots", F.array().cast("array<int>"))
    for d in range(depth):
        here = F.get("segments", F.lit(d))
        rows = rows.withColumn("_seg", here).withColumn("_class", url.segment_class(here))
        key = ["method", "host", "_made", "_class"]
        level = rows.where("_seg is not null").groupBy(*key).agg((F.count_distinct("_seg") >= siblings).alias("_many"))
        rows = rows.join(level, key, "left")
        slot = F.coalesce(F.col("_many"), F.lit(False)) & url.slottable(F.col("_class"))
        step = F.concat("_made", F.lit("/"), F.when(slot, F.concat(F.lit("{"), "_class", F.lit("}"))).otherwise(F.col("_seg")))
        rows = rows.select(
            "method", "host", "segments",
            F.when(F.col("_seg").isNull(), F.col("_made")).otherwise(step).alias("_made"),
            F.when(slot, F.array_append("_slots", F.lit(d))).otherwise(F.col("_slots")).alias("_slots"),
        )
        rows = written(rows)
    made = F.when(F.col("_made") == "", "/").otherwise(F.col("_made"))
    return rows.select("method", "host", "segments", made.alias("template"), F.col("_slots").alias("slots"))


def display(template: Column) -> Column:
    """The template with its slots numbered from the left."""
    parts = F.split(template, r"\{[^}]*\}", -1)
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: F.concat(F.lit("{slot_"), (i + 1).cast("string"), F.lit("}"), p))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def route_label(method: Column, host: Column, shown: Column, names: Column) -> Column:
    """A family as a person reads it: method, host, template, and the names in its query."""
    return F.concat(method, F.lit(" "), host, shown, F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))


def with_family(observations: DataFrame, siblings: int = SIBLINGS) -> DataFrame:
    """Observations (method, host, segments, query_shape, body_kind, body_shape, ...) with template and family id."""
    routes = route_templates(observations, siblings)
    identity = F.concat_ws(" ", "method", "host", "template", F.concat(F.lit("?"), "query_shape"), F.concat(F.lit("body:"), "body_kind", F.lit(":"), "body_shape"))
    joined = observations.join(routes.drop("slots"), ["method", "host", "segments"])
    return joined.withColumn("family", hash_id("family", identity))


def families(observed: DataFrame) -> DataFrame:
    """One row a family, from observations with family, template, static: counts, and whether all its responses are static."""
    return observed.groupBy("family", "method", "host", "template").agg(
        F.count("*").alias("observations"), F.count_distinct("session").alias("sessions"), F.bool_and("static").alias("static")
    ).withColumn("shown", display(F.col("template")))


def merged_type(types: Column) -> Column:
    """Type of values from the set of their types: the one; number for integer and number; else any."""
    numbers = F.size(F.array_except(types, F.array(F.lit("integer"), F.lit("number")))) == 0
    return F.when(F.size(types) == 1, types[0]).when(numbers, "number").otherwise("any")


def slot_stats(values: DataFrame, most: int = 5) -> DataFrame:
    """Per (family, location) of values (family, location, value, type, ref): observations, cardinality, type, examples."""
    key = ["family", "location"]
    stats = values.groupBy(*key).agg(
        F.count_distinct("ref").alias("observations"),
        F.count_distinct("value").alias("cardinality"),
        merged_type(F.array_sort(F.collect_set("type"))).alias("type"),
    )
    return stats.join(hash_samples(values, key, "value", most), key)


def response_variants(observed: DataFrame, most: int = 3, kind: str = "body_kind", shape: str = "body_shape") -> DataFrame:
    """Per family and (status, media, body), with transport errors as one: count, first examples, and rank by count.

    kind and shape are the columns of the response's body.
    """
    key = F.when(F.col("error") != "", "error").otherwise(F.concat_ws(" ", F.col("status").cast("string"), "media", F.concat(F.col(kind), F.lit(":"), shape)))
    rows = observed.withColumn("variant", hash_id("variant", key))
    counts = rows.groupBy("family", "variant").agg(F.min("status").alias("status"), F.min("media").alias("media"), F.count("*").alias("count"))
    first = Window.partitionBy("family", "variant").orderBy("session", "seq")
    top = rows.select("family", "variant", "session", "seq", "ref").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    refs = F.transform(F.array_sort(F.collect_list(F.struct("_n", "ref"))), lambda x: x["ref"])
    out = counts.join(top.groupBy("family", "variant").agg(refs.alias("examples")), ["family", "variant"])
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("family").orderBy(F.desc("count"), "variant")))


def request_bodies(observed: DataFrame) -> DataFrame:
    """(family, body_kind, body_shape, size_class) of families of observations (family, session, seq, body_kind, body_shape, size_class).

    Members agree on kind and shape; the size class of an opaque body is left empty where it varies.
    """
    first = F.min(F.struct("session", "seq", "body_kind", "body_shape", "size_class")).alias("_f")
    rows = observed.groupBy("family").agg(first, F.count_distinct("size_class").alias("_n"))
    return rows.select("family", "_f.body_kind", "_f.body_shape", F.when(F.col("_n") == 1, F.col("_f.size_class")).otherwise("").alias("size_class"))


def host_counts(paths: DataFrame, hosts: list[str]) -> DataFrame:
    """How many exchanges belong to the given hosts or below them, and how many are left out."""
    own = url.own_host(F.col("host"), hosts)
    return paths.agg(F.count_if(own).alias("kept"), F.count_if(~own).alias("skipped"), F.count("*").alias("exchanges"))

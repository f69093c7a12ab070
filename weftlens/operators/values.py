"""Values shared between request families."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ids import hash_id
from ..lineage import beside, components, written

#: A value of more families than this is everywhere and links nothing.
UBIQUITOUS = 10


def value_links(values: DataFrame, ubiquitous: int = UBIQUITOUS) -> DataFrame:
    """Values of at least two families, from (value, type, family, side, part, pattern, ref).

    An aggregate by value, not a self-join: what is linked is listed, pairs are not made.  Equal sightings are counted first, so patterns are matched
    once for each value, and lists take a family once.
    """
    per = values.where("value <> ''").groupBy("value", "family", "type").agg(F.count("*").alias("_n"))
    seen = per.groupBy("value").agg(
        F.sum("_n").alias("count"),
        F.array_sort(F.collect_set("family")).alias("families"),
        F.array_join(F.array_sort(F.collect_set("type")), "|").alias("types"),
        F.bool_or(text.low_information(F.col("type"), F.col("value"))).alias("low_information"),
    )
    linked = seen.where(F.size("families") >= 2)
    return linked.select(
        hash_id("link", F.col("value")).alias("link"), "value", "types", "count", F.size("families").alias("n_families"), "families", "low_information",
        (F.size("families") > ubiquitous).alias("ubiquitous"),
    )


#: A place of a value with more rows than about this many is dealt over PARTS tasks before its refs meet; one in SEEN rows tells which (fixed values).
CROWDED, SEEN, PARTS = 1024, 64, 64


def occurrences(values: DataFrame, most: int = 3) -> DataFrame:
    """Per value, family and location: how often, and the first refs.  A location that a ref has twice is counted twice.

    All rows go once through one exchange and one sort, with a number for their location.  A place of a value with very many rows, which one task would
    have to sort, is cut to its first refs in parts by ref, which then meet.  Either way gives the same rows: which places are crowded decides the cost only.
    """
    at, key = ["family", "side", "part", "pattern"], ["value", "_at"]
    numbered = beside(written(values.select(*at).distinct().withColumn("_at", F.monotonically_increasing_id())))
    names = beside(numbered.select(*(F.col(c).alias(f"_{c}") for c in at), "_at"))
    rows = values.where("value <> ''").join(names, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in at]).select(*key, "ref")
    seen = rows.where(F.rand(0) * SEEN < 1).groupBy(*key).agg(F.count("*").alias("_n"))
    crowded = beside(written(seen.where(F.col("_n") * SEEN >= CROWDED).select(*key, F.lit(True).alias("_many"))))

    rows = rows.join(crowded, key, "left").select(*key, "ref", F.when(F.col("_many"), F.pmod(F.xxhash64("ref"), F.lit(PARTS))).alias("_part"))
    every = Window.partitionBy(*key, "_part")
    parts = rows.withColumns({"_r": F.dense_rank().over(every.orderBy("ref")), "_i": F.row_number().over(every.orderBy("ref"))})
    parts = parts.withColumns({"count": F.count("*").over(every), "_e": F.collect_set(F.when(F.col("_r") <= most, F.struct("ref"))).over(every)})
    parts = written(parts.where("_i = 1").select(*key, "_part", "count", "_e"))

    many = parts.where("_part is not null").groupBy(*key).agg(F.sum("count").alias("count"), F.flatten(F.collect_list("_e")).alias("_e"))
    both = parts.where("_part is null").select(*key, "count", "_e").union(many)
    first = F.slice(F.array_sort("_e"), 1, most)
    return both.join(numbered, "_at").select("value", *at, "count", F.transform(F.filter(first, lambda x: x["ref"].isNotNull()), lambda x: x["ref"]).alias("examples"))


#: Media types of bodies that are text though not structured, and the largest that are scanned (fixed values).
SCANNED_MEDIA = (
    "text/html", "application/xhtml+xml", "text/plain", "text/xml", "application/xml", "text/javascript", "application/javascript",
    "application/x-javascript", "application/json",
)
SCANNED_BYTES = 16 << 20


def scanned_bodies(bodies: DataFrame) -> DataFrame:
    """Bodies (ref, text, kind, media, size) that are searched for values: opaque text of at most 16 MiB."""
    return bodies.where((F.col("kind") == "opaque") & F.col("media").isin(*SCANNED_MEDIA) & (F.col("size") <= SCANNED_BYTES))


def text_hits(bodies: DataFrame, values: DataFrame, least: int = 6) -> DataFrame:
    """(ref, value): tokens of text bodies (ref, text) that are request values (value) of at least `least` bytes."""
    wanted = values.where((F.octet_length("value") >= least) & F.col("value").rlike(r"^[A-Za-z0-9_-]+\z")).select("value").distinct()
    found = bodies.select("ref", F.explode(text.tokens(F.col("text"))).alias("value"))
    return found.join(wanted, "value", "left_semi").select("ref", "value")


def identity_values(values: DataFrame) -> DataFrame:
    """Values by slot that may identify something: linked, without flags, not redacted; consumer: a place of a request's path, query or body.

    values: (value, type, family, side, part, pattern).  Places that produce them are a response's body, text and redirect target;
    headers and cookies are left out.  Gives distinct (value, slot, consumer).
    """
    consumer = lambda x: (x["side"] == "request") & x["part"].isin("path", "query", "body")
    producer = lambda x: (x["side"] == "response") & x["part"].isin("body", "text", "location")
    places = F.filter("_at", lambda x: consumer(x) | producer(x))
    slots = F.array_distinct(F.transform(places, lambda x: F.struct(F.concat_ws(".", x["side"], x["family"], x["part"], x["pattern"]).alias("slot"), consumer(x).alias("consumer"))))
    families = F.size(F.array_distinct(F.array_compact(F.transform("_at", lambda x: x["family"]))))
    # one aggregate of different places tells what is linked and where, so that links don't meet the values again
    different = values.where("value <> ''").select("value", "type", "family", "side", "part", "pattern").distinct()
    seen = different.groupBy("value").agg(
        F.collect_set(F.struct("family", "side", "part", "pattern")).alias("_at"), F.bool_or(text.low_information(F.col("type"), F.col("value"))).alias("_low")
    )
    linked = seen.where(~F.col("_low") & families.between(2, UBIQUITOUS) & ~F.contains("value", F.lit("{{redacted:")))
    return linked.select("value", F.inline(slots)).select("value", "slot", "consumer")


def slot_shapes(values: DataFrame) -> DataFrame:
    """Per slot (side, family, part, pattern) of different values: byte length if they have one, characters, and whether any is id-like."""
    return values.groupBy("slot").agg(
        F.count_distinct("value").alias("values"),
        F.when(F.min(F.octet_length("value")) == F.max(F.octet_length("value")), F.min(F.octet_length("value"))).otherwise(0).alias("length"),
        F.bit_or(text.char_mask(F.col("value"))).alias("mask"),
    )


def slot_sets(values: DataFrame) -> DataFrame:
    """(value, _slots): the slots of each value, in order."""
    return values.groupBy("value").agg(F.array_sort(F.collect_set("slot")).alias("_slots"))


def set_pairs(sets: DataFrame) -> DataFrame:
    """The pairs (a < b) of slots in sets (_slots, ...), with the other columns."""
    others = [c for c in sets.columns if c != "_slots"]
    return sets.select("_slots", F.explode("_slots").alias("a"), *others).select("a", F.explode("_slots").alias("b"), *others).where("a < b")


def joinable_slots(values: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of slots (a < b) that share at least `least` values, or one id-like, and whose values have compatible shapes.

    Values of the same slots count together, so pairs are made of the sets of slots that occur, not of values.
    """
    sets = slot_sets(values).where(F.size("_slots") > 1).groupBy("_slots").agg(F.count("*").alias("_n"), F.bool_or(text.id_like(F.col("value"))).alias("_id"))
    shared = set_pairs(sets).groupBy("a", "b").agg(F.sum("_n").alias("shared"), F.bool_or("_id").alias("_id"))
    shapes = slot_shapes(values)
    left, right = (shapes.select(F.col("slot").alias(s), F.col("length").alias(f"_n{s}"), F.col("mask").alias(f"_m{s}")) for s in "ab")
    both = F.col("_ma").bitwiseAND(F.col("_mb"))
    fits = (F.col("_na") >= 6) & (F.col("_na") == F.col("_nb")) & (F.col("_ma") < 8) & (F.col("_mb") < 8) & ((both == F.col("_ma")) | (both == F.col("_mb")))
    return shared.join(left, "a").join(right, "b").where(fits & ((F.col("shared") >= least) | F.col("_id"))).select("a", "b", "shared")


def key_classes(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """(slot, key_class): connected slots, from all slots of values (slot) and pairs (a, b), named by their smallest slot."""
    labels = components(pairs.select("a", "b")).withColumnRenamed("node", "slot")
    return values.select("slot").distinct().join(labels, "slot", "left").select("slot", F.coalesce("root", "slot").alias("key_class"))


def class_stats(classes: DataFrame, values: DataFrame) -> DataFrame:
    """Per class of several slots: its consumer slots, distinct values, and slots that produce its values.

    classes: (slot, key_class) of consumers; values: (value, slot, consumer).  Values of the same slots count together: one aggregate by value
    is all that is as large as the values.
    """
    places = F.array_sort(F.collect_set(F.struct("slot", "consumer"))).alias("_s")
    sets = written(values.groupBy("value").agg(places).groupBy("_s").agg(F.count("*").alias("_n")))
    mine = written(sets.select("_s", "_n", F.inline("_s")).where("consumer").join(classes, "slot").select("key_class", "slot", "_s", "_n"))
    sized = mine.groupBy("key_class").agg(F.count_distinct("slot").alias("slots")).where("slots > 1")
    met = mine.select("key_class", "_s", "_n").distinct()
    sized = sized.join(met.groupBy("key_class").agg(F.sum("_n").alias("values")), "key_class")
    makers = met.select("key_class", F.inline("_s")).where("not consumer").groupBy("key_class").agg(F.count_distinct("slot").alias("producers"))
    return sized.join(makers, "key_class", "left").na.fill(0, ["producers"])


def held_out(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair of slots, values shared in either half of a fixed split of all values, and whether both halves agree."""
    half = F.conv(F.substring(F.sha2("value", 256), 1, 2), 16, 10).cast("int") % 2
    sets = slot_sets(values).where(F.size("_slots") > 1).groupBy("_slots").agg(F.count_if(half == 0).alias("_even"), F.count_if(half == 1).alias("_odd"))
    shared = set_pairs(sets).groupBy("a", "b").agg(F.sum("_even").alias("even"), F.sum("_odd").alias("odd")).join(pairs.select("a", "b"), ["a", "b"])
    return shared.select("a", "b", "even", "odd", ((F.col("even") > 0) & (F.col("odd") > 0)).alias("reproduced"))


def functional_relations(sightings: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, support, one_to_one): entities whose values always come with one value of another, from sightings (ref, entity, value).

    Values are paired by exchange.  a relates to b if no value of a is seen with two of b; support is the number of a's values
    in at least `least` exchanges, and there must be one.  A relation that holds both ways is listed from the smaller entity.

    An exchange with two values of b refutes all relations to b by itself, so values meet only with the one value that an entity has in their
    exchange.  An exchange is gathered into one row; each later step starts from these rows.  Before all values meet, the pairs of entities are
    dropped that one in 64 values, chosen by a hash, refute already: most relations that don't hold go there, and what is left is looked at whole.
    """
    s, entity = F.col("_s"), lambda x: x["entity"]
    rows = written(sightings.groupBy("ref").agg(F.array_sort(F.collect_set(F.struct("entity", "value"))).alias("_s")).select("_s"))
    next_to = lambda x, i: F.coalesce(F.get(s, i)["entity"] == x["entity"], F.lit(False))
    several = lambda x, i: next_to(x, i - 1) | next_to(x, i + 1)
    one = F.filter(s, lambda x, i: ~several(x, i))
    met = rows.select(F.explode(s).alias("_a"), one.alias("_one")).select(F.col("_a.entity").alias("a"), F.col("_a.value").alias("va"), F.inline("_one"))
    met = met.select("a", "va", F.col("entity").alias("b"), F.col("value").alias("vb")).where("a <> b")
    some = met.where(F.pmod(F.xxhash64("va"), F.lit(64)) == 0).distinct().groupBy("a", "b", "va").agg(F.count("vb").alias("_m")).where("_m > 1").select("a", "b")
    doubled = rows.select(F.array_distinct(F.transform(s, entity)).alias("_e"), F.array_distinct(F.transform(F.filter(s, several), entity)).alias("_b")).where(F.size("_b") > 0)
    doubled = doubled.select(F.explode("_e").alias("a"), "_b").select("a", F.explode("_b").alias("b")).where("a <> b")
    refuted = beside(written(some.union(doubled).distinct()))
    counted = met.join(refuted, ["a", "b"], "left_anti").groupBy("a", "b", "va", "vb").agg(F.count("*").alias("_n"))
    per_value = counted.groupBy("a", "b", "va").agg((F.count("vb") <= 1).alias("_one"), F.sum("_n").alias("_n"))
    kinds = written(per_value.groupBy("a", "b").agg(F.bool_and("_one").alias("_one"), F.count_if(F.col("_n") >= least).alias("support")).where("_one").drop("_one"))
    back = kinds.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("_back"))
    rows = kinds.join(back, ["a", "b"], "left").where("support > 0 and (_back is null or a < b)")
    return rows.select("a", "b", "support", F.coalesce("_back", F.lit(False)).alias("one_to_one"))

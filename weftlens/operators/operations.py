"""Operations of an interface: roles' features, inputs, outputs, prerequisites and what else could meet them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import written


def typed_text(examples: Column) -> Column:
    """Whether examples all look typed by a person: lower-case letters, with digits, spaces and hyphens at most."""
    return (F.size(examples) > 0) & F.forall(examples, lambda e: e.rlike(r"^[a-z0-9 -]*[a-z][a-z0-9 -]*\z"))


def free_text_slots(slots: DataFrame) -> DataFrame:
    """Query slots of slot_stats that look like typed input: texts of at least three different values, and half of all at least."""
    rows = slots.where(F.startswith("location", F.lit("query.")) & (F.col("type") == "string"))
    return rows.where("cardinality >= 3 and cardinality * 2 >= observations")


def listed(structure: DataFrame, levels: int = 2) -> DataFrame:
    """(ref, root, listed) of shape.containers: whether a body is an array, or an object that holds an array of objects within so many levels of objects."""
    near = (F.col("type") == "items") & (F.col("level") <= levels)
    return structure.groupBy("ref").agg(F.first("root").alias("root"), F.bool_or((F.col("root") == "array") | F.coalesce(near, F.lit(False))).alias("listed"))


def response_features(variants: DataFrame) -> DataFrame:
    """Per family of variants (family, kind, root, listed, media, size_class): lists of objects, single objects, pages, and other content.

    root and listed are those of listed(); an opaque body counts if it isn't tiny.
    """
    big = (F.col("kind") == "opaque") & ~F.col("size_class").isin("empty", "tiny")
    json, lists = F.col("kind") == "json", F.coalesce("listed", F.lit(False))
    return variants.groupBy("family").agg(
        F.bool_or(json & lists).alias("lists"), F.bool_or(json & F.coalesce(F.col("root") == "object", F.lit(False)) & ~lists).alias("objects"),
        F.bool_or(big & F.contains("media", F.lit("html"))).alias("pages"), F.bool_or(big & ~F.contains("media", F.lit("html"))).alias("other"),
    )


def operation_inputs(slots: DataFrame) -> DataFrame:
    """(operation, name, type, required, slots) of slots (operation, members, family, location, name, type, cardinality, observations, total, examples, fed, entity).

    A slot of several values is an input, and so is a path slot of a known entity; slots of one name are one.  A slot of one value joins an
    input that others show varies.  What an earlier response filled every time is state, not input, unless it is typed text; redacted slots are neither.
    """
    words = (F.col("type") == "string") & typed_text(F.col("examples"))
    hidden = (F.col("name") == "") | F.exists("examples", lambda e: F.contains(e, F.lit("{{redacted:")))
    varies = (F.col("cardinality") >= 2) | (F.startswith("location", F.lit("path.")) & F.col("entity"))
    open_ = slots.where(~hidden & ~(F.col("fed") & ~words)).withColumns({"_words": words, "_varies": varies})
    known = open_.where("_varies").select("operation", "name").distinct()
    mine = open_.join(known, ["operation", "name"])
    return mine.groupBy("operation", "name").agg(
        F.array_join(F.array_sort(F.collect_set("type")), "|").alias("type"),
        (F.bool_and(F.col("observations") >= F.col("total")) & (F.count_distinct("family") == F.max("members"))).alias("required"),
        F.bool_and("_words").alias("words"), F.sum("observations").alias("observed"), F.array_sort(F.collect_set("family")).alias("families"),
        F.array_sort(F.collect_set(F.concat_ws("#", "family", "location"))).alias("slots"),
    )


def state_slots(slots: DataFrame) -> DataFrame:
    """(operation, slot) of slots that an earlier response filled every time and that aren't typed text."""
    words = (F.col("type") == "string") & typed_text(F.col("examples"))
    return slots.where(F.col("fed") & ~words & (F.col("name") != "")).select("operation", F.concat_ws("#", "family", "location").alias("slot"))


INPUTS = "operation string, name string, type string, required boolean, slots array<string>"


def joined_inputs(inputs: DataFrame, members: DataFrame) -> DataFrame:
    """Inputs of typed text that never share a family joined, the most observed name first: the same box behind two forms of a url.

    inputs: operation_inputs; members: (operation, members).  The inputs of one operation are a group: a few names, whatever was recorded.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["observed", "name"], ascending=[False, True]).to_dict("records")
        gone: set[str] = set()
        for i, a in enumerate(rows):
            if a["name"] in gone or not a["words"]:
                continue
            for b in rows[i + 1 :]:
                if b["name"] in gone or not b["words"] or set(a["families"]) & set(b["families"]):
                    continue
                for key in ("families", "slots"):
                    a[key] = sorted({*a[key], *b[key]})
                a["type"] = "|".join(sorted({*a["type"].split("|"), *b["type"].split("|")}))
                a["always"] = a["always"] and b["always"]
                gone.add(b["name"])
        left = [r for r in rows if r["name"] not in gone]
        return pd.DataFrame([{"operation": r["operation"], "name": r["name"], "type": r["type"], "required": bool(r["always"] and len(r["families"]) == r["members"]), "slots": list(r["slots"])} for r in left])

    rows = inputs.join(members, "operation").withColumn("always", F.col("required") | F.col("always") if "always" in inputs.columns else F.col("required"))
    return rows.select("operation", "name", "type", "always", "words", "observed", "families", "slots", "members").groupBy("operation").applyInPandas(run, INPUTS)


def prerequisite_groups(carriers: DataFrame, edges: DataFrame) -> DataFrame:
    """State that reaches a family from another, by carrier: its keys, where it left, the most matches, and the keys on every request.

    carriers: flow_carriers; edges: (from, to, ordered, without, sessions).  Flows of low-information values and of a family to itself are left
    out.  A header and a cookie are told apart; every other carrier is a parameter, but for redirects.
    """
    kept = carriers.where("not low_information and `from` <> to")
    kind = F.when(F.col("carrier").isin("cookie", "header", "redirect"), F.col("carrier")).otherwise("parameter")
    key = F.concat_ws(".", "to_part", "to_place")
    rows = kept.withColumns({"kind": kind, "key": key, "source": F.concat_ws(".", "from_part", "from_place")})
    most = rows.groupBy("from", "to", "kind", "key").agg(F.max("matches").alias("_m"), F.collect_set("source").alias("_s"))
    joined = most.join(edges.select("from", "to", (F.col("ordered") + F.col("without")).alias("of"), "without", "sessions"), ["from", "to"])
    return joined.groupBy(F.col("to").alias("consumer"), F.col("from").alias("producer"), "kind").agg(
        F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("sources"), F.max("_m").alias("matches"),
        F.array_sort(F.collect_set(F.when(F.col("_m") >= F.col("of"), F.col("key")))).alias("always"), F.max("of").alias("of"), F.max("without").alias("without"), F.max("sessions").alias("sessions"),
    )


def ranked_prerequisites(groups: DataFrame, most: int = 3) -> DataFrame:
    """For each consumer and kind the `most` groups with most matches, with rank, how many are pruned, and contradicting observations."""
    best = Window.partitionBy("consumer", "kind").orderBy(F.desc("matches"), "producer")
    every = Window.partitionBy("consumer", "kind")
    rows = groups.withColumn("rank", F.row_number().over(best)).withColumn("pruned", F.greatest(F.lit(0), F.count("*").over(every) - most)).where(F.col("rank") <= most)
    return rows.withColumn("contradicting", F.col("of") - F.col("matches") + F.col("without"))


def alternates(groups: DataFrame) -> DataFrame:
    """(consumer, producer, kind, alternates): other producers from which the same keys reach the consumer.

    Groups of a consumer meet by key, not by pairs of groups.
    """
    keyed = groups.select("consumer", "producer", "kind", F.explode("keys").alias("key"))
    other = keyed.select("consumer", "key", F.col("producer").alias("_p"), F.col("kind").alias("_k"))
    met = keyed.join(other, ["consumer", "key"]).where("producer <> _p or kind <> _k")
    return met.groupBy("consumer", "producer", "kind").agg(F.array_sort(F.collect_set("_p")).alias("alternates"))


def aliases(evidence: DataFrame, most: int = 10) -> DataFrame:
    """The first `most` pieces of evidence (subject, ref) of each subject, by ref, as E1, E2 and so on."""
    order = Window.partitionBy("subject").orderBy("ref")
    rows = evidence.select("subject", "ref").distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return rows.select("subject", F.concat(F.lit("E"), F.col("_r").cast("string")).alias("alias"), "ref")


def object_like(entities: DataFrame, references: DataFrame) -> DataFrame:
    """(entity) of entities (entity, object) that are objects, or that such a one refers to (from, to), however far."""
    found = written(entities.where("object").select("entity").distinct())
    known = entities.select(F.col("entity").alias("to"))
    edges = written(references.select("from", "to").where("`from` <> to").distinct().join(known, "to", "left_semi"))
    new = found
    while True:
        new = written(edges.join(new.withColumnRenamed("entity", "from"), "from").select(F.col("to").alias("entity")).distinct().join(found, "entity", "left_anti"))
        if new.isEmpty():
            return found
        found = written(found.union(new))


def settled_aside(families: DataFrame) -> DataFrame:
    """Families (family, role) that need no further look: those that a rule calls background or presentation."""
    return families.where(F.col("role").isin("background", "presentation")).select("family")


def merge_misses(operations: DataFrame) -> DataFrame:
    """(role, host, first, families): pages alike but for their response variants, which page_merges leaves apart."""
    key = F.array_join(F.array_sort(F.col("variants")), ",")
    rows = operations.groupBy("role", "host", "first").agg(F.count_distinct(key).alias("_k"), F.array_sort(F.collect_set("family")).alias("families"))
    return rows.where("_k > 1").drop("_k")


def operation_outputs(members: DataFrame, producers: DataFrame, variants: DataFrame) -> DataFrame:
    """(operation, entity, many, sources): entities that the responses of an operation's families carry; without any, the raw response.

    members: (operation, role, family); producers: (entity, family, place); variants: (family, variant, media).  Several are given where a
    place repeats ([]), or where the operation reads a collection.  A raw response has no entity, and its media types as sources.
    """
    held = members.join(producers, "family")
    found = held.groupBy("operation", "entity").agg(
        F.bool_or((F.col("role") == "collection-read") | F.contains("place", F.lit("[]"))).alias("many"), F.array_sort(F.collect_set(F.concat_ws("#", "family", "place"))).alias("sources")
    )
    raw = members.join(found.select("operation").distinct(), "operation", "left_anti").join(variants, "family", "left")
    plain = raw.groupBy("operation").agg(F.array_sort(F.collect_set(F.nullif("media", F.lit("")))).alias("sources"))
    return found.unionByName(plain.select("operation", F.lit(None).cast("string").alias("entity"), F.lit(False).alias("many"), "sources"))


def standing(hypotheses: DataFrame) -> DataFrame:
    """Hypotheses (status) that hold: supported by checks, or reviewed by a person."""
    return hypotheses.where(F.col("status").isin("supported", "mechanically_supported", "reviewed"))


def preconditions(groups: DataFrame) -> DataFrame:
    """Ranked prerequisites as an interface description lists them: (operation, needs, carrier, keys, always, confidence)."""
    share = F.round(F.col("matches") / F.greatest("of", F.lit(1)), 3)
    return groups.select(F.col("consumer").alias("operation"), F.col("producer").alias("needs"), F.col("kind").alias("carrier"), "keys", "always", share.alias("confidence"))

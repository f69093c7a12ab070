"""Scores of whole interface descriptions against expected ones, for any number of runs at once.

Every table has a column `run`; names and ids are compared inside a run.  What is found chooses its best expected counterpart; of several that chose the
same one the strongest takes it, and the others split it.  Ties go to what stands first: `place` is the order in which a description lists things.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import ratio
from ..lineage import written

#: Roles that are no part of what an interface offers.
ASIDE = ("background", "presentation")
STANDING = ("mechanically_supported", "reviewed")


@dataclass(frozen=True)
class Expected:
    """What a run should have found, as people labelled it."""

    roles: DataFrame  # run, family, role
    entities: DataFrame  # run, entity, place, names (array)
    identity: DataFrame  # run, entity, ref
    not_identity: DataFrame  # run, ref
    fields: DataFrame  # run, entity, field
    relations: DataFrame  # run, entity, kind, target (an entity)
    operations: DataFrame  # run, operation, place, role
    families: DataFrame  # run, operation, family
    inputs: DataFrame  # run, operation, slot
    outputs: DataFrame  # run, operation, entity, many


@dataclass(frozen=True)
class Found:
    """What a run found."""

    roles: DataFrame  # run, family, role, status, place (of several that stand, the last counts)
    entities: DataFrame  # run, id, place, name
    identity: DataFrame  # run, id, ref, family
    fields: DataFrame  # run, id, field, families (array; where the field was seen)
    relations: DataFrame  # run, id, kind, target (an id)
    operations: DataFrame  # run, id, place, role
    families: DataFrame  # run, id, family
    inputs: DataFrame  # run, id, slot (of required inputs)
    outputs: DataFrame  # run, id, entity (an id, may be null), many


def _taken(chosen: DataFrame, what: str) -> DataFrame:
    """chosen (run, id, place, <what>, weight) with taken: whether this is the strongest that chose it."""
    first = Window.partitionBy("run", what).orderBy(F.desc("weight"), "place", "id")
    return chosen.withColumn("taken", F.row_number().over(first) == 1)


def _best(weighted: DataFrame, what: str) -> DataFrame:
    """For each found thing the expected one of largest weight, the first of equal ones."""
    best = Window.partitionBy("run", "id").orderBy(F.desc("weight"), "_place", what)
    return weighted.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r", "_place")


def match_entities(e: Expected, f: Found) -> DataFrame:
    """(run, id, place, name, entity, weight, taken, scored): the expected entity that each found one matches.

    The weight is the number of identity slots both have.  Only where neither has an identity do field names count: their Jaccard
    similarity, from 0.5 on.  An entity that matches none is scored as wrong if it is made of slots that are known to be no identity, or
    only of families that are aside; else it isn't scored.  Things meet by the slots or fields that they share, never all with all.
    """
    places = e.entities.select("run", "entity", F.col("place").alias("_place"))
    fi, ei = f.identity.select("run", "id", "ref").distinct(), e.identity.select("run", "entity", "ref").distinct()
    by_slots = fi.join(ei, ["run", "ref"]).groupBy("run", "id", "entity").agg(F.count("*").cast("double").alias("weight"))
    ff = f.fields.select("run", "id", "field").distinct().join(fi, ["run", "id"], "left_anti")
    ef = e.fields.select("run", "entity", "field").distinct().join(ei, ["run", "entity"], "left_anti")
    n, m = ff.groupBy("run", "id").agg(F.count("*").alias("_n")), ef.groupBy("run", "entity").agg(F.count("*").alias("_m"))
    shared = ff.join(ef, ["run", "field"]).groupBy("run", "id", "entity").agg(F.count("*").alias("_c")).join(n, ["run", "id"]).join(m, ["run", "entity"])
    by_fields = shared.select("run", "id", "entity", (F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c"))).alias("weight")).where("weight >= 0.5")
    best = _best(by_slots.unionByName(by_fields).join(places, ["run", "entity"]), "entity")
    matched = _taken(f.entities.select("run", "id", "place").join(best, ["run", "id"]), "entity")
    known_not = f.identity.join(e.not_identity.select("run", "ref").distinct(), ["run", "ref"], "left_semi").select("run", "id").distinct()
    made_of = f.identity.select("run", "id", "family").union(f.fields.select("run", "id", F.explode("families"))).distinct()
    roles = e.roles.select("run", "family", F.col("role").isin(*ASIDE).alias("_aside"))
    aside = made_of.join(roles, ["run", "family"], "left").groupBy("run", "id").agg(F.bool_and(F.coalesce("_aside", F.lit(False))).alias("_a")).where("_a").select("run", "id")
    wrong = known_not.union(aside).distinct().withColumn("_wrong", F.lit(True))
    out = f.entities.join(matched.select("run", "id", "entity", "weight", "taken"), ["run", "id"], "left").join(wrong, ["run", "id"], "left")
    return out.withColumns({"taken": F.coalesce("taken", F.lit(False)), "scored": F.col("entity").isNotNull() | F.coalesce("_wrong", F.lit(False))}).drop("_wrong")


def match_operations(e: Expected, f: Found) -> DataFrame:
    """(run, id, place, role, operation, weight, taken, scored): the expected operation that each found one matches.

    Half of a found operation's families at least come from its match, and of several such the one of largest Jaccard similarity is
    taken.  One that matches none is scored as wrong if all its families are labelled.
    """
    places = e.operations.select("run", "operation", F.col("place").alias("_place"))
    ff, ef = f.families.select("run", "id", "family").distinct(), e.families.select("run", "operation", "family").distinct()
    n, m = ff.groupBy("run", "id").agg(F.count("*").alias("_n")), ef.groupBy("run", "operation").agg(F.count("*").alias("_m"))
    shared = ff.join(ef, ["run", "family"]).groupBy("run", "id", "operation").agg(F.count("*").alias("_c")).join(n, ["run", "id"]).join(m, ["run", "operation"])
    weighted = shared.where("2 * _c >= _n").select("run", "id", "operation", (F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c"))).alias("weight"))
    matched = _taken(f.operations.select("run", "id", "place").join(_best(weighted.join(places, ["run", "operation"]), "operation"), ["run", "id"]), "operation")
    labelled = ff.join(e.roles.select("run", "family", F.lit(True).alias("_l")).distinct(), ["run", "family"], "left")
    labelled = labelled.groupBy("run", "id").agg(F.bool_and(F.coalesce("_l", F.lit(False))).alias("_all"))
    out = f.operations.join(matched.select("run", "id", "operation", "weight", "taken"), ["run", "id"], "left").join(labelled, ["run", "id"], "left")
    scored = F.col("operation").isNotNull() | F.coalesce("_all", F.lit(True))
    return out.withColumns({"taken": F.coalesce("taken", F.lit(False)), "scored": scored}).drop("_all")


def _rows(measure: str, rows: DataFrame, correct: Column, predicted: Column, expected: Column) -> DataFrame:
    """(run, measure, correct, predicted, expected) summed over rows; each of the three is a number or a truth value of a row."""
    return rows.groupBy("run").agg(*[F.sum(F.coalesce(c.cast("long"), F.lit(0).cast("long"))).alias(n) for c, n in ((correct, "correct"), (predicted, "predicted"), (expected, "expected"))]).withColumn("measure", F.lit(measure))


def _sets(measure: str, given: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The measure of a set of given rows against a set of wanted ones."""
    both = given.select("run", *key).distinct().withColumn("_g", F.lit(True)).join(wanted.select("run", *key).distinct().withColumn("_w", F.lit(True)), ["run", *key], "full_outer")
    return _rows(measure, both, F.col("_g") & F.col("_w"), F.col("_g"), F.col("_w"))


def _half(n: Column) -> Column:
    return (n * (n - 1) / 2).cast("long")


def _pairs_together(slots: DataFrame) -> DataFrame:
    """(run, _c, _p): how many different pairs of refs some id holds together (_p), and those of one owner (_c), from slots (run, id, ref, _owner).

    Refs of the same ids are one class, and pairs are counted from the sizes of classes: those inside a class, and those of classes that share
    an id.  So what meets is sets of ids, not refs.
    """
    per = slots.groupBy("run", "ref").agg(F.array_sort(F.collect_set("id")).alias("_ids"), F.max("_owner").alias("_owner"))
    sizes = written(per.groupBy("run", "_ids", "_owner").agg(F.count("*").alias("_n")))
    every = sizes.groupBy("run", "_ids").agg(F.sum("_n").alias("_n"))
    ids = every.select("run", "_ids", F.explode("_ids").alias("_id"))
    met = ids.join(ids.withColumnRenamed("_ids", "_other"), ["run", "_id"]).where("_ids < _other").select("run", "_ids", "_other").distinct()

    def counted(of: DataFrame, key: list[str]) -> DataFrame:
        two = met.join(of, ["run", "_ids"]).join(of.select("run", F.col("_ids").alias("_other"), *key, F.col("_n").alias("_m")), ["run", "_other", *key])
        return of.select("run", _half(F.col("_n")).alias("_k")).union(two.select("run", F.col("_n") * F.col("_m")))

    none = F.lit(0).cast("long")
    rows = counted(every, []).select("run", none.alias("_c"), F.col("_k").alias("_p"))
    return rows.union(counted(sizes.where("_owner is not null"), ["_owner"]).select("run", "_k", none)).where("_c > 0 or _p > 0")


def scores(e: Expected, f: Found, entities: DataFrame | None = None, operations: DataFrame | None = None) -> DataFrame:
    """(run, measure, correct, predicted, expected, precision, recall) of roles, identity joins, entities, their names, fields and relations, operations, merges, required inputs, and outputs; and unscored.

    entities and operations are match_entities() and match_operations(), where they are there already.  A measure of nothing in a run has no row.
    """
    ents = written(entities if entities is not None else match_entities(e, f))
    ops = written(operations if operations is not None else match_operations(e, f))
    yes, one = F.lit(True), F.lit(1)
    parts = []

    last = Window.partitionBy("run", "family").orderBy(F.desc("place"), "role")
    standing = f.roles.where(F.col("status").isin(*STANDING)).withColumn("_r", F.row_number().over(last)).where("_r = 1").select("run", "family", F.col("role").alias("_have"))
    have = e.roles.join(standing, ["run", "family"], "left")
    parts.append(_rows("roles", have, F.col("_have") == F.col("role"), F.coalesce(F.col("_have") != "", F.lit(False)), one))

    # pairs of labelled slots: expected from the sizes of entities, found ones by what they share
    owner = e.identity.select("run", "ref", F.col("entity").alias("_owner")).distinct()
    labelled = owner.select("run", "ref").union(e.not_identity.select("run", "ref")).distinct()
    slots = f.identity.select("run", "id", "ref").distinct().join(labelled, ["run", "ref"]).join(owner.groupBy("run", "ref").agg(F.max("_owner").alias("_owner")), ["run", "ref"], "left")
    pairs = _pairs_together(slots)
    n = e.identity.groupBy("run", "entity").agg(F.count("*").alias("_n")).select("run", F.lit(0).alias("_c"), F.lit(0).alias("_p"), _half(F.col("_n")))
    parts.append(_rows("identity_joins", pairs.select("run", "_c", "_p", F.lit(0).alias("_w")).union(n), F.col("_c"), F.col("_p"), F.col("_w")))

    wanted = e.entities.join(ents.where("taken").select("run", "entity", "id", "name"), ["run", "entity"], "left")
    scored = ents.where("scored")
    rows = wanted.select("run", F.col("id").isNotNull().alias("_c"), F.lit(0).alias("_p"), one.alias("_e")).union(scored.select("run", F.lit(False), F.lit(1), F.lit(0)))
    parts.append(_rows("entities", rows, F.col("_c"), F.col("_p"), F.col("_e")))
    named = wanted.where("id is not null").withColumn("_named", F.exists("names", lambda x: F.lower(x) == F.lower(F.col("name"))))
    parts.append(_rows("entity_names", named, F.col("_named"), one, one))
    ids = wanted.where("id is not null").select("run", "entity", "id")
    with_fields = e.fields.select("run", "entity").distinct()
    listed = f.fields.groupBy("run", "id", "field").agg(F.count("*").alias("_n")).join(ids.join(with_fields, ["run", "entity"], "left_semi"), ["run", "id"])
    both = listed.select("run", "entity", "field", "_n").join(e.fields.select("run", "entity", "field", yes.alias("_w")), ["run", "entity", "field"], "full_outer")
    parts.append(_rows("entity_fields", both, F.col("_n").isNotNull() & F.col("_w"), F.col("_n"), F.col("_w")))
    name_of = scored.select("run", "id", F.coalesce("entity", F.lit("")).alias("entity"))
    rel = f.relations.join(name_of, ["run", "id"]).join(name_of.select("run", F.col("id").alias("target"), F.col("entity").alias("_to")), ["run", "target"]).select("run", "entity", "kind", F.col("_to").alias("target"))
    parts.append(_sets("relations", rel, e.relations, ["entity", "kind", "target"]))

    right = ops.where("taken").join(e.operations.select("run", "operation", F.col("role").alias("_role")), ["run", "operation"])
    rows = ops.where("scored").select("run", F.lit(0).alias("_c"), F.lit(1).alias("_p"), F.lit(0).alias("_e")).union(e.operations.select("run", F.lit(0), F.lit(0), one))
    rows = rows.union(right.where(F.col("role").eqNullSafe(F.col("_role"))).select("run", one, F.lit(0), F.lit(0)))
    parts.append(_rows("operations", rows, F.col("_c"), F.col("_p"), F.col("_e")))
    inside = e.families.groupBy("run", "family").agg(F.max("operation").alias("_in"))
    mine = f.families.join(inside, ["run", "family"])
    same = mine.groupBy("run", "id", "_in").agg(F.count("*").alias("_n"))
    rows = same.select("run", _half(F.col("_n")).alias("_c"), F.lit(0).cast("long").alias("_p"), F.lit(0).cast("long").alias("_e"))
    rows = rows.union(same.groupBy("run", "id").agg(F.sum("_n").alias("_n")).select("run", F.lit(0), _half(F.col("_n")), F.lit(0)))
    rows = rows.union(e.families.groupBy("run", "operation").agg(F.count("*").alias("_n")).select("run", F.lit(0), F.lit(0), _half(F.col("_n"))))
    parts.append(_rows("operation_merges", rows, F.col("_c"), F.col("_p"), F.col("_e")))
    taken = ops.where("taken").select("run", "id", "operation")
    asked = f.inputs.join(taken, ["run", "id"]).groupBy("run", "operation", "slot").agg(F.count("*").alias("_n"))
    both = asked.join(e.inputs.select("run", "operation", "slot").distinct().withColumn("_w", yes), ["run", "operation", "slot"], "full_outer")
    parts.append(_rows("required_inputs", both, F.when(F.col("_w"), F.col("_n")), F.col("_n"), F.col("_w")))
    given = f.outputs.join(taken, ["run", "id"]).select("run", "operation", F.col("entity").alias("_id"), "many")
    given = given.join(name_of.select("run", F.col("id").alias("_id"), "entity"), ["run", "_id"])
    parts.append(_sets("outputs", given, e.outputs, ["operation", "entity", "many"]))
    left_out = ents.where("not scored").select("run").union(ops.where("not scored").select("run"))
    parts.append(_rows("unscored", left_out, F.lit(0), one, F.lit(0)))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("run", "measure", "correct", "predicted", "expected", ratio(F.col("correct"), F.col("predicted")).alias("precision"), ratio(F.col("correct"), F.col("expected")).alias("recall"))


def prerequisite_scores(prerequisites: DataFrame, consumers: DataFrame, accepted: DataFrame) -> DataFrame:
    """(run, predicted, false_positives, rate, background) of prerequisites (run, id, kind, status, carrier, consumer, producer) of labelled consumers (run, family).

    Those rejected, and those of kind unknown or without one, claim nothing; background is counted apart.  accepted (run, carrier, producers, kinds) are rules that
    allow a claim; a rule without producers allows any.
    """
    rows = prerequisites.where("status <> 'rejected'").join(consumers.select("run", F.col("family").alias("consumer")).distinct(), ["run", "consumer"], "left_semi")
    rules = accepted.select("run", "carrier", F.explode("kinds").alias("kind"), F.explode_outer("producers").alias("_p")).distinct()
    any_ = rules.where("_p is null").select("run", "carrier", "kind", F.lit(True).alias("_any")).distinct()
    some = rules.where("_p is not null").select("run", "carrier", "kind", F.col("_p").alias("producer"), F.lit(True).alias("_some"))
    met = rows.join(any_, ["run", "carrier", "kind"], "left").join(some, ["run", "carrier", "kind", "producer"], "left")
    claims = ~F.col("kind").isin("background", "unknown", "")
    wrong = claims & ~F.coalesce("_any", F.lit(False)) & ~F.coalesce("_some", F.lit(False))
    sums = met.groupBy("run").agg(F.count_if(F.coalesce(claims, F.lit(False))).alias("predicted"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("false_positives"), F.count_if(F.col("kind") == "background").alias("background"))
    return sums.withColumn("rate", ratio(F.col("false_positives"), F.col("predicted")))


def abstentions(decisions: DataFrame, roles: DataFrame) -> DataFrame:
    """(run, tasks, unknown, unresolved, on_labelled, rate) of decisions (run, model, status, choice, type, family) that no rule made; roles (run, family, role) are the labels."""
    rows = decisions.where("model <> 'rule'").join(roles.select("run", "family", F.lit(True).alias("_l")).distinct(), ["run", "family"], "left")
    open_ = F.col("status") == "unresolved"
    unknown = ~open_ & (F.col("choice") == "unknown")
    on = (open_ | unknown) & (F.col("type") == "classify_family") & F.coalesce("_l", F.lit(False))
    sums = rows.groupBy("run").agg(F.count("*").alias("tasks"), F.count_if(unknown).alias("unknown"), F.count_if(open_).alias("unresolved"), F.count_if(on).alias("on_labelled"))
    return sums.withColumn("rate", ratio(F.col("unknown") + F.col("unresolved"), F.col("tasks")))


def mistakes(e: Expected, entities: DataFrame, operations: DataFrame) -> DataFrame:
    """(run, what, id, expected) of the matches that didn't come out: entities and operations that split or match none, and those not found."""
    def of(rows: DataFrame, every: DataFrame, what: str) -> DataFrame:
        name = F.col(what)
        found = rows.where("scored and not taken").select("run", F.when(name.isNull(), f"{what} matches none").otherwise(f"{what} splits").alias("what"), "id", name.alias("expected"))
        missing = every.select("run", what).join(rows.where("taken").select("run", what), ["run", what], "left_anti")
        return found.union(missing.select("run", F.lit(f"{what} not found"), F.lit(None).cast("string"), what))

    return of(entities, e.entities, "entity").union(of(operations, e.operations, "operation"))

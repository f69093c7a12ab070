"""What an interface offers, from the outputs of the whole pass: roles, keys and entities, operations with inputs and outputs, prerequisites, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shape import containers
from ..functions.text import last_name, singular
from ..lineage import written
from ..operators import decisions, entities, operations, semantics, tasks, values

#: Roles that make a family an operation.
OFFERED = ("collection_read", "item_read", "mutation")
DOCUMENT = "document"


def family_features(outputs: dict[str, DataFrame], structure: DataFrame) -> DataFrame:
    """What tasks.role_choices looks at, and what settles a role by rule, for each family."""
    rows = outputs["responses"].join(operations.listed(structure), "ref", "left")
    found = operations.response_features(rows.select("family", "kind", "root", "listed", "media", "size_class"))
    slots = outputs["slots"].where("cardinality > 1")
    at = lambda part: F.array_sort(F.collect_set(F.when(F.startswith("location", F.lit(part + ".")), F.col("location")))).alias(f"{part}_slots")
    varied = slots.groupBy("family").agg(at("path"), at("query"))
    typed = operations.free_text_slots(outputs["slots"]).select("family", F.lit(True).alias("free_text")).distinct()
    cookies = outputs["carried"].where("part = 'set-cookie'").select("family", F.lit(True).alias("sets_cookies")).distinct()
    feeds = outputs["edge_flows"].where("not (low_information or ubiquitous)").groupBy(F.col("from").alias("family")).agg(F.count("*").cast("int").alias("feeds"))
    hosts = outputs["families"].select("family", "host")
    pages = outputs["steps"].where(F.col("kind") == DOCUMENT).join(hosts, "family").select("host", F.lit(True).alias("page_host")).distinct()
    out = outputs["families"].select("family", "method", "host", "static")
    for part in (found, varied, typed, cookies, feeds):
        out = out.join(part, "family", "left")
    out = out.join(pages, "host", "left").na.fill(False, ["lists", "objects", "pages", "other", "free_text", "sets_cookies", "page_host"]).na.fill(0, ["feeds"])
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("path_slots", "query_slots")})
    return out.withColumn("has_content", F.col("lists") | F.col("objects") | F.col("pages") | F.col("other"))


def family_roles(features: DataFrame, model: tasks.Model, name: str, prior: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(family, role, how) of every family, by rule or by decision, and the decisions."""
    settled = semantics.settled_roles(features.withColumn("sets_cookie", F.col("sets_cookies")))
    open_ = tasks.role_choices(settled.where("role is null").drop("role"))
    shown = F.concat(F.array("method"), F.transform(F.concat("path_slots", "query_slots"), lambda p: F.concat(F.lit("varies at "), p)))
    asked = tasks.tasks(open_.withColumn("evidence", F.transform(shown, lambda t: F.struct(F.col("family").alias("ref"), t.alias("text")))), "classify_family", "family", "What does this family of requests do for a person?")
    made = written(tasks.decide(asked, model, name, prior=prior))
    by_rule = settled.where("role is not null").select("family", "role", F.lit("rule").alias("how"))
    return by_rule.union(made.where("status = 'decided'").select(F.col("subject").alias("family"), F.col("choice").alias("role"), F.lit("decision"))), made


def _slots(outputs: dict[str, DataFrame], members: DataFrame, keyed: DataFrame) -> DataFrame:
    """Slots of operations as operation_inputs takes them, named by their last key, or by the literal in front of a path slot."""
    part, place = F.substring_index("location", ".", 1), F.expr("substring(location, instr(location, '.') + 1)")
    before = F.get(F.split("template", "/", -1), place.try_cast("int"))
    own = F.when(part == "path", singular(F.when(F.startswith(before, F.lit("{")), "id").otherwise(before))).otherwise(last_name(place))
    name = F.regexp_replace(own, r"[^A-Za-z0-9_]", "_")
    total = outputs["families"].select("family", "template", F.col("observations").alias("total"))
    fed = outputs["flows"].where("from_part is not null").join(outputs["steps"].select("session", F.col("pos").alias("to_pos"), "family"), ["session", "to_pos"])
    fed = fed.groupBy("family", F.concat_ws(".", "to_part", "to_place").alias("location")).agg(F.count_distinct("session", "to_pos").alias("_fed"))
    rows = outputs["slots"].join(members.select("operation", "family"), "family").join(total, "family").join(fed, ["family", "location"], "left").join(keyed, ["family", "location"], "left")
    sizes = members.groupBy("operation").agg(F.count_distinct("family").alias("members"))
    return rows.join(sizes, "operation").select(
        "operation", "members", "family", "location", F.coalesce(name, F.lit("")).alias("name"), "type", "cardinality", "observations", "total", "examples",
        (F.coalesce("_fed", F.lit(0)) >= F.col("observations")).alias("fed"), F.coalesce("entity", F.lit(False)).alias("entity"),
    )


def analyze(outputs: dict[str, DataFrame], model: tasks.Model = tasks.first_choice, name: str = "first", prior: DataFrame | None = None) -> dict[str, DataFrame]:
    """A description by name from the outputs of plans.cluster: roles, decisions, keys, entities, fields, operations, inputs, state, outputs, prerequisites, alternates, coverage.

    Roles that rules don't settle are decided by the model; prior decisions on unchanged evidence are taken over.  Operations are the families that read or
    change something, pages of one shape as one.  A prerequisite's scope says whether both ends are page navigations ("navigation") or not ("request").
    """
    responses = outputs["responses"]
    structure = written(containers(responses.where("kind = 'json'").select("ref", "tree"), "tree"))
    features = written(family_features(outputs, structure))
    roles, made = family_roles(features, model, name, prior)
    roles = written(roles)
    aside = operations.settled_aside(roles)

    carried = outputs["carried"]
    known = written(values.identity_values(carried))
    classes = written(values.key_classes(known.where("consumer"), values.joinable_slots(known.where("consumer").select("slot", "value"))))
    slot = F.split("slot", r"\.", 4)
    keyed = classes.select("key_class", slot[1].alias("family"), F.concat_ws(".", slot[2], slot[3]).alias("location"), F.lit(True).alias("entity"))

    bodies = responses.where("kind = 'json'").join(outputs["families"].select("family", "host"), "family").join(aside, "family", "left_anti").select("ref", "host", "family", F.lit(1).alias("count"))
    fields = written(entities.item_fields(structure, bodies))

    paths = outputs["families"].select("family", "host", F.get(F.split("template", "/", -1), F.lit(1)).alias("first"))
    offered = roles.where(F.col("role").isin(*OFFERED)).join(paths, "family")
    shapes = responses.groupBy("family").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "media", F.when(F.col("kind") != "json", F.col("shape"))))).alias("variants"))
    merged = written(semantics.page_merges(offered.join(shapes, "family", "left").where(F.col("role") != "mutation").select("family", "role", "host", "first", F.coalesce("variants", F.array().cast("array<string>")).alias("variants"))))
    of = merged.select("operation", F.explode("families").alias("family"))
    members = written(offered.join(of, "family", "left").select(F.coalesce("operation", "family").alias("operation"), "role", "family"))
    slots = written(_slots(outputs, members, keyed.select("family", "location", "entity").distinct()))

    lists = fields.select("host", "container").distinct()
    producers = structure.where("item").join(bodies, "ref").join(lists, ["host", "container"]).select(F.concat_ws(":", "host", "container").alias("entity"), "family", F.col("container").alias("place")).distinct()
    kinds = responses.select("family", F.concat_ws(":", "kind", "media").alias("variant"), "media").distinct()

    groups = written(operations.prerequisite_groups(outputs["edge_flows"], outputs["edges"]))
    pages = outputs["steps"].where(F.col("kind") == DOCUMENT).select("family").distinct()
    both = groups.join(pages.select(F.col("family").alias("consumer"), F.lit(True).alias("_c")), "consumer", "left").join(pages.select(F.col("family").alias("producer"), F.lit(True).alias("_p")), "producer", "left")
    scoped = both.withColumn("scope", F.when(F.col("_c") & F.col("_p"), "navigation").otherwise("request")).drop("_c", "_p")
    # an operation needs what its families need
    needed = operations.ranked_prerequisites(scoped).join(members.select(F.col("family").alias("consumer"), "operation"), "consumer")
    views = outputs["views"].select(F.concat_ws("/", "session", "episode").alias("view"), "family")
    relevant = roles.where(~F.col("role").isin("background", "presentation")).select("family")
    return {
        "roles": roles,
        "decisions": made.select(*tasks.DECIDED),
        "keys": classes,
        "fields": fields,
        "entities": entities.item_entities(fields),
        "operations": members.groupBy("operation").agg(F.min("role").alias("role"), F.array_sort(F.collect_set("family")).alias("families")),
        "inputs": operations.operation_inputs(slots),
        "state": operations.state_slots(slots),
        "outputs": operations.operation_outputs(members.withColumn("role", F.regexp_replace("role", "_", "-")), producers, kinds),
        "prerequisites": needed,
        "alternates": operations.alternates(groups),
        "coverage": semantics.view_coverage(views.join(relevant, "family", "left_semi"), members.select("family")),
        "subjects": decisions.subjects([("operation", members.select("family", F.col("operation").alias("ref"))), ("role", roles.select("family", F.col("role").alias("ref")))]),
    }

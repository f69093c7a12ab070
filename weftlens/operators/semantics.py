"""Roles, entities, nesting, merges, coverage, metrics and diffs of an interface description."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import coverage, ratio


def settled_roles(families: DataFrame) -> DataFrame:
    """Families (family, method, static, has_content, sets_cookie, feeds) with the role that rules settle, or null for a decision."""
    read = F.col("method").isin("GET", "HEAD")
    idle = read & ~F.col("has_content") & ~F.col("sets_cookie") & (F.col("feeds") == 0)
    return families.withColumn("role", F.when(F.col("static"), "presentation").when(F.col("method") == "OPTIONS", "background").when(idle, "background"))


def entity_fields(objects: DataFrame) -> DataFrame:
    """Fields of entities from (entity, name, type, ref): type (any if several), nulls and observations."""
    types = F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type"))))
    return objects.groupBy("entity", "name").agg(
        F.when(F.size(types) == 1, types[0]).when(F.size(types) == 0, "null").otherwise("any").alias("type"),
        F.count_if(F.col("type") == "null").alias("nulls"), F.count_distinct("ref").alias("observations"),
    )


def nesting(containers: DataFrame) -> DataFrame:
    """(host, path, parent): the longest other container of the host whose path, and a dot, begins this one.

    Every proper prefix of a path that ends before a dot is looked up by equality, so that no pairs of containers are made.
    """
    parts = F.split("path", r"\.")
    up = F.explode_outer(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)))
    prefixes = containers.select("host", "path", up.alias("_k")).withColumn("_up", F.array_join(F.slice(parts, F.lit(1), F.col("_k")), "."))
    known = containers.select(F.col("host").alias("_host"), F.col("path").alias("_path")).distinct()
    met = prefixes.join(known, (F.col("host") == F.col("_host")) & (F.col("_up") == F.col("_path")), "left")
    return met.groupBy("host", "path").agg(F.max_by("_path", F.when(F.col("_path").isNotNull(), F.col("_k"))).alias("parent"))


def page_merges(operations: DataFrame) -> DataFrame:
    """Families (family, role, host, first, variants) that are one operation: same role, host, first literal and set of response variants."""
    key = F.array_join(F.array_sort(F.col("variants")), ",")
    return operations.withColumn("_k", key).groupBy("role", "host", "first", "_k").agg(
        F.min("family").alias("operation"), F.array_sort(F.collect_set("family")).alias("families")
    ).where(F.size("families") > 1).select("role", "host", "first", "operation", "families")


def view_coverage(views: DataFrame, known: DataFrame) -> DataFrame:
    """Share of page views (view, family) with a family that operations (family) cover."""
    per_view = views.join(known.select("family", F.lit(True).alias("_known")).distinct(), "family", "left").groupBy("view").agg(F.bool_or(F.coalesce("_known", F.lit(False))).alias("_covered"))
    counts = per_view.agg(F.count_if("_covered").alias("covered"), F.count("*").alias("relevant"))
    return counts.withColumn("score", coverage(F.col("covered"), F.col("relevant")))


def precision_recall(predicted: DataFrame) -> DataFrame:
    """Metrics by measure from rows (measure, expected, predicted): correct over predicted, and over expected."""
    both = F.count_if(F.col("expected") & F.col("predicted"))
    sums = predicted.groupBy("measure").agg(both.alias("correct"), F.count_if("predicted").alias("given"), F.count_if("expected").alias("wanted"))
    return sums.withColumn("precision", ratio(F.col("correct"), F.col("given"))).withColumn("recall", ratio(F.col("correct"), F.col("wanted")))


def best_matches(expected: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """For each found set (id, item) the expected set (name, item) with the largest Jaccard similarity of at least `least`, and whether it takes it.

    Of several found sets that chose the same expected one the most similar takes it, the first id among equals; the others split it.  Only sets
    that share an item meet.
    """
    e, f = expected.distinct(), found.distinct()
    sizes_e = e.groupBy("name").agg(F.count("*").alias("_n"))
    sizes_f = f.groupBy("id").agg(F.count("*").alias("_m"))
    shared = e.join(f, "item").groupBy("name", "id").agg(F.count("*").alias("_c")).join(sizes_e, "name").join(sizes_f, "id")
    scored = shared.withColumn("overlap", F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c"))).where(F.col("overlap") >= least)
    best = Window.partitionBy("id").orderBy(F.desc("overlap"), "name")
    chosen = scored.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    strongest = Window.partitionBy("name").orderBy(F.desc("overlap"), "id")
    return chosen.select("id", "name", "overlap", (F.row_number().over(strongest) == 1).alias("taken"))


def node_diff(prior: DataFrame, current: DataFrame) -> DataFrame:
    """(node, change) between two revisions (node, content): added, removed or changed."""
    p, c = prior.select("node", F.col("content").alias("_p")), current.select("node", F.col("content").alias("_c"))
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_p") != F.col("_c"), "changed")
    return p.join(c, "node", "full_outer").select("node", change.alias("change")).where("change is not null")


def unresolved(references: DataFrame, known: DataFrame) -> DataFrame:
    """References (ref, ...) to nothing in known (ref)."""
    return references.join(known.select("ref").distinct(), "ref", "left_anti")


def tree_digest(files: DataFrame) -> DataFrame:
    """Per tree a digest of its files (tree, path, size, content_hash), whatever their order.

    Files fall into 4096 parts by a hash of their path; a part's sorted lines are digested, then the tree's sorted parts.
    """
    line = F.concat_ws(" ", "path", F.col("size").cast("string"), "content_hash")
    part = F.substring(F.sha2("path", 256), 1, 3)
    joined = lambda lines: F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), "\n"), 256)
    parts = files.groupBy("tree", part.alias("_p")).agg(F.count("*").alias("_n"), joined(line).alias("_d"))
    return parts.groupBy("tree").agg(F.sum("_n").alias("files"), joined(F.concat_ws(" ", "_p", "_d")).alias("digest"))


def identity_scores(members: DataFrame) -> DataFrame:
    """Precision and recall of pairs of members (expected, found) that classes join: from class sizes, so that no pairs are made."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2).cast("long")
    both = members.groupBy("expected", "found").agg(F.count("*").alias("n"))
    one = lambda c: both.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias("p"))
    rows = both.agg(pairs("n").alias("correct")).crossJoin(one("found").toDF("given")).crossJoin(one("expected").toDF("wanted"))
    return rows.withColumn("precision", ratio(F.col("correct"), F.col("given"))).withColumn("recall", ratio(F.col("correct"), F.col("wanted")))


def role_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per role of families (family, role): how many are predicted rightly, given and wanted, with precision and recall; a role `unknown` isn't given."""
    e = expected.select("family", F.col("role").alias("_e"))
    p = predicted.where("role <> 'unknown'").select("family", F.col("role").alias("_p"))
    both = e.join(p, "family", "full_outer")
    sides = F.array(F.struct(F.col("_e").alias("measure"), F.lit(True).alias("wanted"), F.lit(False).alias("given"), F.lit(False).alias("right")), F.struct(F.col("_p").alias("measure"), F.lit(False).alias("wanted"), F.lit(True).alias("given"), F.col("_e").eqNullSafe(F.col("_p")).alias("right")))
    rows = both.select(F.inline(sides)).where("measure is not null")
    sums = rows.groupBy("measure").agg(F.count_if("right").alias("correct"), F.count_if("given").alias("given"), F.count_if("wanted").alias("wanted"))
    return sums.withColumn("precision", ratio(F.col("correct"), F.col("given"))).withColumn("recall", ratio(F.col("correct"), F.col("wanted")))


def search_lines(lines: DataFrame, wanted: str, most: int = 40) -> DataFrame:
    """The first `most` lines (path, line_no, line) that contain the wanted text, any case, each with the total."""
    found = lines.where(F.contains(F.lower("line"), F.lit(wanted.lower())))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("path", "line_no").limit(most).crossJoin(F.broadcast(total))

"""Closed-choice decisions, hypotheses, and revisions of an interface description."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What identifies a decision: the same five give the same answer, so it is taken over.
REUSE = ["task", "input_hash", "prompt", "model", "params"]


def reuse(tasks: DataFrame, prior: DataFrame) -> DataFrame:
    """Tasks with the choice of an earlier equal decision; choice is null and reused false where there is none."""
    last = prior.select(*REUSE, "choice").dropDuplicates(REUSE)
    return tasks.join(last, REUSE, "left").withColumn("reused", F.col("choice").isNotNull())


def decide_first(tasks: DataFrame) -> DataFrame:
    """The stand-in for a model: the first choice that isn't `unknown`, with the first evidence; order of choices is meaning."""
    known = F.filter("choices", lambda c: c != "unknown")
    return tasks.withColumn("decision", F.coalesce(F.get(known, F.lit(0)), F.lit("unknown"))).withColumn("because", F.slice("evidence", 1, 1))


def checked(decisions: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Decisions with the outcome of named SQL checks, and a status: supported if all pass, else rejected."""
    outcome = F.array(*[F.struct(F.lit(name).alias("check"), F.coalesce(F.expr(sql), F.lit(False)).alias("passed")) for name, sql in checks.items()])
    rows = decisions.withColumn("checks", outcome)
    return rows.withColumn("status", F.when(F.forall("checks", lambda c: c["passed"]), "supported").otherwise("rejected"))


def upsert(prior: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two revisions by key: the new one supersedes the prior one, except where a person has reviewed that."""
    columns = [c for c in new.columns if c not in key]
    p = prior.select(*key, F.struct(*columns).alias("_p"))
    n = new.select(*key, F.struct(*columns).alias("_n"))
    both = p.join(n, key, "full_outer")
    kept = F.when(F.col("_n").isNull() | (F.col("_p.status") == "reviewed"), F.col("_p")).otherwise(F.col("_n"))
    return both.select(*key, kept.alias("_k")).select(*key, "_k.*")


def subjects(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(family, refs): which references (family, ref) of several kinds involve a family."""
    rows = None
    for kind, part in parts:
        one = part.select("family", F.concat_ws(":", F.lit(kind), F.col("ref").cast("string")).alias("ref"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("family").agg(F.array_sort(F.collect_set("ref")).alias("refs"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, copies) of keys that occur more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def issues(rows: DataFrame, id_: str, rules: dict[str, str]) -> DataFrame:
    """(id, issue): a row for each SQL rule that a row breaks; rules that are null don't hold."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in rules.items()]), lambda x: x.isNotNull())
    return rows.select(F.col(id_).alias("id"), F.explode(broken).alias("issue"))


def regrouped(before: DataFrame, after: DataFrame) -> DataFrame:
    """(ref, was, now): how observations (ref, family) moved between two passes; null for new ones."""
    moved = before.select("ref", F.col("family").alias("was")).join(after.select("ref", F.col("family").alias("now")), "ref", "full_outer")
    return moved.where("not (was <=> now)")


def ranked_names(votes: DataFrame, most: int = 6) -> DataFrame:
    """Each subject's names by votes (subject, name), the first `most`."""
    counted = votes.groupBy("subject", "name").agg(F.count("*").alias("votes"))
    best = Window.partitionBy("subject").orderBy(F.desc("votes"), "name")
    return counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def report(hypotheses: DataFrame, statuses: list[str]) -> DataFrame:
    """Hypotheses (kind, status) counted, a column a status."""
    return hypotheses.groupBy("kind").pivot("status", statuses).count().na.fill(0)

"""Path templates of a growing table, maintained batch by batch: a batch changes what it regroups, and nothing else.

Templates are those of families.route_templates.  What is kept: every different path with its template and count, and the different siblings below
every template prefix.  Siblings below a prefix only grow until the group becomes a slot; then the paths below it move to the slot's prefix, and their old
prefixes are gone as a whole, since a literal prefix holds one literal.  So a batch derives templates for its new paths, and anew for those below a
prefix whose siblings have just become enough, and says which families it takes back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import url
from ..lineage import written
from ..operators.families import SIBLINGS

PATHS = "method string, host string, segments array<string>, template string, slots array<int>, observations long, version long"
GROUPS = "method string, host string, made string, class string, seg string, alive boolean, version long"
CHANGES = "change string, method string, host string, template string, paths long, observations long, version long"
PATH, GROUP = ["method", "host", "segments"], ["method", "host", "made", "class"]
FAMILY = ["method", "host", "template"]


def _prefix(template: str, depth: Column) -> Column:
    """The template's first `depth` segments, as families.route_templates makes them."""
    parts = F.slice(F.split(F.col(template), "/", -1), F.lit(2), depth)
    return F.when(depth == 0, "").otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


class Routes:
    """Templates in a folder that all machines share, one version a batch.

    Each version adds rows to three tables, and stands once its marker does: a batch that failed is written over when it is repeated, and a repeated
    batch whose marker stands is left alone.  A table's rows are those of its keys' latest version.
    """

    def __init__(self, spark: SparkSession, folder: str, siblings: int = SIBLINGS):
        self._spark, self._folder, self._siblings = spark, folder.rstrip("/"), siblings

    def _versions(self) -> list[int]:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self._folder}/done")
        fs = path.getFileSystem(self._spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _read(self, name: str, schema: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(*[f"{self._folder}/{name}/{v}" for v in versions])

    def _paths(self, versions: list[int]) -> DataFrame:
        rows = self._read("paths", PATHS, versions).groupBy(*PATH).agg(F.max_by(F.struct("template", "slots", "observations"), "version").alias("_l"))
        return rows.select(*PATH, "_l.*")

    def _groups(self, versions: list[int]) -> DataFrame:
        rows = self._read("groups", GROUPS, versions).groupBy(*GROUP, "seg").agg(F.max_by("alive", "version").alias("alive"))
        return rows.where("alive").drop("alive")

    def templates(self) -> DataFrame:
        """(method, host, segments, template, slots, observations) of every different path so far."""
        return self._paths(self._versions())

    def families(self) -> DataFrame:
        """(method, host, template, paths, observations) of every template so far."""
        return _families(self.templates())

    def changes(self) -> DataFrame:
        """(change, method, host, template, paths, observations, version): what each batch took back ("retract") and put in its place ("assert")."""
        return self._read("changes", CHANGES, self._versions())

    def rewritten(self, version: int) -> dict[str, int]:
        """How many rows of each table a batch wrote."""
        return {name: self._read(name, schema, [version]).count() for name, schema in (("paths", PATHS), ("groups", GROUPS), ("changes", CHANGES))}

    def apply(self, rows: DataFrame, version: int) -> None:
        """Takes rows (method, host, segments) in as a version, higher than those before."""
        before = self._versions()
        if version in before:
            return
        came = written(rows.groupBy(*PATH).agg(F.count("*").alias("_n")))
        hosts = written(came.select("method", "host").distinct())
        paths = self._paths(before).join(hosts, ["method", "host"], "left_semi")
        met = written(came.join(paths, PATH, "left"))
        groups = self._groups(before).join(hosts, ["method", "host"], "left_semi")

        none = F.array().cast("array<int>")
        moving = written(met.where("template is null").select(*PATH, F.lit("").alias("made"), none.alias("made_slots"), F.lit(None).cast("string").alias("old")))
        added, depth = [], 0
        while True:
            here = F.get("segments", F.lit(depth))
            now = moving.withColumn("seg", here).withColumn("class", url.segment_class(here))
            if now.where("seg is not null").isEmpty():
                break
            touched = now.where("seg is not null").select(*GROUP, "seg").distinct()
            new = written(touched.join(groups, [*GROUP, "seg"], "left_anti"))
            added.append(new)
            # siblings that were there, and those that are now
            had = groups.join(touched.select(*GROUP).distinct(), GROUP, "left_semi").groupBy(*GROUP).agg(F.count("*").alias("_had"))
            counts = touched.select(*GROUP).distinct().join(had, GROUP, "left").join(new.groupBy(*GROUP).agg(F.count("*").alias("_new")), GROUP, "left").na.fill(0, ["_had", "_new"])
            counts = written(counts.withColumn("_many", url.slottable(F.col("class")) & (F.col("_had") + F.col("_new") >= self._siblings)))
            crossing = counts.where("_many").where(F.col("_had").between(1, self._siblings - 1)).select(*GROUP)
            pulled = paths.where(F.size("segments") > depth).withColumns({"made": _prefix("template", F.lit(depth)), "class": url.segment_class(here)})
            pulled = pulled.join(crossing, GROUP, "left_semi").join(moving, PATH, "left_anti")
            pulled = pulled.select(*PATH, "made", F.filter("slots", lambda s: s < depth).alias("made_slots"), F.col("template").alias("old"))
            both = moving.unionByName(written(pulled)).withColumn("seg", here).withColumn("class", url.segment_class(here))
            both = both.join(counts.select(*GROUP, "_many"), GROUP, "left").withColumn("_many", F.coalesce("_many", F.lit(False)))
            step = F.concat("made", F.lit("/"), F.when(F.col("_many"), F.concat(F.lit("{"), "class", F.lit("}"))).otherwise(F.col("seg")))
            moving = written(both.select(*PATH, F.when(F.col("seg").isNull(), F.col("made")).otherwise(step).alias("made"), F.when(F.col("_many"), F.array_append("made_slots", F.lit(depth))).otherwise(F.col("made_slots")).alias("made_slots"), "old"))
            depth += 1

        fresh = moving.select(*PATH, F.when(F.col("made") == "", "/").otherwise(F.col("made")).alias("_template"), F.col("made_slots").alias("_slots"), "old")
        known = met.where("template is not null").select(*PATH, "template", "slots", "observations", "_n")
        # paths that moved may be in the batch too, or not; new ones are
        held = fresh.where("old is not null").join(paths, PATH).join(came, PATH, "left").select(*PATH, "_template", "_slots", (F.col("observations") + F.coalesce("_n", F.lit(0))).alias("observations"))
        first = fresh.where("old is null").join(came, PATH).select(*PATH, "_template", "_slots", F.col("_n").alias("observations"))
        counted = known.join(fresh, PATH, "left_anti").select(*PATH, "template", "slots", F.col("observations") + F.col("_n"))
        self._write("paths", held.union(first).union(counted), version)

        moved = fresh.where("old is not null").select(*PATH, "old", "_template")
        at = moved.select("method", "host", "segments", "old", "_template", F.posexplode("segments").alias("_d", "seg"))
        left = at.select("method", "host", _prefix("old", F.col("_d")).alias("made"), _prefix("_template", F.col("_d")).alias("_now"), url.segment_class(F.col("seg")).alias("class"), "seg")
        gone = left.where("made <> _now").select(*GROUP, "seg").distinct()
        siblings = gone.withColumn("alive", F.lit(False))
        for new in added:
            siblings = siblings.union(new.select(*GROUP, "seg").withColumn("alive", F.lit(True)))
        self._write("groups", siblings, version)

        rewritten = self._read("paths", PATHS, [version])
        touched = written(rewritten.select(*FAMILY).union(moved.select("method", "host", F.col("old").alias("template"))).distinct())
        was = _families(paths.join(touched, FAMILY, "left_semi"))
        after = self._paths([*before, version]).join(hosts, ["method", "host"], "left_semi")
        is_ = _families(after.join(touched, FAMILY, "left_semi"))
        self._write("changes", was.select(F.lit("retract").alias("change"), "*").union(is_.select(F.lit("assert"), "*")), version)
        self._spark.range(1).write.mode("overwrite").parquet(f"{self._folder}/done/{version}")

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        rows.withColumn("version", F.lit(version).cast("long")).toDF(*[c.split()[0] for c in {"paths": PATHS, "groups": GROUPS, "changes": CHANGES}[name].split(", ")]).write.mode("overwrite").parquet(f"{self._folder}/{name}/{version}")


def _families(paths: DataFrame) -> DataFrame:
    return paths.groupBy(*FAMILY).agg(F.count("*").alias("paths"), F.sum("observations").alias("observations"))


def follow_routes(spark: SparkSession, folder: str, schema: StructType | str, state: str, siblings: int = SIBLINGS, interval: str | None = None) -> StreamingQuery:
    """Keeps Routes in `state` up with a folder of files (method, host, segments); without an interval the stream takes what is there and ends."""
    routes = Routes(spark, f"{state}/routes", siblings)
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(routes.apply).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

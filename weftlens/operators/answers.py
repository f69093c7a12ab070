"""Trees of answer files: what a folder holds, and lines of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How much one look shows (fixed values).
MOST_ENTRIES, MOST_LINES = 300, 400


def listed(files: DataFrame, folder: str = "", recursive: bool = False, most: int = MOST_ENTRIES) -> DataFrame:
    """(entry, more): the first `most` entries of a folder of files (path, size), by name; folders end with a slash, files tell their bytes.

    more: how many entries aren't shown.  A recursive list holds the folders between, too.
    """
    start = f"{folder.strip('/')}/" if folder.strip("/") else ""
    below = files.where(F.startswith("path", F.lit(start))).select(F.substring("path", len(start) + 1, 1 << 30).alias("_p"), "size")
    parts = F.split("_p", "/")
    depth = F.size(parts) - 1
    folders = F.transform(F.sequence(F.lit(1), depth if recursive else F.least(depth, F.lit(1))), lambda k: F.concat(F.lit(start), F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/")))
    held = below.where(depth > 0).select(F.explode(folders).alias("entry")).distinct()
    mine = below if recursive else below.where(depth == 0)
    own = mine.select(F.concat(F.lit(start), "_p", F.lit(" ("), F.col("size").cast("string"), F.lit(" bytes)")).alias("entry"))
    rows = held.union(own)
    shown = rows.orderBy("entry").limit(most)
    return shown.crossJoin(F.broadcast(rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))))


def read_lines(lines: DataFrame, path: str, offset: int = 1, limit: int = MOST_LINES) -> DataFrame:
    """Up to `limit` lines (line_no, line) of one file of lines (path, line_no from 0, line), from the offset-th on; never more than MOST_LINES."""
    first = max(offset, 1) - 1
    return lines.where((F.col("path") == path) & F.col("line_no").between(first, first + min(limit, MOST_LINES) - 1)).select("line_no", "line")


def agreement(answers: DataFrame) -> DataFrame:
    """(subject, choice, given, all_given, confidence) of the choice that most answers (subject, choice) give, and its share; of equals the first by name."""
    counts = answers.groupBy("subject", "choice").agg(F.count("*").alias("given"))
    best = Window.partitionBy("subject").orderBy(F.desc("given"), "choice")
    rows = counts.withColumn("_r", F.row_number().over(best)).withColumn("all_given", F.sum("given").over(Window.partitionBy("subject")))
    return rows.where("_r = 1").select("subject", "choice", "given", "all_given", F.round(F.col("given") / F.col("all_given"), 3).alias("confidence"))

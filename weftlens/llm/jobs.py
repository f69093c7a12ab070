"""What several operators need from Spark, besides tables cut from their lineage and connected components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ..lineage import SMALL_TABLE, beside, components, shared_folder, written

__all__ = ["BATCH_BYTES", "SMALL_TABLE", "beside", "components", "fresh", "in_small_batches", "shared_folder", "written"]

#: An Arrow batch that goes to a Python worker ends with the row that passes so many bytes.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """df, whose session cuts Arrow batches at BATCH_BYTES from now on, if it has no limit in bytes of its own.

    By rows alone, 10,000 texts of any length are one batch, which executor and Python worker hold several times.
    """
    if df.sparkSession.conf.get(_BATCH, None) is None:
        df.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def fresh(columns: Iterable[str], name: str) -> str:
    """A column name like `name` that clashes with none of columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name

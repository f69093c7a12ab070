"""Following a growing table of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def follow(spark: SparkSession, folder: str, schema: StructType, state: str, recompute: Callable[[DataFrame], None], interval: str | None = None) -> StreamingQuery:
    """Appends each batch of new files to a table in `state`, and recomputes from all of it.

    New rows can regroup old ones (three siblings make a slot of what were literals), so what depends on all
    rows is computed anew, and only the rows themselves are kept.  Without an interval the stream takes what is there and ends.
    A batch that is repeated after a failure is written over its own part.
    """
    table = f"{state}/rows"

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
        recompute(spark.read.schema(schema).option("basePath", table).parquet(f"{table}/batch=*").drop("batch"))

    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state}/checkpoint")
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

"""Table comparison over a stream of new versions.

Structured Streaming hands each micro-batch to the table diff, which compares
it with the base table and writes its rows under the batch's number, so a
batch that is run again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.table_diff import table_diff
from ..options import TableDiffConfig


def diff_stream(stream: DataFrame, base: DataFrame, output: str, checkpoint: str, config: TableDiffConfig, row: str | None = None, once: bool = True) -> StreamingQuery:
    """Added, modified and unchanged rows of every batch against ``base``.

    A batch holds part of the new version, so rows it lacks are not deleted
    ones and are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = table_diff(base, batch, config, row).where("category <> 'deleted'")
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def debounced(events: DataFrame, key: str, at: str, value: str, quiet: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last value of each burst of events per key: a burst ends after a quiet time."""
    last = F.max_by(value, at).alias(value)
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, quiet)).agg(last, F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.end").alias("ended"), value, "n")

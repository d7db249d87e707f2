"""Incremental ingestion: assertions that arrive as a stream, each counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.assemble import aggregate_evidence

KEY = ["subject_id", "predicate", "object_id", "source_id"]


def new_assertions(stream: DataFrame, time: str | None = None, within: str = "1 day") -> DataFrame:
    """Assertions of a stream without repeats.  With a time column the state is bounded by a watermark."""
    if time:
        return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(KEY)
    return stream.dropDuplicates(KEY)


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True, time: str | None = None, within: str = "1 day") -> StreamingQuery:
    """Appends a stream's new assertions to a Parquet store, exactly once; ``once`` ends when what is there is read.

    With a ``time`` column repeats are looked for ``within`` that time and the state is bounded; without
    one every key is remembered.
    """
    writer = new_assertions(stream, time, within).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def edges_of(spark: SparkSession, path: str) -> DataFrame:
    """The edges that the stored assertions make up."""
    rows = spark.read.parquet(path)
    return aggregate_evidence(rows if "ord" in rows.columns else rows.withColumn("ord", F.struct("source", "source_id")))

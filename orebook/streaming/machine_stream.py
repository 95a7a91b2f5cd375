"""Machine events as a stream: the row-by-row steps need no state.

Priority dedup keeps one row per event over all time and stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orebook.operators.machine import drop_state
from orebook.operators.timegrid import split_interval_by_day


def read_events(spark: SparkSession, folder: str, schema: str, file_format: str = "parquet") -> DataFrame:
    return spark.readStream.format(file_format).schema(schema).load(folder)


def split_stream(events: DataFrame, state: str, end: str, seconds: str) -> DataFrame:
    """Drop the undetermined state and split every interval by day; works on batch and stream."""
    return split_interval_by_day(drop_state(events, state), end, seconds)


def write_available(df: DataFrame, path: str, checkpoint: str):
    """Process what has arrived and stop; the checkpoint makes the next run go on from there."""
    return (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )

"""Event-time windows that run alike on a table and on a stream.

The reference has no streams; these extend it. On a stream give a watermark: late rows beyond it are dropped and
state is freed. On a table the watermark has no effect.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream of events."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(events: DataFrame, watermark: str | None) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", watermark) if watermark else timed


def tumbling(events: DataFrame, length: str, keys: tuple[str, ...] = ("event_type",), watermark: str | None = None) -> DataFrame:
    rows = _timed(events, watermark).groupBy(F.window("ts", length), *keys)
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sliding(events: DataFrame, length: str, step: str, keys: tuple[str, ...] = ("event_type",), watermark: str | None = None) -> DataFrame:
    rows = _timed(events, watermark).groupBy(F.window("ts", length, step), *keys)
    return rows.agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "most")


def sessions(events: DataFrame, gap: str, key: str = "user_id", watermark: str | None = None) -> DataFrame:
    rows = _timed(events, watermark).groupBy(F.session_window("ts", gap), key)
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n", "total")


def first_seen(events: DataFrame, keys: tuple[str, ...], watermark: str) -> DataFrame:
    """Drop rows that repeat the keys within the watermark."""
    return _timed(events, watermark).dropDuplicatesWithinWatermark(list(keys))


def running_latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The latest value of each key so far, as a custom stateful operator: emits a row whenever it changes."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, value = state.get if state.exists else (None, None)
        before = at
        for pdf in batches:
            row = pdf.sort_values(["ts", "event_id"]).iloc[-1]
            if at is None or row["ts"] >= at:
                at, value = row["ts"], float(row["value"])
        if at != before:
            state.update((at, value))
            yield pd.DataFrame({key: [k[0]], "ts": [at], "value": [value]})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(key).applyInPandasWithState(update, f"{key} long, ts timestamp, value double", "ts timestamp, value double", "update", "NoTimeout")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to Parquet, once, until the input is used up."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert(stream: DataFrame, folder: str, keys: tuple[str, ...], checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key: each batch is merged into a new version of a table, then takes its place."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old, new = f"{folder}/v{number - 1}", f"{folder}/v{number}"
        rows = batch
        if number and Path(old).exists():
            rows = spark.read.parquet(old).join(batch.select(*keys), list(keys), "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(new)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()

"""Structured Streaming over call logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from weftwork.sources.files import TELEMETRY


def follow(spark: SparkSession, path: str, schema: str = TELEMETRY, max_files: int = 100) -> DataFrame:
    """New records of a folder of JSON-lines files; the query's checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def follow_parquet(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; called again, it goes on where it stopped."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """Rows per key and window; a window is given out once its end is ``late`` behind. (An addition, the reference has no windows.)"""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def emit_gapped(rows: DataFrame, key: str, at: str, gap_s: float) -> DataFrame:
    """(key, at) of rows at least ``gap_s`` after the last that was given out for their key, over all batches.

    Each batch's times of a key are ordered; state is the last time given out.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        kept = []
        for t in sorted(t for f in frames for t in f["_at"]):
            if t - last >= gap_s:
                kept.append(t)
                last = t
        if last > float("-inf"):
            state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(kept), at: kept})

    source = rows.select(F.col(key), F.col(at).cast("double").alias("_at"))
    kind = rows.schema[key].dataType.simpleString()
    return source.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {at} double", "last double", "append", GroupStateTimeout.NoTimeout)


def append_unseen(df: DataFrame, store: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Appends each batch's rows whose keys the store does not have; a batch that is run again adds nothing."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            new = new.join(spark.read.parquet(store).select(*keys), keys, "left_anti")
        except Exception as e:  # the store is made by the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(store)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

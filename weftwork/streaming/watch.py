"""Streams with a memory: suppression that forgets, watched fingerprints, and scans of what was not scanned yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def suppressed(rows: DataFrame, key: str, at: str, gap_s: float, late: str = "10 minutes") -> DataFrame:
    """(key, at) of rows at least ``gap_s`` after the last that was given out for their key, over all batches.

    A row that is given out starts the time anew. Once the watermark has passed the end of a key's time nothing
    that comes can be suppressed by it, so the key's state goes. Rows later than ``late`` are dropped.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else float("-inf")
        kept = []
        for t in sorted(t for f in frames for t in f["_t"]):
            if t - last >= gap_s:
                kept.append(t)
                last = t
        state.update((last,))
        state.setTimeoutTimestamp(max(int((last + gap_s) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(kept), "_t": kept})

    source = rows.select(key, F.col(at).cast("timestamp").alias("_at"), F.col(at).cast("timestamp").cast("double").alias("_t")).withWatermark("_at", late)
    kind = rows.schema[key].dataType.simpleString()
    out = source.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, _t double", "last double", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros(F.round(F.col("_t") * 1e6).cast("long")).alias(at))


def _before(spark: SparkSession, store: str, schema: str, batch: int) -> DataFrame:
    """What the batches before this one put into a store."""
    return spark.read.schema(f"{schema}, batch long").parquet(store).where(F.col("batch") < batch)


def _made(spark: SparkSession, store: str, schema: str) -> None:
    """An empty first batch, so that a store is there to be read."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{store}/batch=-1")


def _run(df: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


MARKS = "path string, mark string, status string"


def watch(rows: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Changes of fingerprints (path, mark; a null mark: the file is gone), batch by batch, as ``store``: (path, mark, status, batch).

    The last row of a path is what is known of it. Each batch writes a folder of its own, so one that is run again
    after a loss writes the same once more and adds nothing. Within a batch the largest mark of a path counts.
    """
    _made(rows.sparkSession, store, MARKS)

    def put(batch: DataFrame, k: int) -> None:
        known = _before(batch.sparkSession, store, MARKS, k).groupBy("path").agg(F.max_by("mark", "batch").alias("old"))
        new = batch.groupBy("path").agg(F.max("mark").alias("mark")).join(known, "path", "left")
        status = F.when(F.col("old").isNull(), F.when(F.col("mark").isNotNull(), "added")).when(F.col("mark").isNull(), "removed").when(F.col("mark") != F.col("old"), "changed")
        new.select("path", "mark", status.alias("status")).where("status IS NOT NULL").write.mode("overwrite").parquet(f"{store}/batch={k}")

    return _run(rows, put, checkpoint)


def changes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(f"{MARKS}, batch long").parquet(store)


SCANNED = "path string, sig string"


def shadow_scan(calls: DataFrame, scan: Callable[[DataFrame], DataFrame], store: str, found: str, checkpoint: str) -> StreamingQuery:
    """Scans what calls (path, sig) name and what was not scanned with that signature yet; findings go to ``found``, what was scanned to ``store``.

    ``scan`` takes (path, sig) rows, each once, and returns findings. The findings are written before their files count as
    scanned, both in a folder of the batch, so a lost run is done again and never twice.
    """
    _made(calls.sparkSession, store, SCANNED)

    def put(batch: DataFrame, k: int) -> None:
        done = _before(batch.sparkSession, store, SCANNED, k).select("path", "sig")
        new = batch.where("path IS NOT NULL AND sig IS NOT NULL").select("path", "sig").distinct().join(done, ["path", "sig"], "left_anti")
        scan(new).write.mode("overwrite").parquet(f"{found}/batch={k}")
        new.write.mode("overwrite").parquet(f"{store}/batch={k}")

    return _run(calls, put, checkpoint)

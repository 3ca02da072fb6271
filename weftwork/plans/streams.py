"""Streams run to the end of what is there, and their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.operators.lineage import shared_folder
from weftwork.plans.registry import query, table
from weftwork.streaming import watch


def _dealt(spark, sf_dir, columns, parts=3):
    """The events as a folder of files, written one after the other in the order of time, as a stream takes them."""
    at, e = shared_folder(spark, "stream"), table(spark, sf_dir, "events")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * k / parts for k in range(1, parts)]
    for a, b in zip([None, *cuts], [*cuts, None], strict=True):
        inside = (F.lit(True) if a is None else F.col("ts") >= F.lit(a)) & (F.lit(True) if b is None else F.col("ts") < F.lit(b))
        e.where(inside).select(*columns).write.mode("append").parquet(f"{at}/in")
    return at


def _stream(spark, at):
    return spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 4).parquet(f"{at}/in")


@query(
    "stream_suppression",
    """
    WITH RECURSIVE t AS (SELECT user_id, epoch(ts) AS t0 FROM events),
    kept AS (SELECT user_id, min(t0) AS t0 FROM t GROUP BY user_id
             UNION ALL SELECT k.user_id, (SELECT min(t.t0) FROM t WHERE t.user_id = k.user_id AND t.t0 - k.t0 >= 86400) FROM kept k WHERE k.t0 IS NOT NULL)
    SELECT user_id, t0 FROM kept WHERE t0 IS NOT NULL""",
)
def stream_suppression(spark, sf_dir):
    """One event of each user a day, over files in the order of time."""
    at = _dealt(spark, sf_dir, ["user_id", "ts"])
    rows = _stream(spark, at).withColumn("ts", F.col("ts").cast("timestamp"))
    # a part's files are taken in no sure order, so rows may be as late as the table is long
    out = watch.suppressed(rows, "user_id", "ts", 86400, "36500 days")
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").select("user_id", F.col("ts").cast("double").alias("t0"))


@query("stream_shadow_scan", "SELECT event_type AS path, count(DISTINCT user_id % 5) AS scans FROM events GROUP BY event_type")
def stream_shadow_scan(spark, sf_dir):
    """Each pair of a kind of event and a signature is scanned once, however often it is called."""
    at = _dealt(spark, sf_dir, ["event_type", "user_id"])
    calls = _stream(spark, at).select(F.col("event_type").alias("path"), (F.col("user_id") % 5).cast("string").alias("sig"))
    watch.shadow_scan(calls, lambda new: new.withColumn("n", F.lit(1)), f"{at}/scanned", f"{at}/found", f"{at}/cp").awaitTermination()
    return spark.read.parquet(f"{at}/found").groupBy("path").agg(F.count("*").alias("scans"))

"""Streams over several runs: what is kept, what is forgotten, and batches that are run again."""

import datetime
import os

from pyspark.sql import functions as F

from weftwork.streaming import watch

T0 = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_suppression_over_runs_and_state_that_goes(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "k string, at timestamp"
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = lambda: spark.readStream.schema(schema).parquet(f"{src}/*")
    state = []

    def run():
        q = watch.suppressed(rows(), "k", "at", 100, "10 seconds").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        state.extend(o.numRowsTotal for o in q.lastProgress.stateOperators)
        return sorted((r.k, (r["at"].astimezone(datetime.timezone.utc) - T0).total_seconds()) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(spark, src, "1", [("a", at(0)), ("a", at(50)), ("b", at(10)), ("a", at(100.5))], schema)
    assert run() == [("a", 0.0), ("a", 100.5), ("b", 10.0)]
    put(spark, src, "2", [("a", at(150)), ("b", at(109)), ("b", at(110))], schema)
    assert run() == [("a", 0.0), ("a", 100.5), ("b", 10.0), ("b", 110.0)]
    assert run() == [("a", 0.0), ("a", 100.5), ("b", 10.0), ("b", 110.0)]
    put(spark, src, "3", [("c", at(5000))], schema)
    run()
    put(spark, src, "4", [("c", at(5001)), ("a", at(5002))], schema)
    assert run()[-1] == ("c", 5000.0)
    # the watermark has passed the ends of a's and b's times: only what came since is held
    put(spark, src, "5", [("d", at(9000))], schema)
    run()
    put(spark, src, "6", [("d", at(9001))], schema)
    run()
    assert state[-1] < max(state) and state[-1] <= 2


def lose_last_commit(checkpoint):
    commits = sorted((int(f) for f in os.listdir(f"{checkpoint}/commits") if f.isdigit()))
    os.remove(f"{checkpoint}/commits/{commits[-1]}")
    os.remove(f"{checkpoint}/commits/.{commits[-1]}.crc")


def test_watched_fingerprints(spark, tmp_path):
    src, store, cp, schema = str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"), "path string, mark string"
    run = lambda: watch.watch(spark.readStream.schema(schema).parquet(f"{src}/*"), store, cp).awaitTermination()
    got = lambda: sorted((r.batch, r.path, r.mark or "", r.status) for r in watch.changes(spark, store).collect())
    put(spark, src, "1", [("a", "1"), ("b", "1"), ("b", "1"), ("x", None)], schema)
    run()
    first = [(0, "a", "1", "added"), (0, "b", "1", "added")]
    assert got() == first
    put(spark, src, "2", [("a", "1"), ("b", "2"), ("c", "1")], schema)
    run()
    second = [*first, (1, "b", "2", "changed"), (1, "c", "1", "added")]
    assert got() == second
    lose_last_commit(cp)
    run()
    assert got() == second
    put(spark, src, "3", [("b", None), ("c", "1")], schema)
    run()
    put(spark, src, "4", [("b", "2")], schema)
    run()
    assert got() == [*second, (2, "b", "", "removed"), (3, "b", "2", "added")]


def test_shadow_scan_scans_once(spark, tmp_path):
    src, cp, schema = str(tmp_path / "in"), str(tmp_path / "cp"), "path string, sig string, tool string"
    run = lambda: watch.shadow_scan(spark.readStream.schema(schema).parquet(f"{src}/*"), lambda new: new.withColumn("finding", F.concat("path", "sig")), str(tmp_path / "scanned"), str(tmp_path / "found"), cp).awaitTermination()
    got = lambda: sorted((r.path, r.sig, r.finding) for r in spark.read.parquet(str(tmp_path / "found")).collect())
    put(spark, src, "1", [("a", "1", "t"), ("a", "1", "u"), (None, "1", "t"), ("b", None, "t")], schema)
    run()
    assert got() == [("a", "1", "a1")]
    put(spark, src, "2", [("a", "1", "t"), ("a", "2", "t"), ("b", "1", "t")], schema)
    run()
    want = [("a", "1", "a1"), ("a", "2", "a2"), ("b", "1", "b1")]
    assert got() == want
    lose_last_commit(cp)
    run()
    assert got() == want

"""Readers of logs, texts and notes, and stores over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records of a call log: tool calls, heartbeats and resource samples in one wide row.
TELEMETRY = "kind STRING, ts DOUBLE, tool STRING, args STRING, wall_ms DOUBLE, status STRING, err STRING, loop STRING, cycle_ms DOUBLE, pid INT, rss_kb BIGINT, cpu_pct DOUBLE"
CHAT = "agent STRING, source STRING, ts DOUBLE, title STRING, text STRING"
SKIPPED_DIRS = (".git", "node_modules", "target", "__pycache__", ".venv", "dist", "build")


def read_jsonl(spark: SparkSession, path: str, schema: str = TELEMETRY) -> DataFrame:
    """Lines of JSON with a declared schema; a bad line keeps its text in ``_corrupt_record``, blank lines are left out."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", full, {"mode": "PERMISSIVE"}).alias("r"), "value").select("r.*")


def line_counts(rows: DataFrame) -> DataFrame:
    """(good, bad) lines of what ``read_jsonl`` gives."""
    bad = F.col("_corrupt_record").isNotNull()
    return rows.agg(F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file with one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tree(spark: SparkSession, path: str, suffixes: list[str] | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """(path, ext, size, text) of the text files below a folder, without skipped folders and larger files; undecodable bytes are replaced."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    f = f.where((F.col("length") <= most_bytes) & ~F.rlike("path", F.lit("/(" + "|".join(d.replace(".", "\\.") for d in SKIPPED_DIRS) + ")/")))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    f = f.select("path", ext.alias("ext"), F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    return f.where(F.col("ext").isin(suffixes)) if suffixes else f


def tail(rows: DataFrame, n: int, at: str = "ts", seq: str = "seq") -> DataFrame:
    """The last ``n`` records, oldest first."""
    return rows.orderBy(F.desc(at), F.desc(seq)).limit(n).orderBy(at, seq)


def front_matter(files: DataFrame, agent: str) -> DataFrame:
    """Chat rows of Markdown files with a front matter (``key: value`` lines between two ``---``)."""
    head = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    field = lambda k: F.trim(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1))
    return files.select(F.lit(agent).alias("agent"), F.col("path").alias("source"), F.try_to_number(field("ts"), F.lit("9999999999.999")).cast("double").alias("ts"), F.substring(field("title"), 1, 200).alias("title"), F.substring(body, 1, 4000).alias("text"))


def editor_entries(files: DataFrame, agent: str, most: int = 5) -> DataFrame:
    """Chat rows of ``entries.json`` files: at most ``most`` entries a file, milliseconds to seconds."""
    entries = F.from_json("text", "entries array<struct<id:string,timestamp:double,source:string>>")["entries"]
    e = files.select("path", F.explode(F.slice(entries, 1, most)).alias("e"))
    return e.select(F.lit(agent).alias("agent"), F.col("path").alias("source"), (F.col("e.timestamp") / 1000).alias("ts"), F.substring(F.coalesce("e.source", F.lit("")), 1, 200).alias("title"), F.col("e.id").alias("text"))


def with_hash(rows: DataFrame) -> DataFrame:
    """Chat rows with the key of idempotent appends: 16 digits of the SHA-256 of their text."""
    return rows.withColumn("hash", F.substring(F.sha2("text", 256), 1, 16))


def append_by_day(rows: DataFrame, path: str, at: Column) -> None:
    """Appends to a store that is partitioned by day, so that old days can be read, moved or dropped alone."""
    rows.withColumn("day", F.to_date(at)).write.mode("append").partitionBy("day").parquet(path)

"""Small operators over records: filters, notes, traces, evidence, health and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftwork.operators.relations import first_by

#: What an item takes from a health score.
HEALTH_WEIGHTS = {"high": 8, "medium": 4, "low": 2, "info": 0}


def keep_rules(issues: DataFrame, rules: list[str], column: str = "rule") -> DataFrame:
    """The issues of the named rules; of all where none is named."""
    return issues.where(F.col(column).isin(rules)) if rules else issues


def set_union(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """(by, values): the distinct values of each key, sorted."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(values)).alias(values))


def directory_summary(files: DataFrame, path_col: str, symbols_col: str, per_file: int = 10, most: int = 20) -> DataFrame:
    """(dir, files, symbols) of the ``most`` directories with most files; at most ``per_file`` symbols of a file count."""
    folder = F.regexp_extract(path_col, "^(.*)/[^/]*$", 1)
    rows = files.select(F.when(folder == "", ".").otherwise(folder).alias("dir"), F.least(F.col(symbols_col), F.lit(per_file)).alias("n"))
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.sum("n").alias("symbols")).orderBy(F.desc("files"), "dir").limit(most)


def health(items: DataFrame, by: str, severity: str = "severity") -> DataFrame:
    """(by, items, score): 100 less the weights of a root's items, 0 at least."""
    w = reduce(lambda c, kv: F.when(F.col(severity) == kv[0], kv[1]).otherwise(c), HEALTH_WEIGHTS.items(), F.lit(0))
    return items.groupBy(by).agg(F.count("*").alias("items"), F.greatest(F.lit(100) - F.sum(w), F.lit(0)).alias("score"))


def dependents(definitions: DataFrame, references: DataFrame, changed: DataFrame, per_unit: int = 8, listed: int = 20) -> DataFrame:
    """(unit, depends_on): units that refer to symbols of changed units, themselves left out.

    definitions, references: (unit, symbol); changed: (unit). Of a changed unit its first ``per_unit`` symbols by name count.
    """
    own = definitions.join(changed, "unit", "left_semi").distinct()
    own = first_by(own, ["unit"], [F.col("symbol")], min(per_unit, listed)).select(F.col("unit").alias("source"), "symbol")
    hits = references.distinct().join(own, "symbol").where(F.col("unit") != F.col("source"))
    return set_union(hits.select("unit", F.col("source").alias("depends_on")).distinct(), ["unit"], "depends_on")


def evidence(failures: DataFrame, sources: list[tuple[int, DataFrame]], key: str, most: int = 5) -> DataFrame:
    """(key, rank, at, what): what speaks for each failure, by the fixed rank of its source and then the newest, ``most`` of a failure.

    failures: (key); sources: (rank, rows of (key, at, what)). Each source is cut to its newest ``most`` of a key before they are united.
    """
    parts = [first_by(s.join(failures.select(key).distinct(), key, "left_semi"), [key], [F.desc("at"), F.col("what")], most).select(key, F.lit(rank).alias("rank"), "at", "what") for rank, s in sources]
    return first_by(reduce(DataFrame.unionByName, parts), [key], [F.col("rank"), F.desc("at"), F.col("what")], most)


def causal_chain(changes: DataFrame, calls: DataFrame, last_changes: int = 20, last_calls: int = 30, most: int = 15) -> DataFrame:
    """(kind, at, id, what): the newest changes and then the newest calls, ``most`` in all; rows are (at, id, what)."""
    newest = lambda df, n, kind, order: df.orderBy(F.desc("at"), F.desc("id")).limit(n).select(F.lit(kind).alias("kind"), F.lit(order).alias("o"), "at", "id", "what")
    both = newest(changes, last_changes, "commit", 0).unionByName(newest(calls, last_calls, "tool_call", 1))
    return both.orderBy("o", F.desc("at"), F.desc("id")).limit(most).drop("o")


def failures(calls: DataFrame, word: str, summary: str, ok: str) -> DataFrame:
    """Calls whose summary holds a word in any case, or that went wrong."""
    return calls.where(F.contains(F.lower(summary), F.lit(word.lower())) | (~F.col(ok)))


def note_counts(notes: DataFrame, kind: str, tag: str) -> DataFrame:
    """(what, name, n): notes of each kind, and of each tag that isn't empty."""
    kinds = notes.groupBy(F.col(kind).alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), "name", "n")
    tags = notes.where((F.col(tag).isNotNull()) & (F.col(tag) != "")).groupBy(F.col(tag).alias("name")).agg(F.count("*").alias("n")).select(F.lit("tag").alias("what"), "name", "n")
    return kinds.unionByName(tags)


def newest(rows: DataFrame, at: str, key: str, n: int, where: Column | None = None) -> DataFrame:
    """The newest ``n`` rows, ties by the greatest key."""
    return (rows if where is None else rows.where(where)).orderBy(F.desc(at), F.desc(key)).limit(n)


def collected(found: DataFrame, store: DataFrame, agent: str, key: str) -> DataFrame:
    """(agent, found, new): records of each agent, and how many distinct ones the store does not have."""
    fresh = found.join(store.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    return fresh.groupBy(agent).agg(F.count("*").alias("found"), F.count_distinct(F.when(F.col("_in").isNull(), F.col(key))).alias("new"))


def after(rows: DataFrame, cursor: int, order: str, most: int) -> DataFrame:
    """Rows behind a cursor, which is a count of rows in their order, ``most`` at a time.

    A cursor counts rows of one log, which is numbered in one task; a log that is long is cut by its order's bounds first.
    """
    numbered = rows.withColumn("seq", F.row_number().over(Window.orderBy(order)))
    return numbered.where((F.col("seq") > cursor) & (F.col("seq") <= cursor + most))


def activity(events: DataFrame, now: Column, is_tool: Column, is_write: Column, at: str, key: str, window: int = 30, tail: int = 50) -> DataFrame:
    """(age, active, last_write) from the last ``tail`` events: whole seconds since the last tool event, whether they are fewer than ``window``, and the last write."""
    last = events.orderBy(F.desc(at), F.desc(key)).limit(tail)
    order = F.struct(at, key)
    seen = last.agg(F.max(F.when(is_tool, F.col(at))).alias("t"), F.max_by(F.when(is_tool & is_write, F.col(key)), F.when(is_tool & is_write, order)).alias("last_write"))
    age = F.greatest(F.lit(0), F.floor(F.unix_micros(now.cast("timestamp")) / 1000000 - F.unix_micros(F.col("t").cast("timestamp")) / 1000000).cast("long"))
    return seen.select(F.coalesce(age, F.lit(0).cast("long")).alias("age"), F.coalesce(age < window, F.lit(False)).alias("active"), "last_write")


def predictions(successors: DataFrame, allowed: list[str], fallbacks: list[str], most: int = 3) -> DataFrame:
    """(tool, next, rank): the likeliest successors (tool, next, rank) that are allowed, then fixed fallbacks, ``most`` in all."""
    known = successors.where(F.col("next").isin(allowed)).select("tool", "next", F.col("rank").alias("o"))
    rest = successors.select("tool").distinct().select("tool", F.posexplode(F.array(*map(F.lit, fallbacks))).alias("k", "next")).select("tool", "next", (F.col("k") + 1_000_000).alias("o"))
    order = Window.partitionBy("tool").orderBy("o")
    return known.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("o")


def flattened(text: Column) -> Column:
    """The leaves of a JSON array of arrays of any depth, in order, as text; strings lose their quotes but keep their escapes."""
    leaves = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"|[^\s,\[\]"]+)'), 1)
    return F.transform(leaves, lambda x: F.regexp_replace(x, '^"|"$', ""))

"""Files made from parts whose lines vary by number, and the findings that they must give, as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.plans.registry import table


def slot_files(spark, sf_dir, lines: dict[str, list]):
    """(path, text): part k is file ``src/q<k>.<suffix>`` of the (k mod n)-th of the n suffixes; of a list of lines it has the (k div n) mod its length-th."""
    k, n = F.col("p_partkey"), len(lines)
    q = F.floor(k / n)
    line = lambda x: F.lit(x) if isinstance(x, str) else F.element_at(F.array(*map(F.lit, x)), (q % len(x) + 1).cast("int"))
    texts = [F.concat_ws("\n", *map(line, x)) for x in lines.values()]
    at = (k % n + 1).cast("int")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/q"), k.cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, lines)), at)).alias("path"), F.element_at(F.array(*texts), at).alias("text"))


def slot_keys(lines: dict[str, list]) -> str:
    """SQL of the table k (k, q, lang, file): the same numbers, suffixes and paths."""
    n, names = len(lines), ", ".join(f"'{s}'" for s in lines)
    return f"k AS (SELECT *, 'src/q' || k || '.' || lang AS file FROM (SELECT p_partkey AS k, p_partkey // {n} AS q, ([{names}])[1 + p_partkey % {n}] AS lang FROM part))"


def expected(rows: list[tuple]) -> str:
    """SQL of findings (file, line, rule, severity and what else) from (suffix, condition on q, line, rule, severity, *named values)."""
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return " UNION ALL ".join(
        f"SELECT file, {line} AS line, {quote(rule)} AS rule, {quote(severity)} AS severity{''.join(f', {quote(v)} AS {c}' for c, v in more)} FROM k WHERE lang = '{lang}' AND {when}" for lang, when, line, rule, severity, *more in rows
    )

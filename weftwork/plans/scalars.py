"""Scalar functions over the part and lineitem tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftwork.functions import scalars as C
from weftwork.plans.registry import query, table


@query("arithmetic", """SELECT p_partkey, p_size + 3 AS a, p_size - 7 AS s, p_size * 2 AS m, abs(p_size - 25) AS ab, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / (p_size % 5) END AS d,
    CASE WHEN p_size <= 10 THEN round(pow(p_size, 3), 6) ELSE NULL END AS p, round(sqrt(p_size), 9) AS sq, round(p_size * 9 / 5 + 32, 9) AS f, round((p_size - 32) * 5 / 9, 9) AS c FROM part""")
def arithmetic(spark, sf_dir):
    n = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", (n + 3).alias("a"), (n - 7).alias("s"), (n * 2).alias("m"), F.abs(n - 25).alias("ab"), C.div(F.col("p_retailprice"), n % 5).alias("d"),
        F.round(F.when(n <= 10, C.power(n, F.lit(3))), 6).alias("p"), F.round(C.sqrt(n), 9).alias("sq"), F.round(C.celsius_to_fahrenheit(n), 9).alias("f"), F.round(C.fahrenheit_to_celsius(n), 9).alias("c"),
    )


@query("string_functions", "SELECT p_partkey, reverse(p_name) AS r, upper(p_name) AS u, lower(p_brand) AS l, p_type = reverse(p_type) AS pal, 'abcba' || (p_size % 2) = reverse('abcba' || (p_size % 2)) AS pal2 FROM part")
def string_functions(spark, sf_dir):
    odd = F.concat(F.lit("abcba"), F.col("p_size") % 2)
    return table(spark, sf_dir, "part").select("p_partkey", F.reverse("p_name").alias("r"), F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), C.is_palindrome(F.col("p_type")).alias("pal"), C.is_palindrome(odd).alias("pal2"))


@query("shapes", "SELECT p_partkey, round(pi() * p_size * p_size, 6) AS area, 2 * (p_size + 4) AS perimeter FROM part")
def shapes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(C.circle_area(F.col("p_size")), 6).alias("area"), C.rectangle_perimeter(F.col("p_size"), F.lit(4)).alias("perimeter"))


@query("primes", "SELECT p_partkey FROM part WHERE p_partkey > 1 AND NOT EXISTS (SELECT 1 FROM range(2, 45) t(d) WHERE d * d <= p_partkey AND p_partkey % d = 0)")
def primes(spark, sf_dir):
    return table(spark, sf_dir, "part").where(C.is_prime(F.col("p_partkey"))).select("p_partkey")


@query("factorials", "SELECT p_partkey, CAST(factorial(p_size % 34) AS VARCHAR) AS f FROM part")
def factorials(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.factorial(F.col("p_size") % 34).alias("f"))


@query("fibonacci_numbers", "WITH RECURSIVE f AS (SELECT 0 AS n, 0::BIGINT AS a, 1::BIGINT AS b UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 60) SELECT p_partkey, CAST(a AS VARCHAR) AS f FROM part JOIN f ON n = p_size")
def fibonacci_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.fibonacci(F.col("p_size")).alias("f"))


@query("list_functions", """
    WITH g AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, l_partkey, l_suppkey) AS q FROM lineitem GROUP BY 1)
    SELECT l_orderkey, list_sort(q) AS sorted, len(list_distinct(q)) AS n_distinct, list_avg(q) AS mean, list_median(q) AS median, coalesce(list_position(list_sort(q), 10), 0) - 1 AS at FROM g""".replace("AS at FROM", "AS found_at FROM"))
def list_functions(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("q"))
    return g.select("l_orderkey", F.array_sort("q").alias("sorted"), F.size(F.array_distinct("q")).cast("long").alias("n_distinct"), C.mean(F.col("q")).alias("mean"), C.median(F.col("q")).alias("median"), C.binary_search(F.col("q"), F.lit(10)).cast("int").alias("found_at"))


@query("hashes", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query("days", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def days(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))

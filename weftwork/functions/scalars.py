"""Scalar functions with guards. Where the input is outside a function's range the row gets NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def power(base: Column, exponent: Column) -> Column:
    return F.when((F.abs(exponent) <= 1000) & (F.abs(base) <= 1e9), F.pow(base, exponent))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def celsius_to_fahrenheit(c: Column) -> Column:
    return c * 9 / 5 + 32


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def is_palindrome(s: Column) -> Column:
    return s == F.reverse(s)


def circle_area(r: Column) -> Column:
    return F.when(r >= 0, F.pi() * r * r)


def rectangle_perimeter(a: Column, b: Column) -> Column:
    return F.when((a >= 0) & (b >= 0), 2 * (a + b))


def is_prime(n: Column) -> Column:
    """Trial division up to the square root, for n up to 10 million."""
    root = F.greatest(F.lit(2), F.floor(F.sqrt(n.cast("double"))).cast("int"))
    return F.when(n <= 10_000_000, F.when(n < 2, False).when(n < 4, True).otherwise(~F.exists(F.sequence(F.lit(2), root), lambda d: n % d == 0)))


def binary_search(values: Column, x: Column) -> Column:
    """Index from 0 in the sorted array, -1 if absent; the first of equals."""
    return F.array_position(F.array_sort(values), x) - 1


def mean(values: Column) -> Column:
    return F.when((F.size(values) > 0) & (F.size(values) <= 100_000), F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when((n > 0) & (n <= 100_000), middle)


@F.pandas_udf(T.StringType())
def _fibonacci(n):
    """Each batch walks the sequence once, as far as its greatest number, and keeps what it needs."""
    asked = {int(x) for x in n if x is not None and x == x and 0 <= x <= 20000}
    found, a, b = {}, 0, 1
    for k in range(max(asked, default=-1) + 1):
        if k in asked:
            found[k] = str(a)
        a, b = b, a + b
    return n.map(lambda x: found.get(int(x)) if x is not None and x == x else None)


def factorial(n: Column) -> Column:
    """Exact, as text, for n up to 1000: by the built-in function up to 20, and from a table beyond."""
    table, product = [], math.factorial(20)
    for k in range(21, 1001):
        product *= k
        table.append(F.lit(str(product)))
    return F.when(n.between(0, 20), F.factorial(n.cast("int")).cast("string")).when(n.between(21, 1000), F.element_at(F.array(*table), n.cast("int") - 20))


def fibonacci(n: Column) -> Column:
    """Exact, as text, for n up to 20 000."""
    return _fibonacci(n)

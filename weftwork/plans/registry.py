"""Registry: query name -> (DataFrame function, DuckDB oracle or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftwork.session import ship

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is DuckDB SQL over the same tables, None where SQL can't say it."""

    def put(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if oracle is not None:
            _ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def all_queries() -> dict[str, Query]:
    from weftwork.plans import catalog  # noqa: F401  its modules register themselves

    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    all_queries()
    return dict(_ORACLES)

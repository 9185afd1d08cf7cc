"""Queries by name, each with the SQL that an independent engine can check it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain_rounding(sql: str) -> str:
    """round(x, d) as the library rounds: floor(x * 10 ** d + 0.5) / 10 ** d in doubles."""
    at = sql.find("round(")
    while at >= 0:
        depth, i, comma = 0, at + 6, -1
        while depth or sql[i] != ")":
            depth += (sql[i] in "([") - (sql[i] in ")]")
            comma = i if sql[i] == "," and not depth else comma
            i += 1
        scale = f"1e{sql[comma + 1 : i].strip()}::DOUBLE"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]})::DOUBLE * {scale} + 0.5) / {scale}){sql[i + 1 :]}"
        at = sql.find("round(")
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = plain_rounding(sql)
        return f

    return add

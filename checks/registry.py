"""Registry of checked queries and small helpers shared by both sides."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldflux.session import tune

QUERIES = {}
SQL = {}
CTES = {}


def check(name: str, sql: str | None = None):
    """Register a Spark query, with its SQL where one exists."""

    def add(fn):
        def query(spark, sf_dir):
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            SQL[name] = doubles(with_ctes(sql))
        return fn

    return add


def doubles(sql: str) -> str:
    """Decimal literals are DECIMAL in DuckDB: make them DOUBLE."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+(?:[eE][-+]?\d+)?)(?![\w.'])", r"CAST(\1 AS DOUBLE)", sql)


def with_ctes(sql: str) -> str:
    """Prefix the named sub-queries that `sql` uses, in the order they were defined."""
    need: set[str] = set()

    def visit(text):
        for name, body in CTES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(body)

    visit(sql)
    if not need:
        return sql
    parts = [f"{n} AS MATERIALIZED ({b})" for n, b in CTES.items() if n in need]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def rounded(cols: list[str], n: int = 6) -> str:
    """SQL select list of columns rounded to n digits; adding zero removes negative zero."""
    return ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c in cols)


def rnd(df: DataFrame, keys: list[str], cols: list[str], n: int = 6) -> DataFrame:
    """The same on the Spark side."""
    return df.select(*keys, *[F.round(F.col(c), n).alias(c) for c in cols])

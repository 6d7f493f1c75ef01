"""Registry of queries. Each one is a function over the tables, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.tables import VIEWS_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable:
    """Registers a function over Tables under its name. views: names of derived views that the SQL uses."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__doc__, run.__name__ = f.__doc__, f.__name__
        QUERIES[f.__name__] = run
        if sql:
            needed = views.split()
            heads = ", ".join(f"{v} AS ({VIEWS_SQL[v]})" for v in needed)
            body = sql.strip()
            if heads:
                body = f"WITH {heads}, {body[5:].lstrip()}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
            SQL[f.__name__] = body
        return f

    return register

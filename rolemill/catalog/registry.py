"""The list of registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolemill.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same result in DuckDB SQL."""

    def keep(build):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        run.__name__ = name
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def projection(name: str, view, ids: list[str], outputs: dict):
    """Register a row-wise query: output name → (column builder, SQL expression)."""
    from rolemill.catalog import views

    fields = [f"{i}" for i in ids] + [f"{sql} AS {out}" for out, (_, sql) in outputs.items()]
    statement = views.with_views(view.__name__) + f" SELECT {', '.join(fields)} FROM {view.__name__}"

    @query(name, statement)
    def run(spark, sf_dir):
        columns = [build().alias(out) for out, (build, _) in outputs.items()]
        return view(spark, sf_dir).select(*ids, *columns)

    return run

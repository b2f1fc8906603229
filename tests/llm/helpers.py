"""Small frames, and a DuckDB side for them."""

import duckdb
import pandas as pd

from tests.oracle import difference


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def same_as_sql(df, sql, **tables):
    """'' if the frame has the rows of the SQL over the given (rows, columns with types)."""
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            marks = ", ".join("?" for _ in rows[0])
            con.executemany(f"INSERT INTO {name} VALUES ({marks})", rows)
    return difference(df, con, sql)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def pandas_of(df) -> pd.DataFrame:
    return df.toPandas()

"""Name -> (Spark callable, SQL text) registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.queries.sql_types import LONG_COLUMNS
from postmill.session import tune
from postmill.sources import bindings

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}


@dataclass(frozen=True)
class Tables:
    """The given tables of one folder, raw or posting-shaped."""

    spark: SparkSession
    sf_dir: str

    def __getattr__(self, name: str) -> DataFrame:
        if name not in bindings.TABLES:
            raise AttributeError(name)
        return bindings.table(self.spark, self.sf_dir, name)

    def postings(self, *names: str, by_order: bool = False) -> DataFrame:
        return bindings.postings(self.spark, self.sf_dir, *names, by_order=by_order)


def tidy(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, dates and arrays as text, for comparison."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def with_views(sql: str) -> str:
    """Put the posting view in front of a statement that reads it."""
    sql = sql.strip()
    if "postings" not in sql:
        return sql
    view = f"WITH postings AS ({bindings.POSTINGS_SQL.strip()})"
    if sql[:5].upper() == "WITH ":
        return f"{view}, {sql[5:]}"
    return f"{view} {sql}"


def as_long(sql: str, columns: Sequence[str]) -> str:
    if not columns:
        return sql
    casts = ", ".join(f'CAST("{c}" AS BIGINT) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({casts}) FROM ({sql})"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` is its DuckDB counterpart."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in SPARK:
            raise ValueError(f"duplicate query {name}")
        MODULE_OF[name] = fn.__module__.rsplit(".", 1)[-1]
        SPARK[name] = lambda spark, sf_dir: tidy(fn(Tables(tune(spark), sf_dir)))
        if sql is not None:
            SQL[name] = as_long(with_views(sql), LONG_COLUMNS.get(name, ()))
        return fn

    return wrap

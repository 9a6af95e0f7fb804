"""How a query and its checking SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equityjobs.sources.adapters import Tables, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Flat, engine-neutral columns: whole numbers as long, dates and arrays as text, doubles to six digits."""

    def flat(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        return c.alias(f.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name``; ``sql`` names domain tables freely."""

    def keep(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, folder: plain(build(Tables(spark, folder)))
        if sql is not None:
            ORACLE_SQL[name] = check_sql(sql)
        return build

    return keep

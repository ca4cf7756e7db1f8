"""Registered queries: a Spark callable and, where SQL can say it, its ANSI twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from filmloom.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. Results are brought to plain column types first."""
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return plain(build(spark, sf_dir))
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        run.__doc__ = build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions as doubles of six decimals, arrays and dates as text."""
    def convert(field: T.StructField):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)  # no negative zero
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|", "~")
        elif isinstance(kind, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        return c.alias(field.name)
    return df.select(*[convert(f) for f in df.schema.fields])

"""A query and the SQL that must give the same rows, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY, HOUR = 86_400_000_000, 3_600_000_000


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, t (microseconds)."""
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", micros("ts").alias("t"))


def of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.where(F.col("event_type") == kind)


def points(spark: SparkSession, sf_dir: str, names: list[str], scale: float = 1.0) -> DataFrame:
    """vec_id, label and the first components of the embeddings as doubles, scaled."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double") * scale
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *[e(i).alias(n) for i, n in enumerate(names)])


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)

"""Scaling, encoding, splitting, imputing and profiling of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import uniform


def _with(df: DataFrame, *stats: Column) -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(*stats)))  # one row


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population std; 0 where the std is 0."""
    out = _with(df, *(s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    return out.withColumns({f"{c}_z": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0) for c in columns}).drop(*(f"_{k}_{c}" for k in "ms" for c in columns))


def minmax(df: DataFrame, columns: list[str]) -> DataFrame:
    out = _with(df, *(s for c in columns for s in (F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"))))
    return out.withColumns({f"{c}_01": F.when(F.col(f"_b_{c}") > F.col(f"_a_{c}"), (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") - F.col(f"_a_{c}"))).otherwise(0.0) for c in columns}).drop(*(f"_{k}_{c}" for k in "ab" for c in columns))


def one_hot(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == F.lit(v)).cast("int"), F.lit(0)) for v in values})


def encode(column: Column, mapping: dict) -> Column:
    """A dictionary as a lookup; unknown values are null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)), column)


def split(df: DataFrame, share: float, seed: int, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by a hash of the keys: the same row always falls on the same side."""
    u = uniform(seed, *(F.col(k) for k in keys))
    return df.where(u < share), df.where(u >= share)


def impute_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    out = _with(df, *(F.avg(c).alias(f"_m_{c}") for c in columns))
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns}).drop(*(f"_m_{c}" for c in columns))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (sample), least, greatest; one pass for all columns."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest")).alias(f"_{i}") for i, c in enumerate(columns)]
    return df.agg(*stats).select(F.explode(F.array(*(f"_{i}" for i in range(len(columns))))).alias("r")).select("r.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))

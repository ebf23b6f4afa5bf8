"""Sources and sinks: files that the engine's inputs come as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import normal, uniform


def csv(spark: SparkSession, path: str, schema: str, timestamp_format: str | None = None) -> DataFrame:
    """CSV with a header and a given schema; malformed rows become nulls."""
    reader = spark.read.option("header", True).schema(schema)
    return (reader.option("timestampFormat", timestamp_format) if timestamp_format else reader).csv(path)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(img, c, y, x, v): pixels of image files in long form."""
    img = spark.read.format("image").load(path).select("image.*")
    n = F.col("nChannels")
    px = img.select(F.col("origin").alias("img"), "width", n.alias("n"), F.col("data"), F.posexplode(F.sequence(F.lit(0), F.length("data") - 1)).alias("i", "_"))
    return px.select("img", (F.col("i") % F.col("n")).alias("c"), F.floor(F.col("i") / F.col("n") / F.col("width")).alias("y"), (F.floor(F.col("i") / F.col("n")) % F.col("width")).alias("x"), F.conv(F.hex(F.expr("substring(data, i + 1, 1)")), 16, 10).cast("int").alias("v"))


def blobs(spark: SparkSession, n: int, centres: list[list[float]], spread: float = 1.0, seed: int = 0) -> DataFrame:
    """(id, v, label): normal points around centres, the same for any partitioning."""
    table = F.array(*(F.array(*map(F.lit, map(float, c))) for c in centres))
    label = F.pmod(F.col("id"), F.lit(len(centres))).cast("int")
    v = F.transform(F.element_at(table, label + 1), lambda x, i: x + spread * normal(seed, F.col("id"), i))
    return spark.range(n).select("id", v.alias("v"), label.alias("label"))


def line(spark: SparkSession, n: int, coefficients: list[float], intercept: float = 0.0, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """(id, x1.., y): a noisy linear relation over uniform features."""
    xs = [(2 * uniform(seed + i, F.col("id")) - 1).alias(f"x{i + 1}") for i in range(len(coefficients))]
    df = spark.range(n).select("id", *xs)
    y = sum((F.col(f"x{i + 1}") * float(c) for i, c in enumerate(coefficients)), F.lit(float(intercept)))
    return df.withColumn("y", y + noise * normal(seed + 99, F.col("id")))


def write(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

"""Cutting lineage between the rounds of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back, so that a
    lost executor costs a read and plans don't grow with the rounds."""
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: str, ranges: int = 64) -> DataFrame:
    """df with number: 1.. in the order of a column without repeats.  Rows are
    numbered within ranges, which are added up by a row each; none holds all."""
    df = cut(df.repartitionByRange(ranges, order).withColumn("_r", F.spark_partition_id()))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("_r").agg(F.count("*").alias("n")).select("_r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_r").orderBy(order))
    return df.withColumn("_n", own).join(F.broadcast(sums), "_r").withColumn("number", (F.col("_n") + F.col("_before")).cast("int")).drop("_r", "_n", "_before")

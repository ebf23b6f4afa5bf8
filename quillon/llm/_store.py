"""Where operators of this subpackage keep tables between jobs.

Lineage is cut by writing Parquet below the folder that the cluster names in
``spark.checkpoint.dir``, which every executor and the driver can reach.  Only
a session without that setting (tests, local mode) gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

#: Rows of an Arrow batch; with long documents the default of 10,000 is too much.
BATCH_ROWS = 1000
#: A side is broadcast only below all of these, which are checked on the written
#: table: its file bytes, its rows, and its bytes as rows in memory.
BROADCAST_BYTES = 32 << 20
BROADCAST_ROWS = 1_000_000
BROADCAST_WIDE = 128 << 20


def shared_folder(spark: SparkSession) -> str:
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillon-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(df: DataFrame) -> Column:
    """64-bit hash of a row's columns; rows that are equal throughout share it."""
    return F.xxhash64(*(F.to_json(f"`{f.name}`") if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema.fields))


class Workspace:
    """A folder of tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back; a lost executor costs no more than a read."""
        at = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._quillon_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing will read again."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._quillon_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def size(self, df: DataFrame) -> int:
        """Bytes of a written table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._quillon_path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def wide(self, df: DataFrame) -> tuple[int, int]:
        """Rows of a table and about their bytes in memory, however well they are packed in files."""
        fixed, loose = 24, []
        for f in df.schema.fields:
            if isinstance(f.dataType, (StringType, BinaryType)):
                loose.append(F.octet_length(f.name))
            elif isinstance(f.dataType, (ArrayType, MapType)):
                inner = f.dataType.elementType if isinstance(f.dataType, ArrayType) else None
                loose.append(F.size(f.name) * (16 + 8 * len(getattr(inner, "fields", ()))))
            fixed += 8 * max(1, len(getattr(f.dataType, "fields", ())))
        more = sum((F.coalesce(F.sum(c.cast("long")), F.lit(0)) for c in loose), F.lit(0))
        n, size = df.agg(F.count("*"), more).first()
        return n, n * fixed + size

    def small(self, df: DataFrame) -> DataFrame:
        """A written table with a broadcast hint if its size allows, else as it is."""
        if self.size(df) <= BROADCAST_BYTES:
            rows, size = self.wide(df)
            if rows <= BROADCAST_ROWS and size <= BROADCAST_WIDE:
                return F.broadcast(df)
        return df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Cutting lineage through the folder that driver and executors share, and joins by measured size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes up to which the side of a join is broadcast; beyond either, the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: spark.checkpoint.dir, or a local one where it is unset and the master is local (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="telemill-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, written to the shared folder as Parquet and read back: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._telemill_path = path
    return out


def drop_written(df: DataFrame | None) -> None:
    """Delete a table made by written(), once nothing reads it any more."""
    path = getattr(df, "_telemill_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _width(column, kind: DataType):
    """About how many bytes a value takes."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 8
    if isinstance(kind, ArrayType | MapType):
        return F.coalesce(F.size(column), F.lit(0)) * 64 + 16
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df, counted and measured, is within BROADCAST_ROWS and BROADCAST_BYTES."""
    if rows is not None and rows > BROADCAST_ROWS:
        return False
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def sized_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right, broadcasting right only if it is measured small; else both shuffle, and AQE splits hot keys."""
    return left.join(F.broadcast(right) if is_small(right, rows) else right.hint("merge"), on, how)


def release(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing names any more: it does so when the driver's JVM collects.

    Every stage leaves buffers of some MB in the driver, too, by which its heap grows where it isn't collected meanwhile.
    """
    import gc

    gc.collect()
    spark._jvm.System.gc()

"""Tables that are made once and read several times: written to the shared folder where there is one, which also cuts their lineage, else kept in the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, name: str) -> DataFrame:
    """df, made now: a Parquet table in spark.checkpoint.dir, or persisted where that is unset."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        out = df.persist()
        out.count()
        return out
    path = f"{folder.rstrip('/')}/loom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def unsettle(df: DataFrame) -> None:
    """Give a settled table's room back."""
    path = getattr(df, "_loom_path", None)
    if path is None:
        df.unpersist()
        return
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

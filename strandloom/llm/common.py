"""Shared pieces: the shared folder, written intermediate tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS, BATCH_ROWS = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode (tests); on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="strandloom-")
        _LOCAL[context.applicationId] = found
    return found.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """Let Arrow batches between Spark and Python hold ROWS rows, which bounds what a task buffers of long texts; operators join them as they need.

    The setting is read when a plan runs, so it stays in the session; one that differs from Spark's default is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":
        conf.set(BATCH_ROWS, str(ROWS))
    return df


_WRITTEN: set[str] = set()


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._strandloom_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    if path := getattr(df, "_strandloom_path", None):
        remove_path(df.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _WRITTEN.discard(path)


def sweep(folder: str, manifest: DataFrame) -> None:
    """Delete the files in a folder that a written manifest doesn't list: those of lost or repeated attempts."""
    kept = {row["path"].rpartition("/")[2] for row in manifest.select("path").toLocalIterator()}
    system, base = fs.FileSystem.from_uri(folder)
    for info in system.get_file_info(fs.FileSelector(base)):
        if info.is_file and info.base_name not in kept:
            system.delete_file(info.path)


def cleanup(spark: SparkSession) -> None:
    """Delete all that operators have left in the shared folder for this application. Results of operators are lazy and read those tables, so write them first."""
    for path in list(_WRITTEN):
        remove_path(spark, path)


BITS = 24


def place(hashed: Column) -> Column:
    """A place in a bitmap by the last bits of a 64-bit hash."""
    return hashed.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def bitmap(hashes: DataFrame, name: str) -> np.ndarray:
    """Which of 2 ** BITS places some 64-bit hashes have: a fixed 2 MB, whatever their number."""
    words = hashes.select(place(F.col(name)).alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, at & 63))").alias("bits"))
    table = words.toArrow()  # 2 ** (BITS - 6) rows at most
    out = np.zeros(1 << BITS - 6, np.int64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy()
    return out


def may_be_in(found: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether hashes (or their places) may be among those of a bitmap: never false for one that is. Spares others a shuffle; a full bitmap spares none, and loses none.

    For use inside a task's Python function: a UDF of its own would take a second worker for each task.
    """
    at = at.astype(np.int64) & ((1 << BITS) - 1)
    return (found[at >> 6] >> (at & 63)) & 1 == 1


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (src, dst); root is the smallest node of its component.

    Alternates the large-star and small-star steps, whose number of rounds grows with the
    logarithm of the node count. Each round is aggregation and join only, written to the shared
    folder; nothing but two numbers (row count and checksum) reaches the driver.
    A node with a great many edges is one row for each task in the aggregation; the join gets an exchange of its own for the aggregated side, so
    that both sides come right from exchanges and Spark can split such a node's rows (joined in place, they would share the aggregation's partitions).
    """
    def nearest(df: DataFrame) -> DataFrame:
        least = df.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("least"))
        return df.join(least.repartition(F.xxhash64("src")), "src")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = written(edges.select("src", "dst").filter("src <> dst").distinct(), tag)
    seen = state(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = nearest(both).filter("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct()
        joined = nearest(down)
        small = joined.filter("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
        small = small.union(joined.select("src", F.col("least").alias("dst"))).filter("src <> dst").distinct()
        after = written(small, tag)
        remove(now)
        now, before = after, seen
        seen = state(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(roots)

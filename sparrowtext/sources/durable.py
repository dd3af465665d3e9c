"""Tables that end lineage: written to the folder that the cluster shares, read back from there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset a local session gets one
    of its own, as in tests; on a cluster that would be one machine's folder, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='sparrowtext-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/sparrowtext/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def cut(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, lost executors cost
    only their own tasks, and the planner knows the table's true size. by: a column to write apart by."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparrowtext_path = path
    return out


def drop_cut(df: DataFrame, part: str = "") -> None:
    """Remove a table that cut() wrote, or a part of it ("kind=gram"); its readers must be done."""
    remove(df.sparkSession, f"{df._sparrowtext_path}/{part}" if part else df._sparrowtext_path)


def ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with their rank from 0 in the order of keys (nulls first; rows with equal keys in any order).

    Range partitions are sorted and numbered where they are; a row's rank is its number plus the rows
    of the partitions before. Only the partitions' sizes reach the driver.
    """
    spark = rows.sparkSession
    mark = "_at"
    while mark in rows.columns:
        mark += "_"
    table = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(mark, F.monotonically_increasing_id()), name)
    part = F.shiftright(mark, 33)
    sizes = table.groupBy(part.alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()
    starts, before = [], 0
    for r in sizes:
        starts.append((r.p, before))
        before += r.n
    of = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    number = F.col(mark) - F.shiftleft(part, 33) + F.col("_start")
    return table.join(of, part == F.col("_part")).withColumn(name, number).drop(mark, "_part", "_start")

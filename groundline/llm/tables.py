"""Reading the corpus tables and cutting lineage, in one place."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_hash(*columns: str | Column) -> Column:
    """A 64-bit name of a row by some columns, never null; a null is not like any value, in whichever column it stands."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of its own only where that is unset, as in tests."""
    set_dir = spark.conf.get("spark.checkpoint.dir", "")
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="groundline-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that a step has written, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder: survives lost executors, ends the lineage."""
    shared_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle and checkpoint files of tables that nothing refers to any more; it waits for collections."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Let the executors collect their heaps and give what is free of them back to the system, each by a task a core.

    A heap that one step has filled is else kept at its full size, beside the Python workers of the next one.
    """
    tasks = spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("reflect('java.lang.System', 'gc')").alias("x")).write.format("noop").mode("overwrite").save()


def shards_for(spark: SparkSession, size: int, each: int = 16 << 20) -> int:
    """How many shards hold ``size`` bytes, ``each`` bytes apiece: as many as shuffle partitions at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame) -> DataFrame:
    """df if every read of it gives the same rows in the same partitions, as files and checkpoints do; else a checkpoint of it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {m[1] for line in plan.splitlines() if (m := re.match(r"[\s:+\-]*(\w+)", line))}
    return df if nodes <= {"Project", "Filter", "Relation", "LogicalRDD", "LocalRelation"} else cut(df)

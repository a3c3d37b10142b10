"""Point tables that grow: files that arrive in a folder, and running results over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "file_id int, x double, y double, z double, intensity double, return_number int, number_of_returns int, classification int, is_withheld boolean"


def arriving_points(spark: SparkSession, path: str, files_at_once: int = 100, schema: str = POINT) -> DataFrame:
    """The points of the Parquet files in a folder as a stream, so many files a batch; files that come later are read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def running_statistics(points: DataFrame, block: float = 256.0) -> DataFrame:
    """(by, bx, n_points, n_ground, min_z, max_z, mean_intensity): by blocks of the ground, withheld points left out.

    State is one row a block; write it in update or complete mode. A null coordinate makes a null block.
    """
    kept = points.filter(~F.coalesce("is_withheld", F.lit(False)))
    ground = F.sum(F.when(F.col("classification") == 2, 1).otherwise(0))
    keys = [F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")]
    return kept.groupBy(*keys).agg(F.count("*").alias("n_points"), ground.alias("n_ground"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.avg("intensity").alias("mean_intensity"))

"""File statistics: bounds, densities, return histograms and their combination."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RETURNS, SAMPLE = 15, 10_000


def file_bounds(points: DataFrame) -> DataFrame:
    """One row a file: bounds and point count."""
    sides = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy("file_id").agg(*sides, F.count("*").alias("n_points"))


def file_density(points: DataFrame) -> DataFrame:
    b = file_bounds(points)
    area = (F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))
    return b.select("file_id", "n_points", area.alias("area"), F.when(area > 1e-12, F.col("n_points") / area).otherwise(F.lit(0.0)).alias("density"))


def return_histogram(points: DataFrame) -> DataFrame:
    """Counts of return numbers 1 to 15, zeros included."""
    n = points.groupBy("file_id", "return_number").agg(F.count("*").alias("n"))
    numbers = points.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(1), F.lit(RETURNS))).alias("return_number"))
    return numbers.join(n, ["file_id", "return_number"], "left").select("file_id", "return_number", F.coalesce("n", F.lit(0)).alias("n"))


def return_stats(points: DataFrame) -> DataFrame:
    """Least, greatest, mean and population deviation of return numbers, from the histogram."""
    h = points.groupBy("file_id", "return_number").agg(F.count("*").alias("n"))
    r, n = F.col("return_number"), F.col("n")
    mean = F.sum(r * n) / F.sum("n")
    spread = F.greatest(F.sum(r * r * n) / F.sum("n") - mean * mean, F.lit(0.0))
    return h.groupBy("file_id").agg(F.min(r).alias("min_return"), F.max(r).alias("max_return"), mean.alias("mean_return"), F.sqrt(spread).alias("std_return"), F.sum("n").alias("n_points"))


def among_least(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """The rows that can be among a key's k least by ``order``: those up to a bound that k rows keep, all on a tie.

    Each key's rows are dealt in turn to more than four k groups; the k-th least of the groups' least values is the bound. Only
    a value a group leaves a task, and about k rows remain, so no task sorts all rows of a key. Keys are few.
    """
    dealt = rows.select(*keys, order, (F.monotonically_increasing_id() % (4 * k + 1)).alias("_turn"))
    least = dealt.groupBy(*keys, "_turn").agg(F.min(order).alias("_least"))
    named = [F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]
    bound = least.groupBy(*named).agg(F.get(F.sort_array(F.collect_list("_least")), F.lit(k - 1)).alias("_bound"))
    same = functools.reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)])
    below = F.col("_bound").isNull() | F.col(order).isNull() | (F.col(order) <= F.col("_bound"))
    return rows.join(F.broadcast(bound), same).filter(below).select(*rows.columns)


def intensity_stats(points: DataFrame, order: list[str], sample: int = SAMPLE) -> DataFrame:
    """Statistics of each file's first points in its own order.

    The greatest value overlooks points that set a new least one, as the source statistic does; a sample that only falls
    has no greatest value (null).
    """
    w = Window.partitionBy("file_id").orderBy(*order)
    first = among_least(points.select(*dict.fromkeys(["file_id", "intensity", *order])), ["file_id"], order[0], sample).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= sample)
    before = F.min("intensity").over(Window.partitionBy("file_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("counts", F.when(F.col("intensity") >= before, F.col("intensity")))
    return first.groupBy("file_id").agg(F.min("intensity").alias("min_intensity"), F.max("counts").alias("max_intensity"), F.avg("intensity").alias("mean_intensity"), F.stddev_pop("intensity").alias("std_intensity"))


def combined(files: DataFrame, name: str) -> DataFrame:
    """Statistics of all files from each file's: means by point count, deviations as the root of summed squares,
    densities by area. ``files`` has n_points, area, density and min_, max_, mean_, std_ of name."""
    n = F.col("n_points")
    return files.agg(
        F.min(f"min_{name}").alias(f"min_{name}"), F.max(f"max_{name}").alias(f"max_{name}"),
        (F.sum(F.col(f"mean_{name}") * n) / F.sum(n)).alias(f"mean_{name}"),
        F.sqrt(F.sum(F.col(f"std_{name}") * F.col(f"std_{name}"))).alias(f"std_{name}"),
        (F.sum(F.col("density") * F.col("area")) / F.sum("area")).alias("density"),
    )


def last_returns(points: DataFrame) -> DataFrame:
    return points.filter("number_of_returns > 0 and return_number = number_of_returns")


def single_returns(points: DataFrame) -> DataFrame:
    return points.filter("return_number = 1 and number_of_returns = 1")


def crs_mode(files: DataFrame) -> DataFrame:
    """The reference system that most files have; on a tie the one first seen last."""
    n = files.filter("epsg is not null").groupBy("epsg").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_seen"))
    return n.orderBy(F.desc("n_files"), F.desc("first_seen")).limit(1)

"""Point tables. A point has file_id, x, y, z, intensity, return_number, number_of_returns, classification, is_withheld."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x", "y", "z"]

#: A world of 2 x 2 files of 64 m, derived from lineitem with + - * / only, so any SQL engine gives the same doubles.
DERIVED = """
WITH b AS (
  SELECT *, CAST(l_suppkey % 4 AS INT) AS file_id,
    CAST((l_orderkey*7919 + l_linenumber*104729 + l_partkey*31) % 6400 AS DOUBLE)/100.0 AS lx,
    CAST((l_partkey*6007 + l_orderkey*37 + l_linenumber*613) % 6400 AS DOUBLE)/100.0 AS ly
  FROM {lineitem}),
w AS (
  SELECT *, lx + CAST(file_id % 2 AS DOUBLE)*64.0 AS x,
            ly + CAST(CASE WHEN file_id >= 2 THEN 1 ELSE 0 END AS DOUBLE)*64.0 AS y,
    CASE WHEN file_id = 3 AND lx >= 16.0 AND lx < 48.0 AND ly >= 16.0 AND ly < 48.0 THEN 1 ELSE 0 END AS pond FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, file_id, x, y,
  CASE WHEN pond = 1 THEN 45.0 ELSE
    40.0 + 0.08*x + 0.05*y + ((x-64.0)*(x-64.0) - (y-64.0)*(y-64.0))/400.0
    + CASE WHEN l_returnflag='A' THEN 0.0 ELSE l_quantity/10.0 END END AS z,
  CASE WHEN pond = 1 THEN l_extendedprice/100.0 ELSE l_extendedprice END AS intensity,
  CAST(CASE WHEN pond = 1 THEN 1 ELSE 1 + l_linenumber % 3 END AS INT) AS number_of_returns,
  CAST(CASE WHEN pond = 1 THEN 1 ELSE 1 + l_partkey % (1 + l_linenumber % 3) END AS INT) AS return_number,
  CAST(CASE WHEN pond = 1 THEN 9 WHEN l_returnflag='A' THEN 2 ELSE 5 END AS INT) AS classification,
  l_discount >= 0.1 AS is_withheld
FROM w"""


def derived_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DERIVED.format(lineitem=f"parquet.`{sf_dir}/lineitem.parquet`"))


def read_points(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A Parquet point table; a box (min_x, min_y, max_x, max_y) is pushed down to the scan."""
    points = spark.read.parquet(path)
    if box:
        points = points.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))
    return points



def las_header(data: bytes) -> dict:
    """Version, layout, counts and bounds of a LAS header; compressed (LAZ) files are refused."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    header_size, offset = struct.unpack_from("<HI", data, 94)
    layout, length, n = struct.unpack_from("<BHI", data, 104)
    if layout & 0x80:
        raise ValueError("LAZ compression is not supported")
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<6d", data, 179)
    if minor >= 4 and header_size >= 375:
        n = struct.unpack_from("<Q", data, 247)[0]
    return {"version": f"{major}.{minor}", "layout": layout & 0x3F, "record": length, "offset": offset, "n": n, "scale": scale, "shift": shift, "bounds": (min_x, min_y, min_z, max_x, max_y, max_z)}


def las_points(data: bytes) -> pd.DataFrame:
    """The points of an uncompressed LAS file of layout 0-3 or 6-8."""
    h = las_header(data)
    raw = np.frombuffer(data, np.uint8, h["n"] * h["record"], h["offset"]).reshape(h["n"], h["record"])
    at = lambda k, n, kind: np.ascontiguousarray(raw[:, k : k + n]).view(kind)[:, 0]
    xyz = [at(4 * i, 4, "<i4") * h["scale"][i] + h["shift"][i] for i in range(3)]
    flags, modern = raw[:, 14], h["layout"] >= 6
    kind = raw[:, 16] if modern else raw[:, 15] & 31
    withheld = (raw[:, 15] >> 2) & 1 if modern else raw[:, 15] >> 7
    bits = 4 if modern else 3
    return pd.DataFrame({
        "x": xyz[0], "y": xyz[1], "z": xyz[2], "intensity": at(12, 2, "<u2").astype(np.int32),
        "return_number": (flags & ((1 << bits) - 1)).astype(np.int32), "number_of_returns": ((flags >> bits) & ((1 << bits) - 1)).astype(np.int32),
        "classification": kind.astype(np.int32), "is_withheld": withheld.astype(bool),
    })


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """Points of the uncompressed LAS files under path, with their file's path; one file is one task's work."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                points = las_points(bytes(content))
                for k in range(0, len(points), 200_000):
                    yield points.iloc[k : k + 200_000].assign(path=name)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content")
    return files.mapInPandas(run, "x double, y double, z double, intensity int, return_number int, number_of_returns int, classification int, is_withheld boolean, path string")

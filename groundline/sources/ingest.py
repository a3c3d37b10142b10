"""Ingest: headers of point files, their coordinate systems, pruning by box, and sorted Parquet."""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundline.operators.columns import relevant
from groundline.sources.points import las_header

#: Fixed values of the LAS format: records that hold the coordinate system as text and as GeoTIFF keys, and the key of a projection.
WKT_RECORD, KEY_RECORD, PROJECTED_KEY = 2112, 34735, 3072
#: Bytes of a file that are read for its header and records.
HEAD = 1 << 16


def las_epsg(data: bytes) -> int | None:
    """The code of a header's coordinate system: of the WKT record's last authority, else of the GeoTIFF keys, else none."""
    size, _, n = struct.unpack_from("<HII", data, 94)
    at, found = size, {}
    for _ in range(n):
        if at + 54 > len(data):
            break
        record, length = struct.unpack_from("<HH", data, at + 18)
        found[record] = data[at + 54 : at + 54 + length]
        at += 54 + length
    if text := found.get(WKT_RECORD, b"").decode("utf-8", "ignore"):
        codes = re.findall(r'(?:AUTHORITY|ID)\["EPSG",\s*"?(\d+)"?\]', text)
        if codes:
            return int(codes[-1])
    keys = found.get(KEY_RECORD, b"")
    for k in range(8, len(keys) - 7, 8):
        key, place, _, value = struct.unpack_from("<HHHH", keys, k)
        if key == PROJECTED_KEY and place == 0 and value:
            return value
    return None


def las_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_points, min_x .. max_z, epsg) of the files under path; files that can't be read are left out."""

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    h = las_header(bytes(content))
                    rows.append((name, h["n"], *h["bounds"], las_epsg(bytes(content))))
                except (ValueError, struct.error):
                    continue
            yield pd.DataFrame(rows, columns=["path", "n_points", "min_x", "min_y", "min_z", "max_x", "max_y", "max_z", "epsg"]).astype({"epsg": "Int32"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.la[sz]").load(path).select("path", F.substring("content", 1, HEAD).alias("content"))
    return files.mapInPandas(run, "path string, n_points long, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double, epsg int")


def pruned(files: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """The files whose header box meets a box; no point is read."""
    return relevant(files, box)


def write_points(points: DataFrame, path: str, block: float = 256.0) -> None:
    """Points as Parquet, dealt out by ranges of blocks of the ground and sorted inside them, so a box reads few row groups."""
    bx, by = F.floor(F.col("x") / block), F.floor(F.col("y") / block)
    points.repartitionByRange(by, bx).sortWithinPartitions(by, bx, "x", "y").write.mode("errorifexists").parquet(path)

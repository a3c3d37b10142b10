"""Sinks: GeoTIFF of a mosaic, a map file, and GeoJSON lines.

A GeoTIFF or a map file is one file by its nature, so its writer streams: rows come to the driver in order, a strip or an
object at a time (``toLocalIterator``), never the whole raster. GeoJSON lines and Parquet are written by the executors.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline import params
from groundline.operators.raster import rendered
from groundline.params import CELL

#: Fixed values of the TIFF format: field types (2 text, 3 short, 4 long, 12 double) and the GeoTIFF tags.
TEXT, SHORT, LONG, DOUBLE = 2, 3, 4, 12
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113


def geotiff(width: int, height: int, rows: Iterator[bytes], origin: tuple[float, float], cell: float = CELL, epsg: int | None = None) -> Iterator[bytes]:
    """The parts of an 8-bit grey GeoTIFF: header and tags first, then one strip a row. Value 0 is no data."""
    packed = lambda kind, *v: struct.pack("<" + {SHORT: "H", LONG: "I", DOUBLE: "d"}[kind] * len(v), *v)
    keys = [1, 1, 0, 2, 1024, 0, 1, 1, 3072, 0, 1, epsg] if epsg and 0 < epsg < 65536 else [1, 1, 0, 1, 1025, 0, 1, 1]
    tags = {
        256: (LONG, packed(LONG, width)), 257: (LONG, packed(LONG, height)), 258: (SHORT, packed(SHORT, 8)), 259: (SHORT, packed(SHORT, 1)),
        262: (SHORT, packed(SHORT, 1)), 273: (LONG, None), 277: (SHORT, packed(SHORT, 1)), 278: (LONG, packed(LONG, 1)), 279: (LONG, packed(LONG, *[width] * height)),
        PIXEL_SCALE: (DOUBLE, packed(DOUBLE, cell, cell, 0.0)), TIE_POINT: (DOUBLE, packed(DOUBLE, 0.0, 0.0, 0.0, *origin, 0.0)),
        GEO_KEYS: (SHORT, packed(SHORT, *keys)), NO_DATA: (TEXT, b"0\0"),
    }
    sizes = {TEXT: 1, SHORT: 2, LONG: 4, DOUBLE: 8}
    table = 8 + 2 + 12 * len(tags) + 4
    length = lambda t: 4 * height if tags[t][1] is None else len(tags[t][1])
    at, places = table, {}
    for t in tags:
        if length(t) > 4:
            places[t] = at
            at += length(t) + length(t) % 2
    tags[273] = (LONG, packed(LONG, *[at + width * k for k in range(height)]))
    head = struct.pack("<2sHIH", b"II", 42, 8, len(tags))
    for t, (kind, value) in sorted(tags.items()):
        where = struct.pack("<I", places[t]) if t in places else value.ljust(4, b"\0")
        head += struct.pack("<HHI", t, kind, len(value) // sizes[kind]) + where
    yield head + struct.pack("<I", 0)
    for t in tags:
        if t in places:
            yield tags[t][1] + b"\0" * (len(tags[t][1]) % 2)
    n = 0
    for row in rows:
        yield row
        n += 1
    if n != height:
        raise ValueError(f"{n} rows for a height of {height}")


def write_geotiff(mosaic: DataFrame, path: str, reference: tuple[float, float], epsg: int | None = None, cell: float = CELL) -> None:
    """A mosaic (gy, gx, v) as an 8-bit GeoTIFF; the reference point is added and pixels without a value are 0.

    An empty mosaic writes nothing. Rows are put together by the executors and streamed in order.
    """
    box = mosaic.agg(F.min("gy").alias("y0"), F.max("gy").alias("y1"), F.min("gx").alias("x0"), F.max("gx").alias("x1")).first()
    if box["y0"] is None:
        return
    width, height = box["x1"] - box["x0"] + 1, box["y1"] - box["y0"] + 1
    pixels = rendered(mosaic).groupBy("gy").agg(F.collect_list(F.struct("gx", "byte")).alias("pixels")).orderBy("gy")

    def rows() -> Iterator[bytes]:
        y = box["y0"]
        for r in pixels.toLocalIterator():
            while y < r["gy"]:
                yield bytes(width)
                y += 1
            line = np.zeros(width, np.uint8)
            line[[p["gx"] - box["x0"] for p in r["pixels"]]] = [p["byte"] for p in r["pixels"]]
            yield line.tobytes()
            y += 1

    # a pixel's place is its sample's: the corner of the image lies half a cell further north-west
    origin = (box["x0"] * cell + reference[0] - cell / 2, -box["y0"] * cell + reference[1] + cell / 2)
    with open(path, "wb") as f:
        f.writelines(geotiff(width, height, rows(), origin, cell, epsg))


CODES = {n: c for n, c, _ in params.AREAS} | {n: c for n, c, _ in params.LINES} | dict(params.POINTS)


def map_file(objects: Iterator, scale: int, reference: tuple[float, float], elevation: float = 0.0, epsg: int | None = None, bezier_error: float | None = None) -> Iterator[str]:
    """The parts of a map file: geo-reference, symbols, objects in paper millimetres (y southwards) with their tags.

    An object has symbol, coordinates (a list of rings or a line), and optionally rotation and tags. Lines but those of the
    basemap are written as curves if an error is given.
    """
    if scale not in (10_000, 15_000):
        raise ValueError("scale is 10000 or 15000")
    code = f"EPSG:{epsg}" if epsg else "Local"
    yield f'<?xml version="1.0" encoding="UTF-8"?>\n<map version="9"><georeferencing scale="{scale}" elevation="{elevation:.2f}"><projected_crs id={quoteattr(code)}><ref_point x="{reference[0]}" y="{reference[1]}"/></projected_crs></georeferencing>\n'
    names = list(CODES)
    yield f'<symbols count="{len(names)}">' + "".join(f'<symbol id="{k}" code="{CODES[n]}" name={quoteattr(n)}/>' for k, n in enumerate(names)) + "</symbols>\n<objects>\n"
    paper = 1000.0 / scale
    for o in objects:
        if o["symbol"] not in CODES:
            raise ValueError(f"unknown symbol {o['symbol']}")
        rings = o["coordinates"]
        basemap = o["symbol"] in ("BasemapContour", "NegBasemapContour")
        curve = f' bezier="{bezier_error}"' if bezier_error and not basemap and o["symbol"] in {n for n, _, _ in params.LINES} else ""
        turn = f' rotation="{o["rotation"]:.4f}"' if o.get("rotation") is not None else ""
        coords = ";".join(" ".join(f"{x * paper:.3f} {-y * paper:.3f}" for x, y in ring) for ring in rings)
        tags = "".join(f"<t key={quoteattr(k)}>{escape(str(v))}</t>" for k, v in sorted((o.get("tags") or {}).items()))
        yield f'<object symbol="{names.index(o["symbol"])}"{turn}{curve}><tags>{tags}</tags><coords>{coords}</coords></object>\n'
    yield "</objects></map>\n"


def write_map(objects: DataFrame, path: str, scale: int, reference: tuple[float, float], elevation: float = 0.0, epsg: int | None = None, bezier_error: float | None = None) -> None:
    """Objects (symbol, coordinates array<array<array<double>>>[, rotation][, tags]) as one map file, streamed."""
    rows = (r.asDict() for r in objects.toLocalIterator())
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(map_file(rows, scale, reference, elevation, epsg, bezier_error))


def geojson(objects: DataFrame, kind: str = "Polygon") -> DataFrame:
    """(value): one GeoJSON feature a row, of objects with symbol and coordinates; write it with ``df.write.text``.

    ``kind`` is Polygon (rings), LineString or Point (the first ring, or its first point). Null geometry is a null geometry.
    """
    shape = {"Polygon": F.col("coordinates"), "LineString": F.get("coordinates", F.lit(0)), "Point": F.get(F.get("coordinates", F.lit(0)), F.lit(0))}[kind]
    coordinates = F.to_json(F.struct(shape.alias("c")))
    inner = F.regexp_extract(coordinates, r'^\{"c":(.*)\}$', 1)
    geometry = F.when(shape.isNull(), F.lit("null")).otherwise(F.concat(F.lit(f'{{"type":{json.dumps(kind)},"coordinates":'), inner, F.lit("}")))
    properties = F.to_json(F.struct("symbol"))
    return objects.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":'), geometry, F.lit("}")).alias("value"))

"""Small operators as SQL functions of a session: ``register(spark)``, then ``SELECT gl_paper_mm(x, 15000)``.

They are SQL expressions, so the optimizer sees through them. Null arguments give null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

LINE = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
#: name -> (arguments, result, body)
FUNCTIONS = {
    "gl_jitter": ("c DOUBLE, reference DOUBLE", "DOUBLE", "c + pmod(sin(c) * 43758.5453123, 1D) * 0.001 - 0.0005 - reference"),
    "gl_paper_mm": ("metres DOUBLE, scale INT", "DOUBLE", "metres * 1000 / scale"),
    "gl_cell": ("c DOUBLE, origin DOUBLE, cell DOUBLE", "INT", "CAST(round((c - origin) / cell) AS INT)"),
    "gl_contour_symbol": (
        "level DOUBLE, step DOUBLE", "STRING",
        "CASE WHEN abs(level - round(level / (5 * step)) * 5 * step) < 1e-8 THEN 'IndexContour' WHEN abs(level - round(level / step) * step) < 1e-8 THEN 'Contour' WHEN level IS NOT NULL THEN 'FormLine' END",
    ),
    "gl_ring_area": (
        f"line {LINE}", "DOUBLE",
        "CASE WHEN size(line) > 2 AND element_at(line, 1) = element_at(line, -1) THEN aggregate(zip_with(slice(line, 1, size(line) - 1), slice(line, 2, size(line) - 1), (p, q) -> p.x * q.y - q.x * p.y), 0D, (s, v) -> s + v) / 2 WHEN line IS NOT NULL THEN 0D END",
    ),
    "gl_line_length": (
        f"line {LINE}", "DOUBLE",
        "CASE WHEN size(line) < 2 THEN 0D ELSE aggregate(zip_with(slice(line, 1, size(line) - 1), slice(line, 2, size(line) - 1), (p, q) -> sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))), 0D, (s, v) -> s + v) END",
    ),
    "gl_boxes_meet": ("ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE", "BOOLEAN", "ax0 <= bx1 AND ax1 >= bx0 AND ay0 <= by1 AND ay1 >= by0"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)

"""File neighbourhoods, components, tiles and range joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundline.operators.stats import among_least
from groundline.params import CELL, MIN_MARGIN, TILE_SIZE
from groundline.session import checkpointed


def side_of(x: Column, y: Column) -> Column:
    """Where a centre lies from a file's box: one of eight sides or none."""
    left, right, above, below = x < F.col("min_x"), x > F.col("max_x"), y > F.col("max_y"), y < F.col("min_y")
    return (
        F.when(left & above, "top_left").when(right & above, "top_right").when(right & below, "bottom_right").when(left & below, "bottom_left")
        .when(above, "top").when(right, "right").when(below, "bottom").when(left, "left").otherwise("none")
    )


def reference_point(files: DataFrame) -> DataFrame:
    """Mean centre and mean elevation of all files, rounded to 10 m."""
    mid = lambda c: F.round(F.avg((F.col(f"min_{c}") + F.col(f"max_{c}")) / 2) / 10) * 10
    return files.agg(mid("x").alias("ref_x"), mid("y").alias("ref_y"), mid("z").alias("ref_z"))


def neighbours(files: DataFrame, k: int = 9, margin_share: float = 0.1) -> DataFrame:
    """(src, dst, side): of each file's k nearest centres those whose boxes come within the margin, itself left out.

    Files are joined on a coarse grid of box-sized cells, so only files that can touch meet; on one side the farther
    neighbour counts.
    """
    size = files.agg(F.avg((F.col("max_x") - F.col("min_x") + F.col("max_y") - F.col("min_y")) / 2).alias("size"), F.max(F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))).alias("widest"))
    f = files.join(F.broadcast(size)).withColumn("cx", (F.col("min_x") + F.col("max_x")) / 2).withColumn("cy", (F.col("min_y") + F.col("max_y")) / 2)
    reach = F.col("widest") + margin_share * F.col("size")
    f = f.withColumn("gx", F.floor(F.col("cx") / reach)).withColumn("gy", F.floor(F.col("cy") / reach))
    near = F.sequence(F.lit(-1), F.lit(1))
    a = f.withColumn("ox", F.explode(near)).withColumn("oy", F.explode(near)).withColumn("gx", F.col("gx") + F.col("ox")).withColumn("gy", F.col("gy") + F.col("oy"))
    b = f.select("gx", "gy", F.col("file_id").alias("dst"), F.col("cx").alias("dx"), F.col("cy").alias("dy"), *[F.col(c).alias(f"o_{c}") for c in ("min_x", "min_y", "max_x", "max_y")])
    d2 = (F.col("dx") - F.col("cx")) * (F.col("dx") - F.col("cx")) + (F.col("dy") - F.col("cy")) * (F.col("dy") - F.col("cy"))
    p = a.join(b, ["gx", "gy"]).withColumn("d2", d2)
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy("d2", "dst"))).filter(F.col("rank") <= k)
    margin = margin_share * F.col("size")
    touch = (F.col("o_min_x") <= F.col("max_x") + margin) & (F.col("o_max_x") >= F.col("min_x") - margin) & (F.col("o_min_y") <= F.col("max_y") + margin) & (F.col("o_max_y") >= F.col("min_y") - margin)
    p = p.filter(touch & (F.col("dst") != F.col("file_id"))).withColumn("side", side_of(F.col("dx"), F.col("dy")))
    return p.groupBy(F.col("file_id").alias("src"), "side").agg(F.max_by("dst", "rank").alias("dst"))


def components(files: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(file_id, component): the least file that a file is connected with; labels spread until they settle.

    Each round takes the least label of all neighbours and the label's own label, so long chains need few rounds.
    """
    pairs = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    pairs = checkpointed(pairs)
    labels = files.select("file_id", F.col("file_id").alias("component"))
    for _ in range(rounds):
        seen = pairs.join(labels, pairs.dst == labels.file_id).groupBy(F.col("src").alias("file_id")).agg(F.min("component").alias("near"))
        step = labels.join(seen, "file_id", "left").select("file_id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("file_id").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, "component", "left").select("file_id", F.least("component", F.coalesce("further", "component")).alias("component"), "was")
        step = checkpointed(step)
        moved = not step.filter("component <> was").isEmpty()
        labels = step.select("file_id", "component")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")


def largest_component(labels: DataFrame) -> DataFrame:
    """The files of the component with most files; on a tie the one with the least label."""
    n = labels.groupBy("component").agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "component").limit(1)
    return labels.join(F.broadcast(n), "component").select("file_id", "component", "n_files")


def retile(files: DataFrame, edges: DataFrame, tile: float = TILE_SIZE, margin: float = MIN_MARGIN, cell: float = CELL) -> DataFrame:
    """Each file's tiles with their boxes and clip boxes.

    Tiles overlap evenly by at least the margin; towards a neighbouring file the box reaches the margin further, else the
    clip box keeps two cells away from the file's edge. Inner clip edges lie in the middle of the overlap.
    """
    has = lambda *sides: F.max(F.col("side").isin(*sides))
    sides = edges.groupBy(F.col("src").alias("file_id")).agg(has("top").alias("above"), has("bottom").alias("below"), has("left").alias("before"), has("right").alias("after"))
    f = files.join(sides, "file_id", "left").fillna(False, ["above", "below", "before", "after"])
    out = lambda c: F.when(F.col(c), margin).otherwise(0.0)
    cut = lambda c: F.when(F.col(c), 0.0).otherwise(2 * cell)
    f = f.select("file_id", (F.col("min_x") - out("before")).alias("x0"), (F.col("max_x") + out("after")).alias("x1"), (F.col("min_y") - out("below")).alias("y0"), (F.col("max_y") + out("above")).alias("y1"),
                 (F.col("min_x") + cut("before")).alias("cx0"), (F.col("max_x") - cut("after")).alias("cx1"), (F.col("min_y") + cut("below")).alias("cy0"), (F.col("max_y") - cut("above")).alias("cy1"))
    count = lambda r: F.greatest(F.ceil((r - margin) / (tile - margin)), F.lit(2)).cast("int")
    f = f.withColumn("nx", count(F.col("x1") - F.col("x0"))).withColumn("ny", count(F.col("y1") - F.col("y0")))
    f = f.withColumn("mx", (F.col("nx") * tile - (F.col("x1") - F.col("x0"))) / (F.col("nx") - 1)).withColumn("my", (F.col("ny") * tile - (F.col("y1") - F.col("y0"))) / (F.col("ny") - 1))
    f = f.withColumn("yi", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("xi", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    first_x, last_x, first_y, last_y = F.col("xi") == 0, F.col("xi") == F.col("nx") - 1, F.col("yi") == 0, F.col("yi") == F.col("ny") - 1
    left = F.when(last_x & ~first_x, F.col("x1") - tile).otherwise(F.col("x0") + (tile - F.col("mx")) * F.col("xi"))
    top = F.when(last_y & ~first_y, F.col("y0") + tile).otherwise(F.col("y1") - (tile - F.col("my")) * F.col("yi"))
    f = f.withColumn("min_x", left).withColumn("max_x", F.col("min_x") + tile).withColumn("max_y", top).withColumn("min_y", F.col("max_y") - tile)
    return f.select(
        "file_id", (F.col("yi") * F.col("nx") + F.col("xi")).alias("tile_id"), "xi", "yi", "nx", "ny", "min_x", "min_y", "max_x", "max_y",
        F.when(first_x, F.col("cx0")).otherwise(F.col("min_x") + F.col("mx") / 2).alias("clip_min_x"), F.when(last_x, F.col("cx1")).otherwise(F.col("max_x") - F.col("mx") / 2).alias("clip_max_x"),
        F.when(last_y, F.col("cy0")).otherwise(F.col("min_y") + F.col("my") / 2).alias("clip_min_y"), F.when(first_y, F.col("cy1")).otherwise(F.col("max_y") - F.col("my") / 2).alias("clip_max_y"),
    )


def edge_side(tiles: DataFrame) -> DataFrame:
    """Each tile's place in its file: a corner, a side or none."""
    left, right, top, bottom = F.col("xi") == 0, F.col("xi") == F.col("nx") - 1, F.col("yi") == 0, F.col("yi") == F.col("ny") - 1
    side = (
        F.when(left & top, "top_left").when(right & top, "top_right").when(right & bottom, "bottom_right").when(left & bottom, "bottom_left")
        .when(left, "left").when(right, "right").when(top, "top").when(bottom, "bottom").otherwise("none")
    )
    return tiles.withColumn("edge_side", side)


def points_in_tiles(points: DataFrame, tiles: DataFrame, bucket: float = 64.0) -> DataFrame:
    """Every point once for each tile whose box holds it, whatever file it comes from: a range join by grid buckets.

    A tile is dealt to the buckets that its box meets, a point to its own one, so both sides are joined on equal keys.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))
    t = tiles.select(F.col("file_id").alias("tile_file"), "tile_id", "min_x", "min_y", "max_x", "max_y", F.explode(span("min_x", "max_x")).alias("bx"), F.col("min_y").alias("_y0"), F.col("max_y").alias("_y1"))
    t = t.withColumn("by", F.explode(span("_y0", "_y1"))).drop("_y0", "_y1")
    p = points.withColumn("bx", F.floor(F.col("x") / bucket)).withColumn("by", F.floor(F.col("y") / bucket))
    return p.join(t, ["bx", "by"]).filter(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y"))).drop("bx", "by")


def corner_ghosts(points: DataFrame, tiles: DataFrame, k: int = 4) -> DataFrame:
    """The elevation at each tile's corners by inverse squared distance from the k nearest ground points of the tile."""
    corners = F.array(*[F.struct(F.lit(i).alias("corner"), F.col(x).alias("gx"), F.col(y).alias("gy")) for i, (x, y) in enumerate([("min_x", "min_y"), ("max_x", "min_y"), ("max_x", "max_y"), ("min_x", "max_y")])])
    c = tiles.select("tile_id", F.explode(corners).alias("c")).select("tile_id", "c.*")
    d2 = (F.col("x") - F.col("gx")) * (F.col("x") - F.col("gx")) + (F.col("y") - F.col("gy")) * (F.col("y") - F.col("gy"))
    near = points.join(F.broadcast(c), "tile_id").withColumn("d2", F.greatest(d2, F.lit(2.220446049250313e-16)))
    near = among_least(near.select("tile_id", "corner", "gx", "gy", "d2", "x", "y", "z"), ["tile_id", "corner"], "d2", k)
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("tile_id", "corner").orderBy("d2", "x", "y", "z"))).filter(F.col("rank") <= k)
    return near.groupBy("tile_id", "corner", "gx", "gy").agg((F.sum(F.col("z") / F.col("d2")) / F.sum(1 / F.col("d2"))).alias("z"))

"""Which polygons hold a point: an equi-join on grid cells, and ray casting only where a polygon's edge runs.

Each polygon is laid over a grid once. A cell that no edge can touch is inside or
outside as a whole; points there need no geometry. Cells near an edge send their
points to the exact test. So the work grows with the points near edges, and no
point meets a polygon whose cells it isn't in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handbill.functions import vocab

RING = "array<struct<x:double,y:double>>"


def edges(ring: Column) -> Column:
    """The edges of a ring, the one from its last point to its first included; a closed ring's has no length."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the east from the point crosses the ring an odd number of times. Lower and left edges belong to it, upper and right don't."""

    def crosses(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def cells(polygons: DataFrame, size: float, key: str = "polygon") -> DataFrame:
    """(key, cx, cy, whole): the cells of ``size`` that a polygon (key, ring) covers; ``whole`` if all of the cell is inside."""
    low = lambda axis: F.floor(F.array_min(F.transform("ring", lambda p: p[axis])) / size).cast("long")
    high = lambda axis: F.floor(F.array_max(F.transform("ring", lambda p: p[axis])) / size).cast("long")
    columns = polygons.where(F.size("ring") > 2).select(key, "ring", F.explode(F.sequence(low("x"), high("x"))).alias("cx"), low("y").alias("_lo"), high("y").alias("_hi"))
    grid = columns.select(key, "ring", "cx", F.explode(F.sequence("_lo", "_hi")).alias("cy"))
    # An edge whose box doesn't reach the cell can't cut it; a hair is added for the rounding of the borders.
    hair = size * 1e-6
    near = lambda e: (
        (F.least(e["x1"], e["x2"]) <= (F.col("cx") + 1) * size + hair) & (F.greatest(e["x1"], e["x2"]) >= F.col("cx") * size - hair)
        & (F.least(e["y1"], e["y2"]) <= (F.col("cy") + 1) * size + hair) & (F.greatest(e["y1"], e["y2"]) >= F.col("cy") * size - hair)
    )
    told = grid.select(key, "cx", "cy", F.exists(edges(F.col("ring")), near).alias("_edge"), holds(F.col("ring"), (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size).alias("_inside"))
    return told.where("_edge OR _inside").select(key, "cx", "cy", (~F.col("_edge")).alias("whole"))


def points_in(points: DataFrame, polygons: DataFrame, size: float, key: str = "polygon", x: str = "lng", y: str = "lat") -> DataFrame:
    """``points`` with the ``key`` of each polygon (key, ring) that holds them, a row each; points in none are left out.

    A polygon of several rings is several rows with one key; its rings don't overlap.
    """
    # Rings get a number of their own, as one key may have several.
    rings = polygons.select(key, "ring", F.xxhash64(key, "ring").alias("_ring"))
    grid = cells(rings, size, "_ring")
    placed = points.withColumns({"cx": F.floor(F.col(x) / size).cast("long"), "cy": F.floor(F.col(y) / size).cast("long")})
    met = placed.join(grid, ["cx", "cy"]).drop("cx", "cy")
    known = met.join(rings, "_ring")
    inside = F.col("whole") | holds(F.col("ring"), F.col(x), F.col(y))
    return known.where(inside).drop("_ring", "ring", "whole")


def region_rings(spark) -> DataFrame:
    """The regions as polygons (polygon, ring)."""
    rows = [(name, [(w, s), (e, s), (e, n), (w, n)]) for name, w, s, e, n in vocab.REGION_BOXES]
    return spark.createDataFrame(rows, f"polygon string, ring {RING}")

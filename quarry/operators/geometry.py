"""Boxes on pages: spans for either origin, overlap, best match by overlap, and the nearest item above.

Edge cases: boxes with a null side overlap nothing and are above nothing; empty boxes overlap nothing; rows with a null
page have no partner; ties go to the smallest id; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_left(y0: Column, y1: Column, height: Column, origin: Column) -> tuple[Column, Column]:
    """Top and bottom measured downwards from the page's top, whatever the origin of (y0, y1)."""
    up = origin == "bottomleft"
    return F.when(up, height - F.greatest(y0, y1)).otherwise(F.least(y0, y1)), F.when(up, height - F.least(y0, y1)).otherwise(F.greatest(y0, y1))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1), 0 where the union is empty."""
    zero = F.lit(0.0)
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), zero) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), zero)
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


_BOX = ("x0", "y0", "x1", "y1")


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """keys, id, match, score: for each left box the right box on the same page with the most overlap, the first on ties."""
    r = right.select(*keys, F.col("id").alias("match"), *(F.col(c).alias(f"r_{c}") for c in _BOX))
    j = left.join(r, keys).withColumn("score", iou(tuple(map(F.col, _BOX)), tuple(F.col(f"r_{c}") for c in _BOX))).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy(*keys, "id").orderBy(F.desc("score"), "match"))
    return j.withColumn("_r", best).where("_r = 1").select(*keys, "id", "match", "score")


def nearest_above(targets: DataFrame, items: DataFrame, keys: list[str], tolerance: float = 2.0) -> DataFrame:
    """keys, id, above: of the items of a page that end above a target (within tolerance), one in the same columns before others, then the nearest, then the first.

    Both sides have id, x0, x1, top and bottom, measured upwards from the page's foot.
    """
    i = items.select(*keys, F.col("id").alias("above"), F.col("x0").alias("i_x0"), F.col("x1").alias("i_x1"), F.col("bottom").alias("i_bottom"))
    j = targets.join(i, keys).where(F.col("i_bottom") >= F.col("top") - tolerance)
    side = F.when((F.col("i_x0") < F.col("x1")) & (F.col("x0") < F.col("i_x1")), 0).otherwise(1)
    best = F.row_number().over(Window.partitionBy(*keys, "id").orderBy(side, F.col("i_bottom") - F.col("top"), "above"))
    return j.withColumn("_r", best).where("_r = 1").select(*keys, "id", "above")


def unique_boxes(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row, the first in order, of those with equal keys whose x0 and y0 round (half to even) to the same numbers."""
    w = Window.partitionBy(*keys, F.rint("x0"), F.rint("y0")).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def bands(cells: DataFrame, keys: list[str], index: str, low: str, high: str) -> DataFrame:
    """keys, index, low, high: what the cells of each row or column cover together."""
    return cells.groupBy(*keys, index).agg(F.min(low).alias("low"), F.max(high).alias("high"))

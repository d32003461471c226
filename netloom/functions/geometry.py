"""Box and point expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two structs x0, y0, x1, y1; 0 where they don't overlap or have no area."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    inter = F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))
    union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - inter
    return F.when((inter > 0) & (union > 0), inter.cast("double") / union.cast("double")).otherwise(F.lit(0.0))


def rotated(x: Column, y: Column, degrees: Column) -> Column:
    """A point of the unit square turned by 0, 90, 180 or 270 degrees, as struct x, y; other angles raise an error."""
    turn = F.pmod(degrees, F.lit(360))
    pair = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    wrong = F.raise_error(F.concat(F.lit("orientation "), degrees.cast("string"))).cast("struct<x:double,y:double>")
    return F.when(turn == 0, pair(x, y)).when(turn == 90, pair(1 - y, x)).when(turn == 180, pair(1 - x, 1 - y)).when(turn == 270, pair(y, 1 - x)).otherwise(wrong)


def in_box(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The pixel place of a point given in a box's unit square, as struct x, y."""
    return F.struct((x0 + x * (x1 - x0)).alias("x"), (y0 + y * (y1 - y0)).alias("y"))


def horizontal(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.abs(x1 - x0) >= F.abs(y1 - y0)


def circularity(area: Column, perimeter: Column) -> Column:
    """4 pi A / P^2; null for a perimeter of zero."""
    return F.when(perimeter > 0, 4 * F.pi() * area / (perimeter * perimeter))


def manhattan(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.abs(x0 - x1) + F.abs(y0 - y1)


def symbol_point(x: Column, y: Column, turn: Column) -> Column:
    """A point of a symbol in its drawing: (-y, x) of symbols that are turned by R90, as it is of others."""
    return F.struct(F.when(turn == "R90", -y).otherwise(x).alias("x"), F.when(turn == "R90", x).otherwise(y).alias("y"))


def extent(area: Column, w: Column, h: Column) -> Column:
    """The part of its box that a shape fills; 0 for a box without area."""
    return F.when(w * h > 0, area / (w * h)).otherwise(0.0)


def aspect(w: Column, h: Column) -> Column:
    """Width by height, which counts as one at least."""
    return w / F.greatest(h, F.lit(1))

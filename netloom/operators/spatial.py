"""Spatial joins over a grid, and ordered folds over the boxes of a picture.

Catalyst has no range join: a point or box becomes a row for each grid cell it touches, cells meet by an equi-join on picture and
cell, and the true predicate is checked on what meets. The greedy operators need an order; they fold over the boxes of
one picture, whose number the picture bounds, sorted by confidence and then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_iou

BOX = ("x0", "y0", "x1", "y1")


def near_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: int) -> DataFrame:
    """df with a row for each grid cell (cx, cy) that the box touches; none for a box turned inside out."""
    along = lambda a, b: F.when(a <= b, F.sequence(F.floor(a / cell), F.floor(b / cell)))
    return df.withColumn("cx", F.explode(along(x0, x1))).withColumn("cy", F.explode(along(y0, y1)))


def _box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + x).alias(x) for x in BOX])


def iou_pairs(boxes: DataFrame, threshold: float, cell: int = 64) -> DataFrame:
    """image_id, a, b (a < b), iou of boxes of one picture that overlap by threshold or more, each pair once."""
    cells = near_cells(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)
    a = cells.select("image_id", "cx", "cy", F.col("det_id").alias("a"), _box().alias("p"))
    b = cells.select("image_id", "cx", "cy", F.col("det_id").alias("b"), _box().alias("q"))
    met = a.join(b, ["image_id", "cx", "cy"]).where("a < b")
    # a pair shares many cells: it counts in the first one that both touch
    first = (F.col("cx") == F.floor(F.greatest("p.x0", "q.x0") / cell)) & (F.col("cy") == F.floor(F.greatest("p.y0", "q.y0") / cell))
    return met.where(first).select("image_id", "a", "b", box_iou(F.col("p"), F.col("q")).alias("iou")).where(F.col("iou") >= threshold)


def _sorted_boxes(boxes: DataFrame) -> DataFrame:
    """image_id, boxes: those of a picture by confidence, highest first, and then id."""
    item = F.struct((-F.col("conf")).alias("rank"), "det_id", *BOX)
    return boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias("boxes"))


def nms(boxes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The boxes that greedy suppression keeps: by confidence, each that overlaps no kept one by more than threshold, whatever the class."""
    grouped = _sorted_boxes(boxes)
    kind = grouped.schema["boxes"].dataType.simpleString()
    keep = F.aggregate("boxes", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: box_iou(k, x) > threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return grouped.select("image_id", F.explode(keep).alias("k")).select("image_id", "k.det_id", (-F.col("k.rank")).alias("conf"), *[f"k.{x}" for x in BOX])


def novel_boxes(present: DataFrame, offered: DataFrame, threshold: float = 0.5, cell: int = 64) -> DataFrame:
    """Offered boxes, in order, that overlap neither a present one nor one added before by threshold or more.

    Of equal boxes that overlap each other so, none but the first can be added; and what overlaps a present box is found by a join over the grid.
    So the fold sees the different boxes that are left.
    """
    at = ["image_id", *BOX]
    rows = offered.select("det_id", "conf", *at).withColumn("twins", box_iou(_box(), _box()) >= threshold)
    first = rows.where("twins").groupBy(*at).agg(F.min(F.struct((-F.col("conf")).alias("rank"), "det_id", "conf")).alias("f"))
    rest = first.select("f.det_id", "f.conf", *at).unionByName(rows.where("not twins").drop("twins"))
    if threshold > 0:  # such boxes share a cell
        cells = lambda df, name: near_cells(df.select(*at).distinct(), *map(F.col, BOX), cell).select("image_id", "cx", "cy", _box().alias(name))
        met = cells(rest, "p").join(cells(present, "q"), ["image_id", "cx", "cy"]).where(box_iou(F.col("q"), F.col("p")) >= threshold)
        rest = rest.join(met.select("image_id", "p.*").distinct(), at, "left_anti")
    else:
        rest = rest.join(present.select("image_id").distinct(), "image_id", "left_anti")
    new = _sorted_boxes(rest)
    kind = new.schema["boxes"].dataType.simpleString()
    added = F.aggregate("boxes", F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: box_iou(k, x) >= threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return new.select("image_id", F.explode(added).alias("k")).select("image_id", "k.det_id", (-F.col("k.rank")).alias("conf"), *[f"k.{x}" for x in BOX])


def merge_confident(present: DataFrame, offered: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Present boxes after each offered one, in order of id, was added if it overlaps none, or took the place of all it overlaps if its confidence is higher."""
    item = F.struct("det_id", "conf", *BOX)
    gather = lambda df, name: df.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias(name))
    both = gather(present, "held").join(gather(offered, "offered"), "image_id", "full")
    kind = both.schema["held"].dataType.simpleString()
    none = F.array().cast(kind)

    def step(held: Column, x: Column) -> Column:
        twin = lambda k: box_iou(k, x) >= threshold
        least = F.array_max(F.transform(F.filter(held, twin), lambda k: k["conf"]))
        rest = F.filter(held, lambda k: ~twin(k))
        return F.when(least.isNull(), F.concat(held, F.array(x))).when(x["conf"] > least, F.concat(rest, F.array(x))).otherwise(held)

    out = F.aggregate(F.coalesce("offered", none), F.coalesce("held", none), step)
    return both.select("image_id", F.explode(out).alias("k")).select("image_id", "k.*")


def points_near_boxes(points: DataFrame, boxes: DataFrame, margin: float = 0, near: bool = True, cell: int = 64) -> DataFrame:
    """Points (image_id, point_id, x, y) that lie within margin of a box of their picture, or near=False: of none."""
    cells = near_cells(boxes.select(F.col("image_id").alias("bi"), *BOX), F.col("x0") - margin, F.col("y0") - margin, F.col("x1") + margin, F.col("y1") + margin, cell)
    on = (points["image_id"] == cells["bi"]) & (F.floor(points["x"] / cell) == cells["cx"]) & (F.floor(points["y"] / cell) == cells["cy"])
    on &= points["x"].between(cells["x0"] - margin, cells["x1"] + margin) & points["y"].between(cells["y0"] - margin, cells["y1"] + margin)
    return points.join(cells, on, "left_semi" if near else "left_anti")


def nearest(points: DataFrame, targets: DataFrame, radius: int) -> DataFrame:
    """image_id, point_id, target_id, dist: the target of least Manhattan distance, at most radius, of the points that have one; the least id on ties.

    points: image_id, point_id, x, y; targets: image_id, target_id, x, y. Cells are as wide as the radius: a place meets nine. Places meet, not
    points: of the targets at one place the least id stands for all, and the points at one place have the same answer.
    """
    place = ["image_id", "x", "y"]
    wide = near_cells(points.select(*place).distinct(), F.col("x") - radius, F.col("y") - radius, F.col("x") + radius, F.col("y") + radius, radius)
    at = targets.groupBy(*place).agg(F.min("target_id").alias("target_id"))
    at = at.select("image_id", "target_id", F.col("x").alias("tx"), F.col("y").alias("ty"), F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    dist = F.abs(F.col("x") - F.col("tx")) + F.abs(F.col("y") - F.col("ty"))
    met = wide.join(at, ["image_id", "cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= radius)
    best = met.groupBy(*place).agg(F.min(F.struct("dist", "target_id")).alias("best"))
    found = points.select("point_id", *place).join(best, place).groupBy("image_id", "point_id").agg(F.min("best").alias("best"))
    return found.select("image_id", "point_id", "best.target_id", "best.dist")


def proposal_merge(first: DataFrame, more: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Proposal boxes (image_id, det_id, n, box): each of more, by id, joins first if it overlaps none by threshold, else it replaces the most overlapped one if it has more points."""
    item = F.struct("det_id", "n", *BOX)
    gather = lambda df, name: df.groupBy("image_id").agg(F.array_sort(F.collect_list(item)).alias(name))
    both = gather(first, "held").join(gather(more, "more"), "image_id", "full")
    none = F.array().cast(both.schema["held"].dataType.simpleString())

    def step(held: Column, x: Column) -> Column:
        best = F.array_max(F.transform(held, lambda k, i: F.struct(box_iou(k, x).alias("iou"), (-i).alias("turn"), k["n"].alias("n"))))
        swapped = F.transform(held, lambda k, i: F.when(-i == best["turn"], x).otherwise(k))
        return F.when(best.isNull() | (best["iou"] < threshold), F.concat(held, F.array(x))).when(x["n"] > best["n"], swapped).otherwise(held)

    out = F.aggregate(F.coalesce("more", none), F.coalesce("held", none), step)
    return both.select("image_id", F.explode(out).alias("k")).select("image_id", "k.*")


def first_per_cell(points: DataFrame, order: list[str], grid: int = 8) -> DataFrame:
    """The first point, by order, of each grid cell of a picture (image_id, x, y)."""
    gx, gy = F.floor(F.col("x") / grid), F.floor(F.col("y") / grid)
    first = points.groupBy("image_id", gx.alias("gx"), gy.alias("gy")).agg(F.min(F.struct(*order, *[c for c in points.columns if c not in order])).alias("f"))
    return first.select(*[f"f.{c}" for c in points.columns])


def points_near_points(points: DataFrame, others: DataFrame, radius: int, near: bool = True) -> DataFrame:
    """Points (image_id, x, y) within radius, as the crow flies, of another table's point of their picture, or near=False: of none."""
    wide = near_cells(others.select(F.col("image_id").alias("oi"), F.col("x").alias("ox"), F.col("y").alias("oy")), F.col("ox") - radius, F.col("oy") - radius, F.col("ox") + radius, F.col("oy") + radius, radius)
    on = (points["image_id"] == wide["oi"]) & (F.floor(points["x"] / radius) == wide["cx"]) & (F.floor(points["y"] / radius) == wide["cy"])
    on &= (points["x"] - wide["ox"]) * (points["x"] - wide["ox"]) + (points["y"] - wide["oy"]) * (points["y"] - wide["oy"]) <= radius * radius
    return points.join(wide, on, "left_semi" if near else "left_anti")

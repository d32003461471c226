"""Pins from components: templates by class, sides with wire, exits of an axis, orientation scores, stubs of integrated circuits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import in_box, rotated
from ..model import ICS, NO_PINS, is_in, template_dimension
from .islands import profile_runs


def template_pins(comps: DataFrame) -> DataFrame:
    """comp_id, role, x, y, conf: the pins of each component's class, turned by its orientation and put in its box.

    Integrated circuits have max(2, round(8 h / max(w, h))) pins on either side; classes without pins give none, unknown ones two at confidence 0.5.
    """
    dim = F.broadcast(template_dimension(comps.sparkSession))  # of fixed size
    box = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    known = comps.join(dim, "cls").select("comp_id", "role", "nx", "ny", "pin_conf", "orientation", "x0", "y0", "x1", "y1")
    other = comps.where(~is_in("cls", ICS + NO_PINS)).join(dim.select("cls").distinct(), "cls", "left_anti")
    pair = F.explode(F.array(F.struct(F.lit("p0").alias("role"), F.lit(0.0).alias("nx")), F.struct(F.lit("p1").alias("role"), F.lit(1.0).alias("nx"))))
    other = other.withColumn("p", pair).select("comp_id", "p.role", "p.nx", F.lit(0.5).alias("ny"), F.lit(0.5).alias("pin_conf"), "orientation", "x0", "y0", "x1", "y1")
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    n = F.greatest(F.lit(2), F.bround(h / F.greatest(w, h) * 8).cast("int"))  # halves go to the even number
    ics = comps.where(is_in("cls", ICS)).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    ics = ics.select("comp_id", F.concat("side", F.col("i").cast("string")).alias("role"), F.when(F.col("side") == "L", 0.0).otherwise(1.0).alias("nx"), ((F.col("i") + 1) / (F.col("n") + 1)).alias("ny"), F.lit(0.5).alias("pin_conf"), "orientation", "x0", "y0", "x1", "y1")
    every = known.unionByName(other).unionByName(ics)
    turned = rotated(F.col("nx"), F.col("ny"), F.col("orientation"))
    placed = every.withColumn("t", turned).withColumn("p", in_box(F.col("t.x"), F.col("t.y"), *box))
    return placed.select("comp_id", "role", F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("pin_conf").alias("conf"))


def edge_profiles(boxes: DataFrame, pixels: DataFrame, pad: int = 10, least: int = 2, cell: int = 64) -> DataFrame:
    """image_id, det_id, edge (left, right, top, bottom), place, support: where along each edge of a box the strip outside holds most wire; the first place on ties."""
    from .spatial import near_cells

    wide = near_cells(boxes, F.col("x0") - pad, F.col("y0") - pad, F.col("x1") + pad, F.col("y1") + pad, cell)
    at = pixels.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    met = wide.join(at, ["image_id", "cx", "cy"])
    across, down = F.col("py").between(F.col("y0"), F.col("y1")), F.col("px").between(F.col("x0"), F.col("x1"))
    strips = {"left": (across & F.col("px").between(F.col("x0") - pad, F.col("x0") - 1), "py"), "right": (across & F.col("px").between(F.col("x1") + 1, F.col("x1") + pad), "py"), "top": (down & F.col("py").between(F.col("y0") - pad, F.col("y0") - 1), "px"), "bottom": (down & F.col("py").between(F.col("y1") + 1, F.col("y1") + pad), "px")}
    edge = F.coalesce(*[F.when(test, F.struct(F.lit(name).alias("edge"), F.col(place).alias("place"))) for name, (test, place) in strips.items()])
    counts = met.withColumn("e", edge).where("e is not null").groupBy("image_id", "det_id", "e.edge", "e.place").agg(F.count(F.lit(1)).alias("support"))
    best = counts.groupBy("image_id", "det_id", "edge").agg(F.min(F.struct((-F.col("support")).alias("s"), "place")).alias("b"))
    return best.select("image_id", "det_id", "edge", "b.place", (-F.col("b.s")).alias("support")).where(F.col("support") >= least)


def axis_exits(degrees: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Where a line at this angle through the middle of a box leaves it: an array of two points, sorted."""
    cx, cy, a = (x0 + x1) / 2, (y0 + y1) / 2, F.radians(degrees)
    dx, dy = F.cos(a), F.sin(a)
    far = F.least(F.when(F.abs(dx) > 1e-9, (x1 - x0) / 2 / F.abs(dx)).otherwise(1e18), F.when(F.abs(dy) > 1e-9, (y1 - y0) / 2 / F.abs(dy)).otherwise(1e18))
    point = lambda s: F.struct((cx + s * far * dx).alias("x"), (cy + s * far * dy).alias("y"))
    return F.array_sort(F.array(point(-1), point(1)))


def disc_scores(pins: DataFrame, dark: DataFrame, half: int = 5) -> DataFrame:
    """pin_id, score: the share of dark pixels in the square around each pin."""
    from .spatial import near_cells

    wide = near_cells(pins.select("image_id", "pin_id", F.round("x").alias("qx"), F.round("y").alias("qy")), F.col("qx") - half, F.col("qy") - half, F.col("qx") + half, F.col("qy") + half, 32)
    at = dark.select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / 32).alias("cx"), F.floor(F.col("y") / 32).alias("cy"))
    near = (F.abs(F.col("px") - F.col("qx")) <= half) & (F.abs(F.col("py") - F.col("qy")) <= half)
    met = wide.join(at, ["image_id", "cx", "cy"], "left").groupBy("pin_id").agg(F.sum(F.when(near, 1).otherwise(0)).alias("n"))
    return met.select("pin_id", (F.col("n") / float((2 * half + 1) ** 2)).alias("score"))


def orientation_choice(scores: DataFrame, margin: float = 1.5, least: float = 0.1) -> DataFrame:
    """comp_id, orientation: the angle of the best score if it is over least and margin times the next, else the present one (angle 0 of scores on ties)."""
    ranked = scores.groupBy("comp_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("score", (-F.col("orientation")).alias("turn"))))).alias("r"), F.first("present").alias("present"))
    first, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    clear = (first["score"] > least) & (first["score"] >= margin * F.coalesce(second["score"], F.lit(0.0)))
    return ranked.select("comp_id", F.when(clear, -first["turn"]).otherwise(F.col("present")).alias("orientation"))


def stub_pins(bins: DataFrame, least: int = 4) -> DataFrame:
    """det_id, side, run, centre, support: pins of integrated circuits where wire leaves a side; boxes with fewer than two give none. bins: det_id, side, place, weight."""
    runs = profile_runs(bins, ["det_id", "side"], "place", "weight", 3, least)
    enough = runs.groupBy("det_id").count().where("count >= 2").select(F.col("det_id").alias("_det"))
    return runs.join(enough, runs["det_id"] == enough["_det"], "left_semi")


def snapped_pins(comps: DataFrame, templates: DataFrame, edges: DataFrame, axes: DataFrame, off: float = 20.0) -> DataFrame:
    """comp_id, role, x, y, source of the pins of two-terminal parts: where their axis leaves the box if it lies more than `off` degrees off both sides'
    directions, else on the places where both facing sides have wire, else by the template.

    comps: comp_id, x0, y0, x1, y1; templates: comp_id, role, x, y; edges: comp_id, edge, place; axes: comp_id, degrees (null: no axis).
    """
    place = lambda e: F.max(F.when(F.col("edge") == e, F.col("place"))).alias(e)
    sides = edges.groupBy("comp_id").agg(*[place(e) for e in ("left", "right", "top", "bottom")])
    rows = templates.join(comps.select("comp_id", "x0", "y0", "x1", "y1"), "comp_id").join(sides, "comp_id", "left").join(axes.select("comp_id", "degrees"), "comp_id", "left")
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    tilt = F.pmod(F.col("degrees"), F.lit(90.0))
    slanted = F.col("degrees").isNotNull() & (F.least(tilt, 90 - tilt) > off)
    first = F.col("role") == "p0"
    exits = axis_exits(F.col("degrees"), *box)
    exit_ = F.when(first, F.get(exits, F.lit(0))).otherwise(F.get(exits, F.lit(1)))
    point = lambda x, y, source: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(source).alias("source"))
    lying = F.col("left").isNotNull() & F.col("right").isNotNull()
    standing = F.col("top").isNotNull() & F.col("bottom").isNotNull()
    at = (
        F.when(slanted, point(exit_["x"], exit_["y"], "axis"))
        .when(lying, point(F.when(first, F.col("x0")).otherwise(F.col("x1")), F.when(first, F.col("left")).otherwise(F.col("right")), "edge"))
        .when(standing, point(F.when(first, F.col("top")).otherwise(F.col("bottom")), F.when(first, F.col("y0")).otherwise(F.col("y1")), "edge"))
        .otherwise(point(F.col("x"), F.col("y"), "template"))
    )
    return rows.select("comp_id", "role", at.alias("p")).select("comp_id", "role", "p.x", "p.y", "p.source")

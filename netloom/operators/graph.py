"""Graphs of components and nets: degrees, backbone, spanning trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship


def incidence(pins: DataFrame) -> DataFrame:
    """comp_id, net, n: the edges of the graph of components and nets, never of components with each other."""
    return pins.where("net is not null").groupBy("comp_id", "net").agg(F.count(F.lit(1)).alias("n"))


def backbone(pins: DataFrame, least: int = 3) -> DataFrame:
    """comp_id, net, n of the edges to nets of at least `least` pins."""
    big = pins.where("net is not null").groupBy("net").agg(F.count(F.lit(1)).alias("fanout")).where(F.col("fanout") >= least).select("net")
    return incidence(pins).join(big, "net", "left_semi")


def spanning_wires(points: DataFrame) -> DataFrame:
    """net, x0, y0, x1, y1: the edges of a least Manhattan spanning tree over each net's points (net, x, y), by Prim from the least point.

    Points of one net of one picture are seen together; the ground net, which has pins everywhere, is drawn as flags and isn't given here.
    """
    ship(points.sparkSession)

    def tree(net: int, p: np.ndarray, out: list[tuple]) -> None:
        far, near = np.abs(p - p[0]).sum(axis=1), np.zeros(len(p), int)
        far[0] = -1
        for _ in range(len(p) - 1):
            i = int(np.where(far >= 0, far, np.iinfo(np.int64).max).argmin())
            out.append((net, *p[near[i]], *p[i]))
            d = np.abs(p - p[i]).sum(axis=1)
            closer = (far >= 0) & (d < far)
            far[closer], near[closer] = d[closer], i
            far[i] = -1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[["net", "x", "y"]].drop_duplicates().sort_values(["net", "x", "y"]).to_numpy()
        out: list[tuple] = []
        for part in np.split(p, np.flatnonzero(np.diff(p[:, 0])) + 1):
            if len(part) > 1:
                tree(part[0, 0], part[:, 1:], out)
        return pd.DataFrame(out, columns=["net", "x0", "y0", "x1", "y1"])

    # many nets a group: most have a handful of points, and each group costs a call
    shards = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.select("net", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    return rows.groupBy(F.pmod(F.xxhash64("net"), F.lit(shards))).applyInPandas(run, "net bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint")


def spread(points: DataFrame, by: list[str], factor: float = 1.6) -> DataFrame:
    """points with sx, sy: places moved away from the centre of their picture."""
    centre = points.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    out = points.join(centre, by)
    return out.withColumn("sx", F.col("_mx") + factor * (F.col("x") - F.col("_mx"))).withColumn("sy", F.col("_my") + factor * (F.col("y") - F.col("_my"))).drop("_mx", "_my")


def greedy_pairs(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """by, left_id, right_id, dist: pairs in order of Manhattan distance, each point in one pair at most; ties by ids.

    left, right: by, id, x, y; a group holds the few pins of one symbol.
    """
    a = left.select(by, F.col("id").alias("left_id"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = right.select(by, F.col("id").alias("right_id"), F.col("x").alias("bx"), F.col("y").alias("by_"))
    dist = F.abs(F.col("ax") - F.col("bx")) + F.abs(F.col("ay") - F.col("by_"))
    every = a.join(b, by).select(by, F.struct(dist.alias("dist"), "left_id", "right_id").alias("p"))
    grouped = every.groupBy(by).agg(F.array_sort(F.collect_list("p")).alias("ps"))
    kind = grouped.schema["ps"].dataType.simpleString()
    taken = lambda held, p: F.exists(held, lambda h: (h["left_id"] == p["left_id"]) | (h["right_id"] == p["right_id"]))
    held = F.aggregate("ps", F.array().cast(kind), lambda s, p: F.when(taken(s, p), s).otherwise(F.concat(s, F.array(p))))
    return grouped.select(by, F.explode(held).alias("h")).select(by, "h.left_id", "h.right_id", "h.dist")

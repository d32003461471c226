"""Schematic drawings as text commands: placements, wires, flags, and parsing of drawings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import horizontal
from ..model import AXIAL2, BJT, CAP, DIODE, FET, GROUND, IND, RES, SOURCES2, is_in


def symbol_of(cls: Column) -> Column:
    """The drawing symbol of a class."""
    table = [(RES, "res"), (CAP, "cap"), (IND, "ind"), (DIODE, "diode"), (["npn", "transistor.bjt"], "npn"), (["pnp"], "pnp"), ([x for x in FET if not x.startswith("pmos")], "nmos"), ([x for x in FET if x.startswith("pmos")], "pmos")]
    out = F.when(cls.startswith("current"), "current").when(is_in(cls, SOURCES2), "voltage").when(is_in(cls, AXIAL2), "res")
    for family, symbol in reversed(table):
        out = F.when(is_in(cls, family), symbol).otherwise(out)
    return out


def placements(comps: DataFrame, grid: int = 16) -> DataFrame:
    """comp_id, symbol, x, y, turn (R0, R90): symbols at the grid point of their box's corner; wide two-terminal parts lie."""
    lying = horizontal(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) & is_in("cls", AXIAL2 + SOURCES2)
    snap = lambda c: (F.floor(F.col(c) / grid + 0.5) * grid).cast("bigint")
    return comps.select("comp_id", symbol_of(F.col("cls")).alias("symbol"), snap("x0").alias("x"), snap("y0").alias("y"), F.when(lying, "R90").otherwise("R0").alias("turn")).where("symbol is not null")


def wire_text(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The WIRE commands from one point to another, along first and then up or down; pieces without length are left out."""
    wire = lambda a, b, c, d: F.when((a != c) | (b != d), F.concat_ws(" ", F.lit("WIRE"), a.cast("string"), b.cast("string"), c.cast("string"), d.cast("string")))
    return F.filter(F.array(wire(x0, y0, x1, y0), wire(x1, y0, x1, y1)), lambda x: x.isNotNull())


def drawing(placed: DataFrame, pins: DataFrame, wires: DataFrame) -> DataFrame:
    """section, a, text: SHEET, wires, a FLAG for each pin's net, and symbols with their names; sort by section and a.

    pins: pin_id, x, y, enet; wires: x0, y0, x1, y1.
    """
    spark = placed.sparkSession
    head = spark.createDataFrame([(0, 0, "Version 4"), (0, 1, "SHEET 1 4000 4000")], "section int, a bigint, text string")
    lines = wires.select(F.lit(1).alias("section"), F.xxhash64("x0", "y0", "x1", "y1").alias("a"), F.explode_outer(wire_text(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("text")).where("text is not null")
    name = F.when(F.col("enet") == GROUND, "0").otherwise(F.concat(F.lit("N"), F.col("enet").cast("string")))
    flags = pins.where("enet is not null").select(F.lit(2).alias("section"), F.col("pin_id").alias("a"), F.concat_ws(" ", F.lit("FLAG"), F.col("x").cast("bigint").cast("string"), F.col("y").cast("bigint").cast("string"), name).alias("text"))
    letter = F.when(F.col("symbol").isin("npn", "pnp"), "Q").when(F.col("symbol").isin("nmos", "pmos"), "M").otherwise(F.upper(F.substring("symbol", 1, 1)))
    symbol = F.concat_ws(" ", F.lit("SYMBOL"), "symbol", F.col("x").cast("string"), F.col("y").cast("string"), "turn")
    attr = F.concat(F.lit("SYMATTR InstName "), letter, F.col("comp_id").cast("string"))
    symbols = placed.select(F.lit(3).alias("section"), F.posexplode(F.array(symbol, attr)).alias("i", "text"), "comp_id").select("section", (F.col("comp_id") * 2 + F.col("i")).alias("a"), "text")
    return head.unionByName(lines).unionByName(flags).unionByName(symbols)


def parse_drawing(lines: DataFrame) -> DataFrame:
    """lines (line_no, text) with command and args, of drawing commands."""
    words = F.split(F.trim("text"), r"\s+")
    known = F.col("command").isin("SHEET", "WIRE", "FLAG", "SYMBOL", "SYMATTR", "TEXT", "RECTANGLE", "WINDOW")
    return lines.withColumn("command", words[0]).withColumn("args", F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).where(known)


def is_transistor(cls: Column) -> Column:
    return is_in(cls, BJT + FET)


def snap_or_not(draw: Callable[[int], DataFrame], verify: Callable[[DataFrame], DataFrame], tolerance: int = 10) -> tuple[DataFrame, int]:
    """A drawing with rails snapped by tolerance, or without snapping where verify (rows that don't match) finds anything in it; and the tolerance used."""
    drawn = draw(tolerance)
    return (drawn, tolerance) if verify(drawn).isEmpty() else (draw(0), 0)

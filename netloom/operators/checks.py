"""Electrical rule checks: flags and counts over components and pins, each a join or aggregate on net or component ids.

All checks use raw nets; electrical_short is the same question after ground nets are one. A null net is a dangling pin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import GROUND, GROUND1, ICS, RAIL1, SOURCE_LIKE, TWO_TERMINAL, XFORMER, contract_of, is_in


def net_fanout(pins: DataFrame, net: str = "net") -> DataFrame:
    """net, fanout: pins on each net; dangling pins have none."""
    return pins.where(F.col(net).isNotNull()).groupBy(net).agg(F.count(F.lit(1)).alias("fanout"))


def lonely_pins(pins: DataFrame, net: str = "net") -> DataFrame:
    """Pins without a net or alone on theirs. Dangling pins keep out of the join, where their nulls would meet in one task."""
    lone = net_fanout(pins, net).where("fanout = 1").select(net)
    return pins.where(F.col(net).isNull()).unionByName(pins.where(F.col(net).isNotNull()).join(lone, net, "left_semi").select(*pins.columns))


def ground_nets(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """net: the distinct raw nets that a ground symbol's pin is on. Ground symbols are a share of all components, so they meet by a merge join."""
    grounds = comps.where(is_in("cls", GROUND1)).select("comp_id")
    return pins.where(F.col("net").isNotNull()).join(grounds.hint("merge"), "comp_id", "left_semi").select("net").distinct()


def electrical_nets(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """pins with enet: GROUND where the raw net is a ground net, else the raw net.

    The ground nets are few for a picture but not for a corpus, so the join isn't forced; adaptive execution broadcasts them if they are small.
    """
    grounds = ground_nets(comps, pins).select(F.col("net").alias("ground_net"))
    joined = pins.where("net is not null").join(grounds, F.col("net") == F.col("ground_net"), "left").unionByName(pins.where("net is null").withColumn("ground_net", F.lit(None).cast("bigint")))
    return joined.withColumn("enet", F.when(F.col("ground_net").isNotNull(), F.lit(GROUND).cast("bigint")).otherwise(F.col("net"))).drop("ground_net")


def _terminals(comps: DataFrame, pins: DataFrame, family: list[str], net: str = "net") -> DataFrame:
    """comp_id, cls, n_pins, n_live, n_nets, low, high of the components of a family, also those without pins."""
    of = comps.where(is_in("cls", family)).select("comp_id", "cls")
    seen = pins.groupBy("comp_id").agg(F.count(F.lit(1)).alias("n_pins"), F.count(net).alias("n_live"), F.min(net).alias("low"), F.max(net).alias("high"))
    return of.join(seen, "comp_id", "left").na.fill(0, ["n_pins", "n_live"])


def two_terminal(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """comp_id, cls, code of two-terminal parts: PIN_COUNT, OPEN, SHORTED (alone on its net), PARALLEL (both pins on a shared net; no fault), OK."""
    rows = _terminals(comps, pins, TWO_TERMINAL)
    fan = net_fanout(pins).withColumnRenamed("net", "low")
    rows = rows.join(fan, "low", "left")
    code = F.when(F.col("n_pins") != 2, "PIN_COUNT").when(F.col("n_live") < 2, "OPEN").when((F.col("low") == F.col("high")) & (F.col("fanout") <= 2), "SHORTED").when(F.col("low") == F.col("high"), "PARALLEL").otherwise("OK")
    return rows.select("comp_id", "cls", code.alias("code"))


def electrical_short(comps: DataFrame, epins: DataFrame) -> DataFrame:
    """comp_id, cls, enet of two-terminal parts with both pins on one electrical net."""
    rows = _terminals(comps, epins, TWO_TERMINAL, "enet")
    return rows.where("n_pins = 2 and n_live = 2 and low = high").select("comp_id", "cls", F.col("low").alias("enet"))


def transformer_windings(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """comp_id, code of transformers: PIN_COUNT, or OPEN_ and SHORTED_ with the first role of a winding (p0 p1, p2 p3)."""
    of = comps.where(is_in("cls", XFORMER)).select("comp_id")
    roles = ("p0", "p1", "p2", "p3")
    seen = pins.groupBy("comp_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(F.col("role") == r, F.col("net"))).alias(r) for r in roles])
    rows = of.join(seen, "comp_id", "left")

    def winding(a: str, b: str) -> Column:
        return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(f"OPEN_{a}")).when(F.col(a) == F.col(b), F.lit(f"SHORTED_{a}"))

    codes = F.when(F.coalesce(F.col("n"), F.lit(0)) != 4, F.array(F.lit("PIN_COUNT"))).otherwise(F.array(winding("p0", "p1"), winding("p2", "p3")))
    return rows.select("comp_id", F.explode_outer(codes).alias("code")).where("code is not null")


def role_contract(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """comp_id, cls, code, detail of classes with a contract: MISSING_ROLE with the roles, else DANGLING_PIN with the number of pins."""
    of = comps.withColumn("need", contract_of(F.col("cls"))).where("need is not null").select("comp_id", "cls", "need")
    seen = pins.groupBy("comp_id").agg(F.collect_set("role").alias("have"), F.sum(F.col("net").isNull().cast("bigint")).alias("dangling"))
    rows = of.join(seen, "comp_id", "left")
    rows = rows.withColumn("missing", F.array_sort(F.array_except("need", F.coalesce("have", F.array().cast("array<string>")))))
    code = F.when(F.size("missing") > 0, "MISSING_ROLE").when(F.col("dangling") > 0, "DANGLING_PIN")
    detail = F.when(F.size("missing") > 0, F.concat_ws(",", "missing")).otherwise(F.col("dangling").cast("string"))
    return rows.select("comp_id", "cls", code.alias("code"), detail.alias("detail")).where("code is not null")


def sources_floating(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """comp_id, cls, code of sources, rails, ports and integrated circuits: NO_PINS, or FLOATING if a pin dangles or is alone on its net."""
    of = comps.where(is_in("cls", SOURCE_LIKE + ICS)).select("comp_id", "cls")
    bad = lonely_pins(pins).select("comp_id").distinct().withColumn("floats", F.lit(True))
    seen = pins.select("comp_id").distinct().withColumn("has_pins", F.lit(True))
    rows = of.join(seen, "comp_id", "left").join(bad, "comp_id", "left")
    return rows.select("comp_id", "cls", F.when(F.col("has_pins").isNull(), "NO_PINS").when(F.col("floats"), "FLOATING").alias("code")).where("code is not null")


def ground_collapse(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """One row: raw_nets, gnd_pins, floating_gnd, of ground symbols."""
    grounds = comps.where(is_in("cls", GROUND1)).select("comp_id")
    rows = pins.join(grounds, "comp_id", "left_semi")
    return rows.agg(F.countDistinct("net").alias("raw_nets"), F.count("net").alias("gnd_pins"), F.sum(F.col("net").isNull().cast("bigint")).alias("floating_gnd"))


def islands_dangling(pins: DataFrame) -> DataFrame:
    """kind (island, dangling), pin_id: pins alone on their net, and pins without one."""
    return lonely_pins(pins).select(F.when(F.col("net").isNull(), "dangling").otherwise("island").alias("kind"), "pin_id")


def rail_shorts(comps: DataFrame, pins: DataFrame) -> DataFrame:
    """comp_id, pin_id, net of rail pins on a ground net."""
    rails = comps.where(is_in("cls", RAIL1)).select("comp_id")
    return pins.join(rails, "comp_id", "left_semi").join(ground_nets(comps, pins), "net", "left_semi").select("comp_id", "pin_id", "net")


def fk_orphans(comps: DataFrame, pins: DataFrame, nets: DataFrame) -> DataFrame:
    """kind, pin_id: pins whose component, or whose net, isn't in its table."""
    orphan = pins.join(comps, "comp_id", "left_anti").select(F.lit("orphan_pin").alias("kind"), "pin_id")
    edge = pins.where("net is not null").join(nets.select("net"), "net", "left_anti").select(F.lit("dangling_edge").alias("kind"), "pin_id")
    return orphan.unionByName(edge)


def verdicts(flags: DataFrame, checks: list[str]) -> DataFrame:
    """check, n_flags, verdict (PASS without flags) of each named check; flags has a column check."""
    named = F.explode(F.array(*[F.lit(x) for x in checks]))
    every = flags.sparkSession.range(1).select(named.alias("check"))
    seen = flags.groupBy("check").agg(F.count(F.lit(1)).alias("n_flags"))
    n = F.coalesce("n_flags", F.lit(0).cast("bigint"))
    return every.join(seen, "check", "left").select("check", n.alias("n_flags"), F.when(n == 0, "PASS").otherwise("FLAG").alias("verdict"))


def crossover_junction(hops: DataFrame, dots: DataFrame, inset: int = 3, slack: int = 6, cell: int = 64) -> DataFrame:
    """code, image_id, box_id: hops with a dot inside (by inset), DOT_INSIDE_HOP, and junction boxes without one near, PHONY_JUNCTION.

    hops: image_id, box_id, cls, x0, y0, x1, y1; dots: image_id, x, y. A junction's dot lies within max(w, h) / 2 + slack of its centre.
    """
    from .spatial import near_cells

    crosses = hops.where(F.col("cls").startswith("crossover"))
    inner = near_cells(crosses, F.col("x0") + inset, F.col("y0") + inset, F.col("x1") - inset, F.col("y1") - inset, cell)
    at = dots.select(F.col("image_id").alias("di"), F.floor(F.col("x") / cell).alias("dcx"), F.floor(F.col("y") / cell).alias("dcy"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    same = (F.col("image_id") == F.col("di")) & (F.col("cx") == F.col("dcx")) & (F.col("cy") == F.col("dcy"))
    held = same & F.col("dx").between(F.col("x0") + inset, F.col("x1") - inset) & F.col("dy").between(F.col("y0") + inset, F.col("y1") - inset)
    inside = inner.join(at, held, "left_semi").select(F.lit("DOT_INSIDE_HOP").alias("code"), "image_id", "box_id").distinct()
    joints = hops.where("cls = 'junction'").withColumn("r", F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2 + slack)
    joints = joints.withColumn("mx", (F.col("x0") + F.col("x1")) / 2).withColumn("my", (F.col("y0") + F.col("y1")) / 2)
    around = near_cells(joints, F.col("mx") - F.col("r"), F.col("my") - F.col("r"), F.col("mx") + F.col("r"), F.col("my") + F.col("r"), cell)
    close = same & ((F.col("dx") - F.col("mx")) * (F.col("dx") - F.col("mx")) + (F.col("dy") - F.col("my")) * (F.col("dy") - F.col("my")) <= F.col("r") * F.col("r"))
    with_dot = around.join(at, close, "left_semi").select("image_id", "box_id").distinct()
    phony = joints.join(with_dot, ["image_id", "box_id"], "left_anti").select(F.lit("PHONY_JUNCTION").alias("code"), "image_id", "box_id")
    return inside.unionByName(phony)


def net_summary(pins: DataFrame, net: str = "net") -> DataFrame:
    """One row: nets, largest, islands (one pin), small (five pins at most), on_net (pins with a net), pins."""
    per = pins.groupBy(net).agg(F.count(F.lit(1)).alias("n"))
    live = F.when(F.col(net).isNotNull(), F.col("n"))
    return per.agg(
        F.count(net).alias("nets"), F.max(live).alias("largest"), F.sum((live == 1).cast("bigint")).alias("islands"), F.sum((live <= 5).cast("bigint")).alias("small"),
        F.coalesce(F.sum(live), F.lit(0)).alias("on_net"), F.coalesce(F.sum("n"), F.lit(0)).alias("pins"),
    )


def structural_candidates(proposals: DataFrame) -> DataFrame:
    """check, image_id, x0, y0, x1, y1, n: proposed boxes as rows of the report; they are told, not flagged."""
    return proposals.select(F.lit("structural_candidates").alias("check"), "image_id", "x0", "y0", "x1", "y1", "n")


def crossing_no_dot(explained: DataFrame, examples: int = 15) -> DataFrame:
    """image_id, verdict, x_total, dotted, explained, text, unexplained, examples (the first unexplained) of each picture's crossings (image_id, point_id, kind)."""
    count = lambda kind: F.sum((F.col("kind") == kind).cast("bigint")).alias(kind)
    rows = explained.groupBy("image_id").agg(F.count(F.lit(1)).alias("x_total"), *[count(k) for k in ("dotted", "explained", "text", "unexplained")], F.slice(F.array_sort(F.collect_list(F.when(F.col("kind") == "unexplained", F.col("point_id")))), 1, examples).alias("examples"))
    return rows.withColumn("verdict", F.when(F.col("unexplained") > 0, "FLAG").otherwise("PASS"))

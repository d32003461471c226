"""The queries of the library's own operators over the fixtures, and the same in SQL.

Each entry of QUERIES takes (spark, sf_dir); ORACLES has SQL for DuckDB by the same names, for those that SQL can express.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geometry import aspect, extent, in_box, rotated, symbol_point
from ..model import BJT, CAP, DIODE, GROUND, ICS, RES, SOURCE_LIKE, TWO_TERMINAL, values_sql
from ..operators import checks, etl, graph, islands, motifs, netlist, pins as pin_ops, raster, repair, schematic, spatial, wires
from ..operators.components import star_labels
from ..sources import readers, writers
from ..storage import materialize, shared_dir
from . import fixtures as fx
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _electrical(spark: SparkSession, sf_dir: str, modulus: int) -> tuple[DataFrame, DataFrame]:
    comps, pins = fx.circuit(spark, sf_dir, modulus)
    return comps, *fx.stored(spark, ("electrical", sf_dir, modulus), lambda: (checks.electrical_nets(comps, pins),))


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SPARSE, MID, DENSE = fx.circuit_sql(fx.SPARSE), fx.circuit_sql(fx.MID), fx.circuit_sql(fx.DENSE)
IOU = "CASE WHEN least({a}.x1, {b}.x1) > greatest({a}.x0, {b}.x0) AND least({a}.y1, {b}.y1) > greatest({a}.y0, {b}.y0) THEN CAST((least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * (least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0)) AS DOUBLE) / (({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0) + ({b}.x1 - {b}.x0) * ({b}.y1 - {b}.y0) - (least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * (least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))) ELSE 0 END"


# ---- checks ----


@query(_with(SPARSE) + "SELECT net, fanout FROM fan")
def net_fanout(spark, sf_dir):
    return checks.net_fanout(fx.circuit(spark, sf_dir, fx.SPARSE)[1])


_TWO = f"""SELECT c.comp_id, c.cls, CASE WHEN coalesce(n, 0) <> 2 THEN 'PIN_COUNT' WHEN live < 2 THEN 'OPEN' WHEN lo = hi AND f.fanout <= 2 THEN 'SHORTED' WHEN lo = hi THEN 'PARALLEL' ELSE 'OK' END AS code
 FROM comps c LEFT JOIN (SELECT comp_id, count(*) AS n, count(net) AS live, min(net) AS lo, max(net) AS hi FROM pins GROUP BY comp_id) p USING (comp_id) LEFT JOIN fan f ON f.net = p.lo WHERE {values_sql("c.cls", TWO_TERMINAL)}"""


@query(_with(DENSE) + _TWO)
def two_terminal_flags(spark, sf_dir):
    return checks.two_terminal(*fx.circuit(spark, sf_dir, fx.DENSE))


@query(_with(MID) + f"SELECT comp_id, min(cls) AS cls, min(enet) AS enet FROM epins WHERE {values_sql('cls', TWO_TERMINAL)} GROUP BY comp_id HAVING count(*) = 2 AND count(enet) = 2 AND min(enet) = max(enet)")
def electrical_shorts(spark, sf_dir):
    return checks.electrical_short(*_electrical(spark, sf_dir, fx.MID))


@query(
    _with(DENSE, "w AS (SELECT comp_id, max(CASE WHEN role = 'p0' THEN net END) AS p0, max(CASE WHEN role = 'p1' THEN net END) AS p1, max(CASE WHEN role = 'p2' THEN net END) AS p2, max(CASE WHEN role = 'p3' THEN net END) AS p3 FROM pins WHERE cls = 'transformer' GROUP BY comp_id)")
    + "SELECT * FROM (SELECT comp_id, CASE WHEN p0 IS NULL OR p1 IS NULL THEN 'OPEN_p0' WHEN p0 = p1 THEN 'SHORTED_p0' END AS code FROM w UNION ALL SELECT comp_id, CASE WHEN p2 IS NULL OR p3 IS NULL THEN 'OPEN_p2' WHEN p2 = p3 THEN 'SHORTED_p2' END FROM w) WHERE code IS NOT NULL"
)
def transformer_windings(spark, sf_dir):
    return checks.transformer_windings(*fx.circuit(spark, sf_dir, fx.DENSE))


def _short_of_a_role(pins: DataFrame) -> DataFrame:
    """Without one role of every eleventh component, so that contracts are broken."""
    return pins.where(~((F.col("comp_id") % 11 == 0) & (F.col("slot") == 1)))


_KEPT = "kept AS (SELECT * FROM pins WHERE NOT (comp_id % 11 = 0 AND slot = 1))"
_NEED = "need AS (SELECT comp_id, cls, CASE WHEN cls IN ('npn', 'pnp') THEN ['b', 'c', 'e'] WHEN cls = 'nmos' THEN ['d', 'g', 's'] WHEN cls = 'transformer' THEN ['p0', 'p1', 'p2', 'p3'] END AS need FROM comps)"


@query(
    _with(SPARSE, _KEPT, _NEED, "seen AS (SELECT comp_id, list(DISTINCT role) AS have, count(*) FILTER (net IS NULL) AS dangling FROM kept GROUP BY comp_id)", "m AS (SELECT n.comp_id, n.cls, list_sort(list_filter(need, lambda x: NOT list_contains(coalesce(have, []), x))) AS missing, dangling FROM need n LEFT JOIN seen USING (comp_id) WHERE need IS NOT NULL)")
    + "SELECT comp_id, cls, CASE WHEN len(missing) > 0 THEN 'MISSING_ROLE' ELSE 'DANGLING_PIN' END AS code, CASE WHEN len(missing) > 0 THEN array_to_string(missing, ',') ELSE CAST(dangling AS VARCHAR) END AS detail FROM m WHERE len(missing) > 0 OR dangling > 0"
)
def role_contract_missing(spark, sf_dir):
    comps, pins = fx.circuit(spark, sf_dir, fx.SPARSE)
    return checks.role_contract(comps, _short_of_a_role(pins))


@query(_with(SPARSE) + f"SELECT comp_id, min(cls) AS cls, 'FLOATING' AS code FROM pins LEFT JOIN fan USING (net) WHERE {values_sql('cls', SOURCE_LIKE + ICS)} GROUP BY comp_id HAVING count(*) FILTER (net IS NULL OR coalesce(fanout, 0) < 2) > 0")
def sources_floating(spark, sf_dir):
    return checks.sources_floating(*fx.circuit(spark, sf_dir, fx.SPARSE))


@query(_with(SPARSE) + "SELECT count(DISTINCT net) AS raw_nets, count(net) AS gnd_pins, count(*) FILTER (net IS NULL) AS floating_gnd FROM pins WHERE cls IN ('gnd', 'vss')")
def ground_collapse(spark, sf_dir):
    return checks.ground_collapse(*fx.circuit(spark, sf_dir, fx.SPARSE))


@query(_with(SPARSE) + "SELECT 'island' AS kind, pin_id FROM pins JOIN fan USING (net) WHERE fanout = 1 UNION ALL SELECT 'dangling', pin_id FROM pins WHERE net IS NULL")
def islands_dangling(spark, sf_dir):
    return checks.islands_dangling(fx.circuit(spark, sf_dir, fx.SPARSE)[1])


@query(_with(MID) + "SELECT comp_id, pin_id, net FROM pins WHERE cls = 'vdd' AND net IN (SELECT net FROM gnd)")
def rail_shorts(spark, sf_dir):
    return checks.rail_shorts(*fx.circuit(spark, sf_dir, fx.MID))


def _hops(spark, sf_dir):
    cls = F.when(F.col("det_id") % 3 == 0, "crossover").when(F.col("det_id") % 3 == 1, "junction").otherwise("crossover.curved")
    return fx.boxes(spark, sf_dir).withColumn("cls", cls).withColumnRenamed("det_id", "box_id")


@query(
    _with(fx.BOXES_SQL, fx.DOTS_SQL, "hops AS (SELECT *, CASE det_id % 3 WHEN 0 THEN 'crossover' WHEN 1 THEN 'junction' ELSE 'crossover.curved' END AS cls FROM boxes)")
    + """SELECT 'DOT_INSIDE_HOP' AS code, image_id, det_id AS box_id FROM hops h WHERE cls LIKE 'crossover%' AND EXISTS (SELECT 1 FROM dots d WHERE d.image_id = h.image_id AND d.x BETWEEN h.x0 + 3 AND h.x1 - 3 AND d.y BETWEEN h.y0 + 3 AND h.y1 - 3)
 UNION ALL SELECT 'PHONY_JUNCTION', image_id, det_id FROM hops h WHERE cls = 'junction' AND NOT EXISTS (SELECT 1 FROM dots d WHERE d.image_id = h.image_id AND (d.x - (h.x0 + h.x1) / CAST(2 AS DOUBLE)) ** 2 + (d.y - (h.y0 + h.y1) / CAST(2 AS DOUBLE)) ** 2 <= (greatest(h.x1 - h.x0, h.y1 - h.y0) / CAST(2 AS DOUBLE) + 6) ** 2)"""
)
def crossover_junction(spark, sf_dir):
    return checks.crossover_junction(_hops(spark, sf_dir), fx.dots(spark, sf_dir))


@query(_with(SPARSE) + "SELECT 'orphan_pin' AS kind, pin_id FROM pins WHERE comp_id % 13 = 0 UNION ALL SELECT 'dangling_edge', pin_id FROM pins JOIN fan USING (net) WHERE fanout <= 1")
def fk_orphans(spark, sf_dir):
    comps, pins = fx.circuit(spark, sf_dir, fx.SPARSE)
    return checks.fk_orphans(comps.where("comp_id % 13 <> 0"), pins, checks.net_fanout(pins).where("fanout > 1"))


@query(
    _with(DENSE, f"t AS ({_TWO})")
    + """SELECT * FROM (SELECT 'two_terminal' AS "check", (SELECT count(*) FROM t WHERE code IN ('PIN_COUNT', 'OPEN', 'SHORTED')) AS n_flags UNION ALL SELECT 'rail_shorts', (SELECT count(*) FROM pins WHERE cls = 'vdd' AND net IN (SELECT net FROM gnd)) UNION ALL SELECT 'orphans', 0) s, LATERAL (SELECT CASE WHEN n_flags = 0 THEN 'PASS' ELSE 'FLAG' END AS verdict)"""
)
def verdict_summary(spark, sf_dir):
    comps, pins = fx.circuit(spark, sf_dir, fx.DENSE)
    flags = checks.two_terminal(comps, pins).where("code in ('PIN_COUNT', 'OPEN', 'SHORTED')").select(F.lit("two_terminal").alias("check"))
    flags = flags.unionByName(checks.rail_shorts(comps, pins).select(F.lit("rail_shorts").alias("check"))).unionByName(pins.join(comps, "comp_id", "left_anti").select(F.lit("orphans").alias("check")))
    return checks.verdicts(flags, ["two_terminal", "rail_shorts", "orphans"])


@query(_with(SPARSE) + "SELECT (SELECT count(*) FROM fan) AS nets, (SELECT max(fanout) FROM fan) AS largest, (SELECT count(*) FROM fan WHERE fanout = 1) AS islands, (SELECT count(*) FROM fan WHERE fanout <= 5) AS small, (SELECT count(net) FROM pins) AS on_net, (SELECT count(*) FROM pins) AS pins")
def net_summary(spark, sf_dir):
    return checks.net_summary(fx.circuit(spark, sf_dir, fx.SPARSE)[1])


# ---- motifs ----


@query(_with(SPARSE) + "SELECT pin_id, enet FROM epins")
def electrical_nets(spark, sf_dir):
    return checks.electrical_nets(*fx.circuit(spark, sf_dir, fx.SPARSE)).select("pin_id", "enet")


def _ends_sql(family: list[str], name: str) -> str:
    return f"{name} AS (SELECT comp_id, min(CASE WHEN slot = 0 THEN enet END) AS n0, min(CASE WHEN slot = 1 THEN enet END) AS n1 FROM epins WHERE {values_sql('cls', family)} GROUP BY comp_id HAVING count(*) = 2 AND count(enet) = 2)"


def _sides_sql(name: str) -> str:
    return f"{name}_s AS (SELECT comp_id, n0 AS node, n1 AS other FROM {name} WHERE n0 <> n1 UNION ALL SELECT comp_id, n1, n0 FROM {name} WHERE n0 <> n1)"


@query(_with(SPARSE, _ends_sql(RES, "r")) + "SELECT comp_id, n0, n1 FROM r")
def two_ends(spark, sf_dir):
    return motifs.two_ends(*_electrical(spark, sf_dir, fx.SPARSE), RES)


_DIV = "d AS (SELECT a.comp_id AS r_top, b.comp_id AS r_bot, a.node AS tap, least(a.other, b.other) AS end_low, greatest(a.other, b.other) AS end_high FROM r_s a JOIN r_s b ON a.node = b.node AND a.comp_id < b.comp_id AND a.other <> b.other JOIN efan f ON f.enet = a.node WHERE a.node <> -1 AND f.fanout <= 5)"


@query(_with(SPARSE, _ends_sql(RES, "r"), _sides_sql("r"), _DIV) + "SELECT * FROM d")
def voltage_dividers(spark, sf_dir):
    return motifs.voltage_dividers(*_electrical(spark, sf_dir, fx.SPARSE))


@query(_with(SPARSE, _ends_sql(RES, "r"), _sides_sql("r"), _DIV) + "SELECT r_top, r_bot, tap, e.comp_id, e.role FROM d JOIN epins e ON e.enet = d.tap WHERE e.comp_id NOT IN (r_top, r_bot)")
def divider_tap_load(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    return motifs.divider_tap_load(motifs.voltage_dividers(comps, epins), epins)


@query(_with(MID, _ends_sql(CAP, "c")) + "SELECT comp_id AS cap, greatest(n0, n1) AS rail, fanout AS rail_pins FROM c JOIN efan ON enet = greatest(n0, n1) WHERE n0 <> n1 AND least(n0, n1) = -1 AND fanout >= 3")
def decoupling_caps(spark, sf_dir):
    return motifs.decoupling_caps(*_electrical(spark, sf_dir, fx.MID))


def _rc_sql(first: list[str], second: list[str]) -> str:
    return _with(SPARSE, _ends_sql(first, "a"), _sides_sql("a"), _ends_sql(second, "b"), _sides_sql("b")) + "SELECT a.comp_id AS series, b.comp_id AS shunt, a.node FROM a_s a JOIN b_s b ON a.node = b.node JOIN efan f ON f.enet = a.node WHERE a.node <> -1 AND a.other <> -1 AND b.other = -1 AND f.fanout <= 5"


@query(_rc_sql(RES, CAP))
def rc_lowpass(spark, sf_dir):
    return motifs.rc_filters(*_electrical(spark, sf_dir, fx.SPARSE), "lowpass")


@query(_rc_sql(CAP, RES))
def rc_highpass(spark, sf_dir):
    return motifs.rc_filters(*_electrical(spark, sf_dir, fx.SPARSE), "highpass")


_BJT = f"q AS (SELECT comp_id, max(CASE WHEN role = 'c' THEN enet END) AS c, max(CASE WHEN role = 'b' THEN enet END) AS b, max(CASE WHEN role = 'e' THEN enet END) AS e FROM epins WHERE {values_sql('cls', BJT)} GROUP BY comp_id HAVING count(enet) = 3)"
_ER = "er AS (SELECT node AS e, min(comp_id) AS emitter_r FROM r_s WHERE other = -1 AND node <> -1 GROUP BY node)"


@query(
    _with(MID, _ends_sql(RES, "r"), _sides_sql("r"), _BJT, _ER, "pulls AS (SELECT comp_id, node, other FROM r_s UNION ALL SELECT comp_id, n0, n1 FROM r WHERE n0 = n1)", "pull AS (SELECT node AS c, min(comp_id) AS collector_r, arg_min(other, comp_id) AS rail FROM pulls JOIN efan ON enet = other WHERE fanout >= 4 GROUP BY node)")
    + "SELECT comp_id AS q, collector_r, rail, CASE WHEN q.e <> -1 THEN emitter_r END AS emitter_r, q.b AS base_net, fanout > 1 AS base_driven FROM q JOIN pull USING (c) LEFT JOIN er ON er.e = q.e JOIN efan ON enet = q.b WHERE q.e = -1 OR emitter_r IS NOT NULL"
)
def common_emitter(spark, sf_dir):
    return motifs.common_emitter(*_electrical(spark, sf_dir, fx.MID))


@query(_with(MID, _ends_sql(RES, "r"), _sides_sql("r"), _BJT, _ER) + "SELECT comp_id AS q, emitter_r, q.c AS rail, q.b AS base_net, fb.fanout > 1 AS base_driven FROM q JOIN er ON er.e = q.e JOIN efan fc ON fc.enet = q.c JOIN efan fb ON fb.enet = q.b WHERE q.e <> -1 AND fc.fanout >= 4")
def emitter_follower(spark, sf_dir):
    return motifs.emitter_follower(*_electrical(spark, sf_dir, fx.MID))


@query(_with(DENSE, _ends_sql(DIODE, "d")) + "SELECT least(n0, n1) AS net_low, greatest(n0, n1) AS net_high, count(*) AS n_diodes, min(comp_id) AS first_diode FROM d WHERE n0 <> n1 GROUP BY ALL HAVING count(*) >= 2")
def parallel_pairs(spark, sf_dir):
    return motifs.parallel_pairs(*_electrical(spark, sf_dir, fx.DENSE))


# ---- repair ----


def _candidates(spark, sf_dir, radius=120):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    return comps, fx.placed_pins(epins), repair.repair_candidates(comps, fx.placed_pins(epins), motifs.voltage_dividers(comps, epins).select("tap"), radius=radius)


_RANK = (
    "live AS (SELECT p.*, fanout FROM placed p JOIN efan USING (enet))",
    "sick AS (SELECT p.* FROM placed p LEFT JOIN efan f USING (enet) WHERE enet IS NULL OR (f.fanout = 1 AND cls NOT IN ('gnd', 'vss')))",
    "near AS (SELECT s.pin_id, l.enet, min(abs(s.x - l.x) + abs(s.y - l.y)) AS dist, min(s.cls) AS cls, min(l.fanout) AS fanout FROM sick s JOIN live l ON l.image_id = s.image_id AND l.pin_id <> s.pin_id AND (s.enet IS NULL OR s.enet <> l.enet) AND abs(s.x - l.x) + abs(s.y - l.y) <= 120 GROUP BY s.pin_id, l.enet)",
    "scored AS (SELECT *, CASE WHEN enet IN (SELECT tap FROM d) THEN 80 ELSE 0 END + CASE WHEN fanout >= 4 THEN 80 WHEN fanout >= 3 THEN 40 ELSE 0 END + CASE WHEN enet = -1 AND cls IN ('gnd', 'vss') THEN 80 ELSE 0 END - dist AS fortieths FROM near)",
    "cand AS (SELECT pin_id, row_number() OVER (PARTITION BY pin_id ORDER BY fortieths DESC, enet DESC, dist DESC) AS rank, enet, fortieths / CAST(40 AS DOUBLE) AS score, dist FROM scored QUALIFY rank <= 3)",
)
_CAND = _with(SPARSE, fx.PLACED_SQL, _ends_sql(RES, "r"), _sides_sql("r"), _DIV, *_RANK)


@query(_CAND + "SELECT * FROM cand")
def repair_top3(spark, sf_dir):
    return _candidates(spark, sf_dir)[2]


_LOST = "lost AS (SELECT pin_id FROM pins LEFT JOIN fan USING (net) WHERE (net IS NULL OR (fanout = 1 AND cls NOT IN ('gnd', 'vss'))) AND pin_id NOT IN (SELECT pin_id FROM cand))"


@query((_CAND.rstrip() + ",\n" + _LOST + "\nSELECT comp_id FROM pins WHERE comp_id % 2 = 0 GROUP BY comp_id HAVING count(*) = count(*) FILTER (pin_id IN (SELECT pin_id FROM lost))").replace("<= 120", "<= 30"))
def prune_noise(spark, sf_dir):
    comps, pins, candidates = _candidates(spark, sf_dir, 30)
    return repair.prune_noise(comps.withColumn("is_rescued", F.col("comp_id") % 2 == 0), pins, candidates)


@query(
    _with(SPARSE, "placed AS (SELECT *, comp_id % 53 AS image_id, (comp_id * 2111 + slot * 97) % 401 AS x, (comp_id * 1693 + slot * 211) % 403 AS y FROM pins WHERE cls IN ('gnd', 'vss'))", "met AS (SELECT a.pin_id, b.pin_id AS anchor_pin, b.net, abs(a.x - b.x) + abs(a.y - b.y) AS dist FROM placed a JOIN placed b USING (image_id) WHERE a.net IS NULL AND b.net IS NOT NULL)")
    + "SELECT * FROM met WHERE dist <= 120 QUALIFY row_number() OVER (PARTITION BY pin_id ORDER BY dist, anchor_pin) = 1"
)
def ground_homing(spark, sf_dir):
    comps, pins = fx.circuit(spark, sf_dir, fx.SPARSE)
    x, y = F.col("comp_id") * 2111 + F.col("slot") * 97, F.col("comp_id") * 1693 + F.col("slot") * 211
    placed = fx.placed_pins(pins).withColumn("x", x % 401).withColumn("y", y % 403)
    return repair.ground_homing(comps, placed)


@query(
    _CAND.rstrip() + ",\nhome AS (SELECT c.*, p.comp_id FROM cand c JOIN pins p USING (pin_id)), free AS (SELECT * FROM home h WHERE NOT EXISTS (SELECT 1 FROM pins s WHERE s.comp_id = h.comp_id AND s.pin_id <> h.pin_id AND s.net = h.enet)), first AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY pin_id ORDER BY rank) = 1)\nSELECT pin_id, enet FROM first WHERE score >= 1 AND dist <= 80"
)
def motif_attach(spark, sf_dir):
    _, pins, candidates = _candidates(spark, sf_dir)
    return repair.motif_attach(pins, candidates)


# ---- boxes ----


def _small(spark, sf_dir):
    """All boxes, an eighth of their size."""
    size = F.floor((F.col("x1") - F.col("x0")) / 8)
    return fx.boxes(spark, sf_dir).select("det_id", "image_id", "x0", "y0", (F.col("x0") + size).alias("x1"), (F.col("y0") + size).alias("y1"))


_SMALL = "small_boxes AS (SELECT det_id, image_id, x0, y0, x0 + (x1 - x0) // 8 AS x1, y0 + (x1 - x0) // 8 AS y1 FROM boxes)"


@query(
    "WITH RECURSIVE " + fx.BOXES_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS rn FROM boxes),
 f AS (SELECT image_id, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(det_id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[]) AS kept FROM (SELECT DISTINCT image_id FROM boxes)
  UNION ALL SELECT f.image_id, o.rn, CASE WHEN len(list_filter(kept, lambda k: """ + IOU.format(a="k", b="o") + """ > 0.5)) > 0 THEN kept ELSE list_append(kept, {'det_id': o.det_id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}) END FROM f JOIN o ON o.image_id = f.image_id AND o.rn = f.rn + 1),
 done AS (SELECT image_id, unnest(kept) AS k FROM f QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) = 1)
SELECT image_id, k.det_id FROM done"""
)
def nms_boxes(spark, sf_dir):
    return spatial.nms(fx.boxes(spark, sf_dir)).select("image_id", "det_id")


@query(
    "WITH RECURSIVE " + fx.BOXES_SQL + """, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, det_id) AS rn FROM boxes WHERE det_id % 4 > 0),
 f AS (SELECT image_id, CAST(0 AS BIGINT) AS rn, list({'det_id': det_id, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) AS kept, CAST([] AS BIGINT[]) AS added FROM boxes WHERE det_id % 4 = 0 GROUP BY image_id
  UNION ALL SELECT f.image_id, o.rn, CASE WHEN hit THEN kept ELSE list_append(kept, {'det_id': o.det_id, 'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1}) END, CASE WHEN hit THEN added ELSE list_append(added, o.det_id) END
  FROM f JOIN o ON o.image_id = f.image_id AND o.rn = f.rn + 1, LATERAL (SELECT len(list_filter(f.kept, lambda k: """ + IOU.format(a="k", b="o") + """ >= 0.5)) > 0 AS hit))
SELECT image_id, unnest(added) AS det_id FROM f QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY rn DESC) = 1"""
)
def novel_boxes(spark, sf_dir):
    b = fx.boxes(spark, sf_dir).withColumn("image_id", F.col("det_id") % 5)
    return spatial.novel_boxes(b.where("det_id % 4 = 0"), b.where("det_id % 4 > 0")).select("image_id", "det_id")


ORACLES["novel_boxes"] = ORACLES["novel_boxes"].replace("p_partkey % 20 AS image_id", "p_partkey % 5 AS image_id")


@query(_with(fx.BOXES_SQL) + "SELECT a.image_id, a.det_id AS a, b.det_id AS b, " + IOU.format(a="a", b="b") + " AS iou FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.det_id < b.det_id WHERE " + IOU.format(a="a", b="b") + " >= 0.3")
def iou_pairs(spark, sf_dir):
    return spatial.iou_pairs(fx.boxes(spark, sf_dir), 0.3)


@query(_with(fx.BOXES_SQL, _SMALL, fx.DOTS_SQL) + "SELECT image_id, dot_id AS point_id, x, y FROM dots d WHERE NOT EXISTS (SELECT 1 FROM small_boxes b WHERE b.image_id = d.image_id AND d.x BETWEEN b.x0 - 4 AND b.x1 + 4 AND d.y BETWEEN b.y0 - 4 AND b.y1 + 4)")
def point_in_box_anti(spark, sf_dir):
    return spatial.points_near_boxes(fx.dots(spark, sf_dir).withColumnRenamed("dot_id", "point_id"), _small(spark, sf_dir), 4, near=False)


@query(_with(fx.DOTS_SQL) + "SELECT image_id, dot_id, x, y FROM dots a WHERE dot_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM dots b WHERE b.dot_id % 2 = 1 AND b.image_id = a.image_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400)")
def points_away_from_dots(spark, sf_dir):
    dots = fx.dots(spark, sf_dir)
    return spatial.points_near_points(dots.where("dot_id % 2 = 0"), dots.where("dot_id % 2 = 1"), 20, near=False).select("image_id", "dot_id", "x", "y")


@query(_with(fx.DOTS_SQL) + "SELECT image_id, dot_id, x, y FROM dots QUALIFY row_number() OVER (PARTITION BY image_id, x // 32, y // 32 ORDER BY dot_id) = 1")
def first_per_cell(spark, sf_dir):
    return spatial.first_per_cell(fx.dots(spark, sf_dir).select("image_id", "dot_id", "x", "y"), ["dot_id"], 32)


@query("SELECT DISTINCT p_size AS class_id, CAST(p_size AS VARCHAR) AS name FROM part WHERE p_size <= 30")
def used_classes(spark, sf_dir):
    sizes = fx.table(spark, sf_dir, "part").select(F.col("p_size").alias("cls"))
    names = spark.range(1, 31).select(F.col("id").cast("int").alias("class_id"), F.col("id").cast("string").alias("name"))
    return etl.used_classes(sizes, names)


@query(_with(fx.BOXES_SQL, fx.DOTS_SQL) + "SELECT image_id, dot_id AS point_id, b.det_id AS target_id, abs(x - x0) + abs(y - y0) AS dist FROM dots JOIN boxes b USING (image_id) WHERE abs(x - x0) + abs(y - y0) <= 40 QUALIFY row_number() OVER (PARTITION BY image_id, dot_id ORDER BY abs(x - x0) + abs(y - y0), b.det_id) = 1")
def nearest_pin(spark, sf_dir):
    targets = fx.boxes(spark, sf_dir).select("image_id", F.col("det_id").alias("target_id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    return spatial.nearest(fx.dots(spark, sf_dir).withColumnRenamed("dot_id", "point_id"), targets, 40)


# ---- netlist ----


def _node_sql(net: str, pin: str) -> str:
    return f"CASE WHEN {net} IS NULL THEN 'FLT_' || {pin} WHEN {net} = -1 THEN '0' ELSE 'N' || {net} END"


def _at_sql(*roles: str) -> str:
    return "roles AS (SELECT comp_id, " + ", ".join(f"coalesce(max(CASE WHEN role = '{r}' THEN node END), 'FLT_-' || comp_id) AS {r if r != '1' else 'one'}" for r in roles) + " FROM named GROUP BY comp_id)"


_NAMED = "named AS (SELECT *, " + _node_sql("enet", "pin_id") + " AS node FROM epins)"
_ELEMENTS = (
    _NAMED,
    _at_sql("p0", "p1", "p2", "p3", "c", "b", "e", "d", "g", "s", "1"),
    "ic AS (SELECT comp_id, string_agg(node, ' ' ORDER BY role) AS nodes, string_agg(role, ',' ORDER BY role) AS names FROM (SELECT comp_id, role, max(node) AS node FROM named WHERE cls = 'integrated_circuit' GROUP BY ALL) GROUP BY comp_id)",
    """elements AS (
 SELECT comp_id, 0 AS part, CASE cls WHEN 'resistor' THEN 'R' || comp_id || ' ' || p0 || ' ' || p1 || ' 1k  ; ' || cls WHEN 'capacitor' THEN 'C' || comp_id || ' ' || p0 || ' ' || p1 || ' 1u  ; ' || cls
  WHEN 'diode' THEN 'D' || comp_id || ' ' || p0 || ' ' || p1 || ' DMOD  ; ' || cls WHEN 'npn' THEN 'Q' || comp_id || ' ' || c || ' ' || b || ' ' || e || ' QMODN  ; ' || cls WHEN 'pnp' THEN 'Q' || comp_id || ' ' || c || ' ' || b || ' ' || e || ' QMODP  ; ' || cls
  WHEN 'nmos' THEN 'M' || comp_id || ' ' || d || ' ' || g || ' ' || s || ' ' || s || ' MMODN  ; ' || cls || ' (bulk=s)' WHEN 'voltage.dc' THEN 'V' || comp_id || ' ' || p0 || ' ' || p1 || ' DC 5  ; ' || cls
  WHEN 'transformer' THEN 'L' || comp_id || 'a ' || p0 || ' ' || p1 || ' 10u Rser=10m' WHEN 'integrated_circuit' THEN 'X' || comp_id || ' ' || ic.nodes || ' ICSTUB  ; ' || cls || ' pins=' || ic.names || ' (structural)' END AS text
  FROM comps JOIN roles USING (comp_id) LEFT JOIN ic USING (comp_id)
 UNION ALL SELECT comp_id, 1, 'L' || comp_id || 'b ' || p2 || ' ' || p3 || ' 10u Rser=10m' FROM comps JOIN roles USING (comp_id) WHERE cls = 'transformer'
 UNION ALL SELECT comp_id, 2, 'K' || comp_id || ' L' || comp_id || 'a L' || comp_id || 'b 1' FROM comps WHERE cls = 'transformer')""",
)


@query(_with(SPARSE, *_ELEMENTS) + "SELECT comp_id, CAST(part AS BIGINT) AS part, text FROM elements WHERE text IS NOT NULL")
def spice_lines(spark, sf_dir):
    return netlist.spice_elements(*_electrical(spark, sf_dir, fx.SPARSE))


@query(_with(SPARSE, _KEPT) + "SELECT comp_id, cls, CASE WHEN cls IN ('npn', 'pnp', 'nmos', 'transformer') THEN 'bad-roles' ELSE 'node-label-only' END AS reason FROM comps WHERE cls IN ('gnd', 'vss', 'vdd', 'port') OR (cls IN ('npn', 'pnp', 'nmos', 'transformer') AND comp_id % 11 = 0)")
def spice_skips(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    return netlist.spice_skips(comps, _short_of_a_role(epins))


@query(_with(SPARSE, *_ELEMENTS) + "SELECT comp_id, CAST(part AS BIGINT) AS part, CASE WHEN comp_id % 3 = 0 THEN replace(replace(text, ' 1k  ;', ' ' || (comp_id % 100) || 'k  ;'), ' 1u  ;', ' ' || (comp_id % 100) || 'k  ;') ELSE text END AS text FROM elements WHERE left(text, 1) IN ('R', 'C')")
def spice_values(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    values = comps.where("comp_id % 3 = 0").select("comp_id", F.concat((F.col("comp_id") % 100).cast("string"), F.lit("k")).alias("value"))
    return netlist.spice_elements(comps, epins, values).where(F.substring("text", 1, 1).isin("R", "C"))


@query(
    _with(SPARSE, *_ELEMENTS, "words AS (SELECT string_split(trim(split_part(text, ';', 1)), ' ') AS w, left(text, 1) AS kind FROM elements WHERE text IS NOT NULL AND left(text, 1) <> 'K')", "nodes AS (SELECT unnest(CASE WHEN kind = 'X' THEN w[3:len(w) - 1] ELSE list_filter(w[2:CASE kind WHEN 'Q' THEN 4 WHEN 'M' THEN 5 ELSE 3 END], lambda x: NOT regexp_matches(x, '^[0-9]')) END) AS node FROM words)")
    + "SELECT node, count(*) AS fanout, count(*) < 2 AND node <> '0' AS stub FROM nodes GROUP BY node"
)
def spice_parse_fanout(spark, sf_dir):
    return netlist.spice_fanout(netlist.spice_elements(*_electrical(spark, sf_dir, fx.SPARSE)))


@query(_with(SPARSE, *_ELEMENTS) + "SELECT left(text, 1) AS kind, count(*) AS elements, CAST(0 AS BIGINT) AS bad_lines FROM elements WHERE text IS NOT NULL GROUP BY 1")
def spice_report(spark, sf_dir):
    return netlist.spice_report(netlist.spice_elements(*_electrical(spark, sf_dir, fx.SPARSE)))


@query(_with(SPARSE, _NAMED, "got AS (SELECT comp_id, role, CASE WHEN pin_id % 7 = 0 THEN 'X' ELSE node END AS got FROM named WHERE pin_id % 5 <> 0)") + "SELECT comp_id, role, node AS want, got, CASE WHEN got IS NULL THEN 'missing' ELSE 'mismatch' END AS code FROM (SELECT * FROM named WHERE np_small) n LEFT JOIN got USING (comp_id, role) WHERE node IS DISTINCT FROM got".replace("(SELECT * FROM named WHERE np_small)", "(SELECT * FROM named WHERE cls <> 'integrated_circuit')"))
def incidence_diff(spark, sf_dir):
    _, epins = _electrical(spark, sf_dir, fx.SPARSE)
    comps = fx.circuit(spark, sf_dir, fx.SPARSE)[0].where("cls <> 'integrated_circuit'").select("comp_id")
    named = epins.join(comps, "comp_id", "left_semi").withColumn("node", netlist.node_name(F.col("enet"), F.col("pin_id")))
    got = named.where("pin_id % 5 <> 0").withColumn("node", F.when(F.col("pin_id") % 7 == 0, "X").otherwise(F.col("node")))
    return netlist.incidence_diff(named, got)


_VOTES = f"SELECT enet, CAST(sum(CASE WHEN {values_sql('cls', RES)} OR role IN ('c', 'd') THEN 1 ELSE 0 END + CASE WHEN {values_sql('cls', CAP)} OR role IN ('b', 'g') THEN -2 ELSE 0 END) AS BIGINT) AS votes, min(pin_id) AS first_pin FROM epins WHERE enet <> -1 GROUP BY enet"


@query(_with(MID) + _VOTES)
def supply_rail_vote(spark, sf_dir):
    return netlist.supply_rail_votes(*_electrical(spark, sf_dir, fx.MID))


@query(_with(MID, f"v AS ({_VOTES})") + "SELECT 'VVCC N' || enet || ' 0 5' AS text FROM (SELECT * FROM v ORDER BY votes DESC, first_pin LIMIT 1) UNION ALL SELECT DISTINCT '.ic V(N' || enet || ')=0' FROM epins WHERE role = 'c' AND cls IN ('npn', 'pnp') AND enet <> -1 UNION ALL SELECT '.tran 10u 10m'")
def simulation_lines(spark, sf_dir):
    return netlist.simulation_lines(*_electrical(spark, sf_dir, fx.MID))


@query(_with(SPARSE, *_ELEMENTS) + "SELECT (SELECT count(DISTINCT comp_id) FROM elements WHERE text IS NOT NULL) AS modelled, (SELECT count(*) FROM comps WHERE cls IN ('gnd', 'vss', 'vdd', 'port')) AS skipped, (SELECT count(*) FROM comps) AS components")
def coverage_identity(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("k", F.lit(1))
    return one(netlist.spice_elements(comps, epins).select("comp_id").distinct(), "modelled").join(one(netlist.spice_skips(comps, epins), "skipped"), "k").join(one(comps, "components"), "k").drop("k")


# ---- text, splits and datasets ----


@query("SELECT DISTINCT p_name || '/' || p_type || ' -' AS raw, coalesce(nullif(lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(trim(p_name || '/' || p_type || ' -'), '/-', '__'), '\\s+', '_', 'g'), '[^0-9A-Za-z_.]+', '_', 'g'), '_+', '_', 'g'), '_')), ''), 'unknown') AS name FROM part")
def sanitize_names(spark, sf_dir):
    raw = F.concat("p_name", F.lit("/"), "p_type", F.lit(" -"))
    return fx.table(spark, sf_dir, "part").select(raw.alias("raw")).distinct().withColumn("name", tx.sanitized(F.col("raw")))


_ALIASES = [("ECONOMY", "resistor"), ("STANDARD", "capacitor"), ("PROMO", "diode")]


@query("WITH a(alias, target) AS (VALUES " + ", ".join(map(str, _ALIASES)) + ") SELECT p_partkey, coalesce(target, lower(p_type)) AS canonical FROM part LEFT JOIN a ON alias = p_type")
def canonical_alias(spark, sf_dir):
    aliases = spark.createDataFrame(_ALIASES, "alias string, target string")
    return etl.canonical(fx.table(spark, sf_dir, "part"), "p_type", aliases).select("p_partkey", "canonical")


@query("SELECT p_partkey, concat_ws('_', left(p_brand || '-of-a-data-set-with-a-long-name', 28), 'train', left(sha1(p_name || p_partkey), 12), left(p_type, 48)) AS stem FROM part")
def short_stem(spark, sf_dir):
    key = F.concat("p_name", F.col("p_partkey").cast("string"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", tx.short_stem(F.concat("p_brand", F.lit("-of-a-data-set-with-a-long-name")), F.lit("train"), key, F.col("p_type")).alias("stem"))


_MD5 = "md5('drafter' || o_custkey || '_c' || (o_orderkey % 7))"
_PARTS = ", ".join(f"CAST(CAST('0x' || substr({_MD5}, {8 * i + 1}, 8) AS UBIGINT) AS BIGINT) AS h{i}" for i in range(4))


@query(f"WITH p AS (SELECT o_orderkey, {_PARTS} FROM orders), b AS (SELECT o_orderkey, ((((h0 % 100) * 96 + h1) % 100 * 96 + h2) % 100 * 96 + h3) % 100 AS bucket FROM p) SELECT o_orderkey, bucket, CASE WHEN bucket < 70 THEN 'train' WHEN bucket < 85 THEN 'valid' ELSE 'test' END AS split FROM b")
def md5_split(spark, sf_dir):
    key = F.concat(F.lit("drafter"), F.col("o_custkey").cast("string"), F.lit("_c"), (F.col("o_orderkey") % 7).cast("string"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", tx.md5_bucket(key).alias("bucket")).withColumn("split", tx.split_of(F.col("bucket"), 70, 15))


@query("WITH b AS (SELECT o_orderkey, CAST(CAST('0x' || substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 8) AS UBIGINT) % 100 AS BIGINT) AS bucket FROM orders) SELECT o_orderkey, bucket, CASE WHEN bucket < 80 THEN 'train' WHEN bucket < 90 THEN 'valid' ELSE 'test' END AS split FROM b")
def sha1_split(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", tx.sha1_bucket(F.col("o_orderkey").cast("string")).alias("bucket")).withColumn("split", tx.split_of(F.col("bucket"), 80, 10))


@query("SELECT o_orderkey, 'drafter' || (o_custkey % 30) || '_c' || (o_orderkey % 7) AS circuit FROM orders")
def circuit_names(spark, sf_dir):
    name = F.concat(F.lit("x_drafter_"), (F.col("o_custkey") % 30).cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "_c_").otherwise("_c"), (F.col("o_orderkey") % 7).cast("string"), F.lit("_d1_p2.jpg"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", tx.circuit_of(name).alias("circuit"))


@query("SELECT CASE WHEN source LIKE 'src1%' THEN 'src1' WHEN source LIKE 'src2%' THEN 'src2' ELSE 'other' END AS origin, count(*) AS n FROM documents GROUP BY 1")
def source_names(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").groupBy(tx.source_of(F.col("source"), ["src1", "src2"]).alias("origin")).agg(F.count(F.lit(1)).alias("n"))


_V = [f"TRY_CAST(t[{i + 1}] AS DOUBLE)" for i in range(5)]


@query(
    _with(fx.LABELS_SQL, "s AS (SELECT *, string_split(line, ' ') AS t FROM label_lines)", "v AS (SELECT file, line_no, t, " + ", ".join(f"{x} AS v{i}" for i, x in enumerate(_V)) + " FROM s)")
    + "SELECT file, line_no, CAST(trunc(v0) AS BIGINT) AS cls, least(greatest(v1, 0), 1) AS cx, least(greatest(v2, 0), 1) AS cy, least(greatest(v3, 0), 1) AS w, least(greatest(v4, 0), 1) AS h FROM v WHERE len(t) >= 5 AND trunc(v0) BETWEEN 0 AND 99 AND v1 IS NOT NULL AND v2 IS NOT NULL AND least(greatest(v3, 0), 1) >= 1e-4 AND least(greatest(v4, 0), 1) >= 1e-4"
)
def label_clean(spark, sf_dir):
    return etl.cleaned_labels(fx.label_lines(spark, sf_dir), 100)


@query(
    _with(fx.LABELS_SQL, "s AS (SELECT line, string_split(line, ' ') AS t FROM label_lines)", "v AS (SELECT line, t, " + ", ".join(f"{x} AS v{i}" for i, x in enumerate(_V)) + " FROM s)", "i AS (SELECT line, CASE WHEN len(t) <> 5 THEN 'columns' WHEN v0 IS NULL THEN 'parse' WHEN v0 < 0 OR v0 >= 100 THEN 'class' WHEN v3 <= 0 OR v4 <= 0 THEN 'area' WHEN v1 > 1.01 OR v2 > 1.01 OR v3 > 1.01 OR v4 > 1.01 THEN 'bounds' END AS issue FROM v)")
    + "SELECT issue, count(*) AS n, list_sort(list(DISTINCT line))[1:10] AS examples FROM i WHERE issue IS NOT NULL GROUP BY issue"
)
def label_sanity(spark, sf_dir):
    return etl.label_sanity(fx.label_lines(spark, sf_dir), 100)


@query(_with(fx.LABELS_SQL, "s AS (SELECT *, string_split(line, ' ') AS t, file = '3' AND line_no % 3 = 0 AS cut FROM label_lines)", "q AS (SELECT file, line_no, CASE WHEN cut THEN t[1:4] ELSE t END AS t FROM s)") + "SELECT file, line_no, array_to_string(t[1:5], ' ') AS label, coalesce(t[6], 'R0') AS orientation FROM q WHERE file NOT IN (SELECT file FROM q WHERE len(t) NOT IN (5, 6))")
def orientation_strip(spark, sf_dir):
    cut = (F.col("file") == "3") & (F.col("line_no") % 3 == 0)
    lines = fx.label_lines(spark, sf_dir).withColumn("line", F.when(cut, F.concat_ws(" ", F.slice(F.split("line", " "), 1, 4))).otherwise(F.col("line")))
    return etl.split_orientation(lines)


@query(
    _with(fx.BOXES_SQL, "c AS (SELECT det_id, greatest(CAST(x0 - 20 AS DOUBLE), 0) AS a0, greatest(CAST(y0 - 20 AS DOUBLE), 0) AS b0, least(CAST(x1 - 20 AS DOUBLE), 200) AS a1, least(CAST(y1 - 20 AS DOUBLE), 160) AS b1 FROM boxes)")
    + "SELECT det_id, CASE WHEN a1 > a0 AND b1 > b0 THEN printf('%d %.6f %.6f %.6f %.6f', det_id % 5, (a0 + a1) / 2 / 200, (b0 + b1) / 2 / 160, (a1 - a0) / 200, (b1 - b0) / 160) END AS line FROM c"
)
def coco_to_yolo(spark, sf_dir):
    f = lambda c: F.col(c).cast("double")
    return fx.boxes(spark, sf_dir).select("det_id", tx.yolo_line(F.col("det_id") % 5, f("x0") - 20, f("y0") - 20, f("x1") - f("x0"), f("y1") - f("y0"), F.lit(200.0), F.lit(160.0)).alias("line"))


@query(_with(fx.INSTANCES_SQL) + "SELECT cls, count(*) AS instances, count(DISTINCT image_id) AS images FROM instances GROUP BY cls")
def class_hist(spark, sf_dir):
    return etl.class_histogram(fx.label_rows(spark, sf_dir))


@query(_with(fx.INSTANCES_SQL) + "SELECT cls, count(i.cls) FILTER (split = 'train') AS train, count(i.cls) FILTER (split = 'valid') AS valid, count(i.cls) FILTER (split = 'test') AS test, count(i.cls) AS total FROM (SELECT DISTINCT cls FROM instances UNION ALL SELECT 'none') d LEFT JOIN instances i USING (cls) GROUP BY cls")
def hist_pivot(spark, sf_dir):
    rows = fx.label_rows(spark, sf_dir)
    classes = rows.select("cls").distinct().unionByName(spark.createDataFrame([("none",)], "cls string"))
    return etl.histogram_by_split(rows, classes, ["train", "valid", "test"])


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def source_split_rollup(spark, sf_dir):
    return etl.source_split_rollup(fx.table(spark, sf_dir, "documents"), "source", "lang")


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 3) AS n_splits FROM orders GROUP BY o_custkey HAVING n_splits > 1")
def leak_groups(spark, sf_dir):
    return etl.leak_groups(fx.table(spark, sf_dir, "orders").withColumn("split", F.col("o_orderkey") % 3), "o_custkey", "split")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY source, lang, doc_id) = 1")
def dedup_content(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text"))
    return etl.first_by_content(files, "text", ["source", "lang", "doc_id"]).select("doc_id", "sha256")


_HIST = "hist AS (SELECT lower(p_brand) AS cls, count(*) AS instances, count(DISTINCT l_orderkey) AS images FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def _brand_hist(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("cls"))
    return etl.class_histogram(fx.table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_orderkey").alias("image_id")).join(parts, "l_partkey"))


@query(_with(_HIST, "o AS (SELECT *, CAST(substr(cls, 7) AS BIGINT) AS old_id, instances >= 2400 AND images >= 2200 AS keep FROM hist)") + "SELECT old_id, cls, instances, keep, CASE WHEN keep THEN sum(CASE WHEN keep THEN 1 ELSE 0 END) OVER (ORDER BY old_id)::BIGINT - 1 ELSE -1 END AS new_id FROM o")
def freeze_taxonomy(spark, sf_dir):
    return etl.frozen_taxonomy(_brand_hist(spark, sf_dir).withColumn("old_id", F.substring("cls", 7, 9).cast("bigint")), 2400, 2200)


@query(_with(_HIST) + "SELECT CASE WHEN instances = 0 THEN 'zero' WHEN instances < 30 THEN 'under_30' WHEN instances < 100 THEN 'under_100' ELSE 'enough' END AS bucket, count(*) AS n_classes, CAST(sum(instances) AS BIGINT) AS instances FROM (SELECT instances // (1 + CAST(substr(cls, 7) AS BIGINT) * CAST(substr(cls, 7) AS BIGINT)) AS instances FROM hist) GROUP BY 1")
def support_buckets(spark, sf_dir):
    n = F.substring("cls", 7, 9).cast("bigint")
    return etl.support_buckets(_brand_hist(spark, sf_dir).withColumn("instances", F.floor(F.col("instances") / (1 + n * n))))


_CLASSES = ["nmos.cross", "npn.cross", "generator", "buzzer", "thermistor", "resistor", "transistor"]


@query("WITH c AS (SELECT (" + str(_CLASSES) + ")[p_partkey % 7 + 1] AS old FROM part JOIN lineitem ON l_partkey = p_partkey) SELECT old, CASE old WHEN 'nmos.cross' THEN 'nmos' WHEN 'npn.cross' THEN 'npn' WHEN 'transistor' THEN 'transistor.bjt' ELSE 'unknown' END AS new, count(*) AS n FROM c WHERE old <> 'resistor' GROUP BY ALL")
def fold_classes(spark, sf_dir):
    cls = F.element_at(F.array(*[F.lit(x) for x in _CLASSES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    return etl.fold_report(fx.table(spark, sf_dir, "lineitem").select(cls.alias("cls")))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 8), doc_id) <= 40")
def capped_sample(spark, sf_dir):
    return etl.capped_sample(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 40)


@query("SELECT doc_id AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, sf_dir):
    return etl.missing_labels(fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("stem")), fx.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem")))


@query(_with(fx.INSTANCES_SQL, "t AS (SELECT cls, row_number() OVER (ORDER BY cls) - 1 AS id FROM (SELECT DISTINCT cls FROM instances))") + "SELECT split, id AS new_id, count(*) AS n FROM instances JOIN t USING (cls) WHERE id < 4 GROUP BY ALL")
def remap_labels(spark, sf_dir):
    rows = fx.label_rows(spark, sf_dir)
    kept = etl.vocabulary(rows, "cls").withColumn("new_id", F.when(F.col("id") < 4, F.col("id")).otherwise(-1)).drop("id")
    return etl.remapped(rows, kept).groupBy("split", "new_id").agg(F.count(F.lit(1)).alias("n"))


@query("WITH f AS (SELECT source AS dataset, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_first FROM documents) SELECT dataset, count(*) AS images, count(*) FILTER (NOT is_first) AS duplicates, count(*) FILTER (is_first) AS kept FROM f GROUP BY dataset")
def merge_stats(spark, sf_dir):
    files = fx.table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    first = etl.first_by_content(files, "text", ["doc_id"]).select(F.col("doc_id").alias("kept_id"))
    rows = files.join(first, files["doc_id"] == first["kept_id"], "left").select(F.col("source").alias("dataset"), F.col("kept_id").isNotNull().alias("is_first"))
    return etl.merge_stats(rows)


@query("SELECT event_type AS tag, avg(value) AS mean_recall, min(value) AS min_recall, count(*) AS n FROM (SELECT event_type, CAST(floor(value) AS DOUBLE) AS value FROM events) GROUP BY event_type")
def model_rank(spark, sf_dir):
    return etl.model_rank(fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("tag"), F.floor("value").cast("double").alias("recall")))


@query("SELECT o_orderkey, o_custkey, o_orderkey % 3 AS was, o_custkey % 3 AS becomes FROM orders WHERE o_orderkey % 3 <> o_custkey % 3")
def resplit_moves(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("was"), (F.col("o_custkey") % 3).alias("becomes"))
    return etl.moves(rows, "was", "becomes")


@query("SELECT count(*) AS n, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, coalesce(sum(strlen(text)), 0) <= 15032385536 AS ok FROM documents")
def publish_guard(spark, sf_dir):
    return etl.publishable(fx.table(spark, sf_dir, "documents").select(F.octet_length("text").cast("bigint").alias("length")))


# ---- runs, pixels, pins, graphs ----


_RUNS = "o AS (SELECT l_suppkey, l_partkey, CASE WHEN l_partkey - lag(l_partkey) OVER w <= 3 THEN 0 ELSE 1 END AS start FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_partkey)), r AS (SELECT *, sum(start) OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS cluster FROM o)"


@query(_with(_RUNS) + "SELECT l_suppkey, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, min(l_partkey) AS low, max(l_partkey) AS high, list_sort(list(l_partkey))[count(*) // 2 + 1] AS middle FROM r GROUP BY l_suppkey, cluster")
def rail_snap(spark, sf_dir):
    return islands.gap_clusters(fx.table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_partkey", 3)


@query(
    "WITH b AS (SELECT l_suppkey, l_partkey AS place, count(*) AS weight FROM lineitem GROUP BY ALL), o AS (SELECT *, CASE WHEN place - lag(place) OVER (PARTITION BY l_suppkey ORDER BY place) <= 3 THEN 0 ELSE 1 END AS start FROM b), r AS (SELECT *, sum(start) OVER (PARTITION BY l_suppkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS run FROM o) SELECT l_suppkey, CAST(run AS BIGINT) AS run, CAST(floor(avg(place)) AS BIGINT) AS centre, CAST(sum(weight) AS BIGINT) AS support FROM r GROUP BY l_suppkey, run HAVING support >= 4"
)
def profile_runs(spark, sf_dir):
    bins = fx.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_partkey").alias("place")).agg(F.count(F.lit(1)).alias("weight"))
    return islands.profile_runs(bins, ["l_suppkey"], "place", "weight", 3, 4)


_GRAY = "gray AS (SELECT l_suppkey % 10 AS image_id, (l_partkey * 7 + l_linenumber * 31) % 256 AS value FROM lineitem WHERE l_partkey % 3 <> l_suppkey % 2)"


@query(
    _with(_GRAY, "h AS (SELECT image_id, value, count(*) AS n FROM gray GROUP BY ALL)", "c AS (SELECT image_id, value, CAST(sum(n) OVER u AS BIGINT) AS w0, CAST(sum(n * value) OVER u AS BIGINT) AS s0, CAST(sum(n) OVER (PARTITION BY image_id) AS BIGINT) AS w, CAST(sum(n * value) OVER (PARTITION BY image_id) AS BIGINT) AS s FROM h WINDOW u AS (PARTITION BY image_id ORDER BY value ROWS UNBOUNDED PRECEDING))", "b AS (SELECT image_id, value, CAST(w0 AS DOUBLE) * (w - w0) * pow(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / (w - w0), 2) AS between_ FROM c WHERE w0 < w)")
    + "SELECT image_id, value AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY between_ DESC, value) = 1"
)
def otsu_threshold(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> l_suppkey % 2")
    return raster.otsu(lines.select((F.col("l_suppkey") % 10).alias("image_id"), ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 31) % 256).alias("value")))


@query(_with(fx.PIXELS_SQL, fx.BOXES_SQL, _SMALL) + "SELECT image_id, x, y FROM pixels p WHERE NOT EXISTS (SELECT 1 FROM small_boxes b WHERE b.image_id = p.image_id AND p.x >= b.x0 - 3 AND p.x < b.x1 + 3 AND p.y >= b.y0 - 3 AND p.y < b.y1 + 3)")
def mask_interiors(spark, sf_dir):
    return raster.mask_interiors(fx.pixels(spark, sf_dir), _small(spark, sf_dir))


_DEGREE = "SELECT p.image_id, p.x, p.y, count(q.x) AS degree FROM pixels p LEFT JOIN pixels q ON q.image_id = p.image_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 AND (q.x <> p.x OR q.y <> p.y) GROUP BY ALL"


@query(_with(fx.PIXELS_SQL) + _DEGREE)
def pixel_degree(spark, sf_dir):
    return raster.pixel_degree(fx.pixels(spark, sf_dir))


@query(_with(fx.PIXELS_SQL, f"d AS ({_DEGREE})") + "SELECT image_id, x, y FROM d WHERE degree = 1")
def wire_endpoints(spark, sf_dir):
    return raster.wire_endpoints(fx.pixels(spark, sf_dir))


@query(_with(fx.PIXELS_SQL, "e AS (SELECT a.image_id, a.x, a.y FROM (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM pixels, (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy)) a JOIN (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM pixels, (SELECT unnest(range(-3, 4)) AS dx), (SELECT unnest(range(-3, 4)) AS dy)) b ON b.image_id = a.image_id AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY ALL HAVING count(*) = 25)") + "SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM e, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)")
def opened_blobs(spark, sf_dir):
    square = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx in range(-3, 4) for dy in range(-3, 4)])
    thick = fx.pixels(spark, sf_dir).select("image_id", F.explode(square).alias("p")).select("image_id", "p.x", "p.y").distinct()
    return raster.opened(thick)


@query(
    "WITH d AS (SELECT l_suppkey % 10 AS image_id, l_orderkey % 7 AS det_id, l_linenumber * 40 + l_partkey % 9 AS x, l_linenumber * 5 * (l_orderkey % 7) + l_suppkey % 11 AS y FROM lineitem), s AS (SELECT image_id, det_id, count(*) AS n, var_samp(x) AS sxx, var_samp(y) AS syy, covar_samp(x, y) AS sxy FROM d GROUP BY ALL), m AS (SELECT *, (sxx + syy) / 2 AS mean, sqrt(pow((sxx - syy) / 2, 2) + sxy * sxy) AS root FROM s) SELECT image_id, det_id, n, CASE WHEN n >= 40 AND mean + root >= 2.5 * greatest(mean - root, 1e-9) THEN CAST(round((degrees(atan2(2 * sxy, sxx - syy) / 2) + 180) % 180 * 100) AS BIGINT) END AS hundredths FROM m"
)
def pca_axis(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "lineitem")
    dark = lines.select((F.col("l_suppkey") % 10).alias("image_id"), (F.col("l_orderkey") % 7).alias("det_id"), (F.col("l_linenumber") * 40 + F.col("l_partkey") % 9).alias("x"), (F.col("l_linenumber") * 5 * (F.col("l_orderkey") % 7) + F.col("l_suppkey") % 11).alias("y"))
    return raster.pca_axis(dark).select("image_id", "det_id", "n", F.round(F.col("degrees") * 100).cast("bigint").alias("hundredths"))


def _template_sql() -> str:
    # values of their own, not those of the model
    return """t(cls, role, nx, ny, conf) AS (VALUES ('resistor', 'p0', 0, 0.5, 0.9), ('resistor', 'p1', 1, 0.5, 0.9), ('npn', 'c', 0.85, 0, 0.9), ('npn', 'b', 0, 0.5, 0.9), ('npn', 'e', 0.85, 1, 0.7),
  ('gnd', 'g', 0.5, 0, 0.9), ('not', 'in0', 0, 0.5, 0.9), ('not', 'out', 1, 0.5, 0.9), ('tgate', 'a', 0, 0.3, 0.9), ('tgate', 'b', 0, 0.7, 0.9), ('tgate', 'c', 1, 0.3, 0.9), ('tgate', 'd', 1, 0.7, 0.6)),
 comps AS (SELECT det_id AS comp_id, (['resistor', 'npn', 'gnd', 'not', 'tgate', 'text', 'integrated_circuit', 'strange'])[det_id % 8 + 1] AS cls, (det_id % 4) * 90 AS o, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM boxes),
 p AS (SELECT comp_id, role, CAST(nx AS DOUBLE) AS nx, CAST(ny AS DOUBLE) AS ny, CAST(conf AS DOUBLE) AS conf, o, x0, y0, x1, y1 FROM comps JOIN t USING (cls)
  UNION ALL SELECT comp_id, r, CASE r WHEN 'p0' THEN 0 ELSE 1 END, 0.5, 0.5, o, x0, y0, x1, y1 FROM comps, (VALUES ('p0'), ('p1')) v(r) WHERE cls = 'strange'
  UNION ALL SELECT comp_id, side || i, CASE side WHEN 'L' THEN 0 ELSE 1 END, (i + 1) / CAST(n + 1 AS DOUBLE), 0.5, o, x0, y0, x1, y1 FROM (SELECT *, greatest(2, CAST(round_even((y1 - y0) / greatest(x1 - x0, y1 - y0) * 8, 0) AS BIGINT)) AS n FROM comps WHERE cls = 'integrated_circuit') c, LATERAL (SELECT unnest(range(0, n)) AS i) g, (VALUES ('L'), ('R')) s(side)),
 q AS (SELECT *, CASE o WHEN 0 THEN nx WHEN 90 THEN 1 - ny WHEN 180 THEN 1 - nx ELSE ny END AS rx, CASE o WHEN 0 THEN ny WHEN 90 THEN nx WHEN 180 THEN 1 - ny ELSE 1 - nx END AS ry FROM p)"""


@query(_with(fx.BOXES_SQL, _template_sql()) + "SELECT comp_id, role, CAST(round((x0 + rx * (x1 - x0)) * 1000) AS BIGINT) AS x, CAST(round((y0 + ry * (y1 - y0)) * 1000) AS BIGINT) AS y, conf FROM q")
def template_pins(spark, sf_dir):
    cls = F.element_at(F.array(*[F.lit(x) for x in ("resistor", "npn", "gnd", "not", "tgate", "text", "integrated_circuit", "strange")]), (F.col("det_id") % 8 + 1).cast("int"))
    boxes = fx.boxes(spark, sf_dir)
    comps = boxes.select(F.col("det_id").alias("comp_id"), cls.alias("cls"), ((F.col("det_id") % 4) * 90).alias("orientation"), *[F.col(x).cast("double").alias(x) for x in ("x0", "y0", "x1", "y1")])
    thousandths = lambda c: F.round(F.col(c) * 1000).cast("bigint").alias(c)
    return pin_ops.template_pins(comps).select("comp_id", "role", thousandths("x"), thousandths("y"), "conf")


@query(
    _with(fx.PIXELS_SQL, fx.BOXES_SQL, "m AS (SELECT b.image_id, b.det_id, b.x0, b.y0, b.x1, b.y1, p.x, p.y FROM boxes b JOIN pixels p ON p.image_id = b.image_id)", "e AS (SELECT image_id, det_id, CASE WHEN y BETWEEN y0 AND y1 AND x BETWEEN x0 - 10 AND x0 - 1 THEN 'left' WHEN y BETWEEN y0 AND y1 AND x BETWEEN x1 + 1 AND x1 + 10 THEN 'right' WHEN x BETWEEN x0 AND x1 AND y BETWEEN y0 - 10 AND y0 - 1 THEN 'top' WHEN x BETWEEN x0 AND x1 AND y BETWEEN y1 + 1 AND y1 + 10 THEN 'bottom' END AS edge, x, y FROM m)")
    + "SELECT image_id, det_id, edge, CASE WHEN edge IN ('left', 'right') THEN y ELSE x END AS place, count(*) AS support FROM e WHERE edge IS NOT NULL GROUP BY image_id, det_id, edge, CASE WHEN edge IN ('left', 'right') THEN y ELSE x END HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY image_id, det_id, edge ORDER BY count(*) DESC, place) = 1"
)
def edge_profiles(spark, sf_dir):
    return pin_ops.edge_profiles(fx.boxes(spark, sf_dir), fx.pixels(spark, sf_dir))


_EDGES = _with(SPARSE, "g AS (SELECT max(CASE WHEN slot = 0 THEN net END) AS u, max(CASE WHEN slot = 1 THEN net END) AS v FROM pins GROUP BY comp_id)", "edges AS (SELECT DISTINCT u, v FROM g WHERE u <> v)")


@query(
    _EDGES.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + """,
sides AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
label(node, root) USING KEY (node) AS (SELECT DISTINCT u, u FROM sides UNION (SELECT s.v, min(l.root) FROM label l JOIN sides s ON s.u = l.node JOIN recurring.label r ON r.node = s.v WHERE l.root < r.root GROUP BY s.v))
SELECT node, root FROM label"""
)
def connected_components(spark, sf_dir):
    pins = fx.circuit(spark, sf_dir, fx.SPARSE)[1]
    ends = pins.groupBy("comp_id").agg(F.max(F.when(F.col("slot") == 0, F.col("net"))).alias("u"), F.max(F.when(F.col("slot") == 1, F.col("net"))).alias("v"))
    return star_labels(ends.where("u <> v").select("u", "v"))


@query(_with(SPARSE) + "SELECT comp_id, net, count(*) AS n FROM pins JOIN fan USING (net) WHERE fanout >= 6 GROUP BY ALL")
def backbone(spark, sf_dir):
    return graph.backbone(fx.circuit(spark, sf_dir, fx.SPARSE)[1], 6)


@query(_with(fx.BOXES_SQL) + "SELECT det_id, CASE WHEN y1 - y0 <> x1 - x0 OR det_id % 2 = 0 THEN ['WIRE ' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y0, 'WIRE ' || x1 || ' ' || y0 || ' ' || x1 || ' ' || y1] ELSE ['WIRE ' || x0 || ' ' || y0 || ' ' || x1 || ' ' || y0] END AS wires FROM boxes")
def wire_commands(spark, sf_dir):
    flat = (F.col("y1") - F.col("y0") == F.col("x1") - F.col("x0")) & (F.col("det_id") % 2 == 1)
    boxes = fx.boxes(spark, sf_dir).withColumn("y1", F.when(flat, F.col("y0")).otherwise(F.col("y1")))
    return boxes.select("det_id", schematic.wire_text(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("wires"))


@query(_with(fx.BOXES_SQL, "p AS (SELECT *, (det_id % 4) * 90 AS o FROM boxes)") + "SELECT det_id, CAST(CASE o WHEN 0 THEN x0 + 0.25 * (x1 - x0) WHEN 90 THEN x0 + 1.0 * (x1 - x0) WHEN 180 THEN x0 + 0.75 * (x1 - x0) ELSE x0 END AS DOUBLE) AS x, CAST(CASE o WHEN 0 THEN y0 WHEN 90 THEN y0 + 0.25 * (y1 - y0) WHEN 180 THEN y1 ELSE y0 + 0.75 * (y1 - y0) END AS DOUBLE) AS y FROM p")
def rotated_points(spark, sf_dir):
    turned = rotated(F.lit(0.25), F.lit(0.0), (F.col("det_id") % 4) * 90)
    box = [F.col(x).cast("double") for x in ("x0", "y0", "x1", "y1")]
    return fx.boxes(spark, sf_dir).withColumn("t", turned).select("det_id", in_box(F.col("t.x"), F.col("t.y"), *box).alias("p")).select("det_id", "p.x", "p.y")


# ---- wires and fragments ----


_LINES = fx.PIXELS_SQL.replace("SELECT DISTINCT p_partkey % 20 AS image_id", "SELECT DISTINCT p_partkey % 20 AS image_id, p_partkey AS frag")
_INK = "ink AS (SELECT image_id, x, y, min(frag) AS frag FROM pixels GROUP BY ALL)"


def _ink(spark, sf_dir):
    """Pixels of the least part that draws them, as fragments."""
    key = F.col("p_partkey")
    rows = fx.table(spark, sf_dir, "part").where(key % 5 == 0).select(key.alias("frag"), (key % 20).alias("image_id"), ((key * 37) % 100).alias("x"), ((key * 91) % 100).alias("y"), "p_size", F.explode(F.sequence(F.lit(0), F.col("p_size") % 20 + 3)).alias("i"))
    flat = F.col("p_size") % 2 == 0
    x, y = (F.col("x") + F.when(flat, F.col("i")).otherwise(0)).cast("bigint"), (F.col("y") + F.when(flat, 0).otherwise(F.col("i"))).cast("bigint")
    return rows.select("image_id", x.alias("x"), y.alias("y"), "frag").groupBy("image_id", "x", "y").agg(F.min("frag").alias("frag"))


def _points(spark, sf_dir):
    return fx.dots(spark, sf_dir).select("image_id", F.col("dot_id").alias("point_id"), (F.col("x") % 110).alias("x"), (F.col("y") % 110).alias("y"))


_SPOTS = fx.DOTS_SQL + ", spots AS (SELECT image_id, dot_id AS point_id, x % 110 AS x, y % 110 AS y FROM dots)"


@query(
    "WITH RECURSIVE " + _LINES + ", " + _INK + ", " + _SPOTS + """, touch AS (SELECT DISTINCT s.point_id, i.image_id, i.frag FROM spots s JOIN ink i ON i.image_id = s.image_id AND abs(i.x - s.x) <= 10 AND abs(i.y - s.y) <= 10),
 sides AS (SELECT DISTINCT a.image_id, a.frag AS u, b.frag AS v FROM touch a JOIN touch b ON a.point_id = b.point_id), reach(image_id, node, r) AS (SELECT DISTINCT image_id, frag, frag FROM ink UNION SELECT s.image_id, s.v, r FROM reach JOIN sides s ON s.image_id = reach.image_id AND s.u = node WHERE r < s.v)
SELECT image_id, node AS frag, dense_rank() OVER (PARTITION BY image_id ORDER BY min(r)) - 1 AS net FROM reach GROUP BY image_id, node"""
)
def dot_nets(spark, sf_dir):
    return wires.wire_nets(_ink(spark, sf_dir), _points(spark, sf_dir).withColumnRenamed("point_id", "dot_id"))


@query(_with(_LINES, _INK, _SPOTS) + "SELECT s.image_id, s.point_id AS pin_id, i.frag, abs(i.x - s.x) + abs(i.y - s.y) AS dist FROM spots s JOIN ink i ON i.image_id = s.image_id AND abs(i.x - s.x) + abs(i.y - s.y) <= 12 QUALIFY row_number() OVER (PARTITION BY s.point_id ORDER BY abs(i.x - s.x) + abs(i.y - s.y), i.frag) = 1")
def pin_fragments(spark, sf_dir):
    return wires.pin_fragments(_points(spark, sf_dir).withColumnRenamed("point_id", "pin_id"), _ink(spark, sf_dir))


@query(_with(_LINES, _INK, _SPOTS, "n AS (SELECT s.image_id, s.point_id, i.frag, count(*) AS n, min(abs(i.x - s.x) + abs(i.y - s.y)) AS near FROM spots s JOIN ink i ON i.image_id = s.image_id AND abs(i.x - s.x) <= 9 AND abs(i.y - s.y) <= 9 GROUP BY ALL)") + "SELECT image_id, point_id, frag, n FROM n QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY n DESC, near, frag) = 1")
def fragment_overlap(spark, sf_dir):
    return wires.fragment_by_overlap(_points(spark, sf_dir), _ink(spark, sf_dir))


@query(_with(_LINES, _INK, _SPOTS) + "SELECT s.image_id, s.point_id, i.frag % 6 AS enet, min(abs(i.x - s.x) + abs(i.y - s.y)) AS dist FROM spots s JOIN ink i ON i.image_id = s.image_id AND abs(i.x - s.x) + abs(i.y - s.y) <= 60 GROUP BY ALL")
def copper_distance(spark, sf_dir):
    return wires.copper_distance(_points(spark, sf_dir), _ink(spark, sf_dir).withColumn("enet", F.col("frag") % 6), 60)


@query(
    "WITH RECURSIVE " + fx.DOTS_SQL + """, c AS (SELECT DISTINCT image_id, x // 24 AS gx, y // 24 AS gy, image_id * 4294967296 + (x // 24) * 65536 + y // 24 AS cell FROM dots),
 sides AS (SELECT a.cell AS u, b.cell AS v FROM c a JOIN c b ON a.image_id = b.image_id AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1), reach(node, r) AS (SELECT cell, cell FROM c UNION SELECT s.v, r FROM reach JOIN sides s ON s.u = node WHERE r < s.v),
 root AS (SELECT node, min(r) AS cluster FROM reach GROUP BY node), g AS (SELECT d.image_id, cluster, count(*) AS n, greatest(min(x) - 5, 0) AS x0, greatest(min(y) - 5, 0) AS y0, least(max(x) + 5, 240) AS x1, least(max(y) + 5, 240) AS y1 FROM dots d JOIN root ON node = d.image_id * 4294967296 + (x // 24) * 65536 + y // 24 GROUP BY ALL)
SELECT * FROM g WHERE n >= 2 AND (x1 - x0) * (y1 - y0) <= 0.25 * 240 * 240"""
)
def endpoint_cells(spark, sf_dir):
    return wires.proposals(fx.dots(spark, sf_dir).select("image_id", "x", "y"), 240, 240, grid=24, pad=5)


_X = "x AS (SELECT image_id, point_id, x, y, 2 + point_id % 3 AS arms, (point_id % 5) / CAST(5 AS DOUBLE) AS fill FROM spots), circles AS (SELECT p_partkey % 20 AS image_id, (p_partkey * 17) % 1100 AS x, (p_partkey * 23) % 1100 AS y, 4 + p_size % 9 AS r FROM part)"


@query(
    _with(_LINES, _INK, _SPOTS, _X, fx.BOXES_SQL, _SMALL, "small AS (SELECT image_id, frag FROM ink GROUP BY ALL HAVING count(*) < 14)")
    + """SELECT image_id, point_id, CASE WHEN fill >= 0.6 OR arms <= 3 THEN 'dotted'
  WHEN EXISTS (SELECT 1 FROM small_boxes b WHERE b.image_id = x.image_id AND x.x BETWEEN b.x0 - 5 AND b.x1 + 5 AND x.y BETWEEN b.y0 - 5 AND b.y1 + 5)
   OR EXISTS (SELECT 1 FROM circles c WHERE c.image_id = x.image_id AND abs(sqrt((x.x - c.x) ** 2 + (x.y - c.y) ** 2) - c.r) <= 15) OR (SELECT count(*) FROM circles c WHERE c.image_id = x.image_id AND sqrt((x.x - c.x) ** 2 + (x.y - c.y) ** 2) <= 55) >= 2 THEN 'explained'
  WHEN EXISTS (SELECT 1 FROM ink i WHERE i.image_id = x.image_id AND abs(i.x - x.x) <= 10 AND abs(i.y - x.y) <= 10) THEN 'text' ELSE 'unexplained' END AS kind FROM x"""
)
def explained_crossings(spark, sf_dir):
    x = _points(spark, sf_dir).withColumn("arms", 2 + F.col("point_id") % 3).withColumn("fill", (F.col("point_id") % 5) / 5.0)
    key = F.col("p_partkey")
    circles = fx.table(spark, sf_dir, "part").select((key % 20).alias("image_id"), ((key * 17) % 1100).alias("x"), ((key * 23) % 1100).alias("y"), (4 + F.col("p_size") % 9).alias("r"))
    return wires.explained_crossings(x, _small(spark, sf_dir), circles, _ink(spark, sf_dir), box_dist=5)


@query("SELECT p_partkey AS comp_id, CASE WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN 90 WHEN p_partkey % 3 = 2 AND p_partkey % 4 = 1 AND (p_partkey % 10) / 10.0 >= 0.2 THEN 90 ELSE 0 END AS orientation FROM part")
def orientation_votes(spark, sf_dir):
    n = F.col("det_id") % 3
    boxes = fx.boxes(spark, sf_dir).withColumn("cls", F.when(n == 0, "gnd").when(n == 1, "npn").otherwise("resistor")).withColumnRenamed("det_id", "comp_id")
    share = F.when(F.col("comp_id") % 3 == 1, F.when(F.col("comp_id") % 2 == 0, 0.5).otherwise(0.0)).otherwise((F.col("comp_id") % 10) / 10.0)
    upright = (F.col("comp_id") % 3 == 2) & (F.col("comp_id") % 4 == 1)
    edge = F.explode(F.when(upright, F.array(F.lit("top"), F.lit("bottom"))).otherwise(F.array(F.lit("left"), F.lit("right"))))
    edges = boxes.select("comp_id", edge.alias("edge"), share.alias("share"))
    return wires.orientation_votes(boxes, edges).select("comp_id", "orientation")


# ---- kernels, without SQL ----


@query()
def ic_footprints(spark, sf_dir):
    key = F.col("p_partkey")
    circles = fx.table(spark, sf_dir, "part").select((key % 200).alias("image_id"), ((key * 37) % 400).cast("double").alias("x"), ((key % 7) * 60).cast("double").alias("y"))
    return wires.unclaimed(wires.footprints(circles, 600, 600), fx.boxes(spark, sf_dir))


@query()
def ic_synthesis(spark, sf_dir):
    key = F.col("p_partkey")
    circles = fx.table(spark, sf_dir, "part").select((key % 20).alias("image_id"), ((key * 37) % 400).alias("x"), ((key % 7) * 60).alias("y"))
    ink = _ink(spark, sf_dir)
    found = wires.footprints(circles, 600, 600)
    return wires.synthesized(found, circles, ink, wires.wire_nets(ink, _points(spark, sf_dir).withColumnRenamed("point_id", "dot_id")))


def _net_points(spark, sf_dir):
    _, epins = _electrical(spark, sf_dir, fx.SPARSE)
    return fx.placed_pins(epins).where(F.col("enet") != GROUND).select(F.col("enet").alias("net"), "x", "y")


@query()
def mst_wires(spark, sf_dir):
    return graph.spanning_wires(_net_points(spark, sf_dir))


@query(
    "WITH RECURSIVE " + fx.PIXELS_SQL + """, label(image_id, x, y, root) USING KEY (image_id, x, y) AS (SELECT image_id, x, y, y * 1000 + x FROM pixels UNION (SELECT p.image_id, p.x, p.y, min(l.root) FROM label l JOIN pixels p ON p.image_id = l.image_id AND abs(p.x - l.x) <= 1 AND abs(p.y - l.y) <= 1
  JOIN recurring.label r ON r.image_id = p.image_id AND r.x = p.x AND r.y = p.y WHERE l.root < r.root GROUP BY p.image_id, p.x, p.y)), named AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS frag FROM label)
SELECT image_id, x, y, frag FROM named QUALIFY count(*) OVER (PARTITION BY image_id, frag) >= 4"""
)
def wire_fragments(spark, sf_dir):
    return raster.fragments(fx.pixels(spark, sf_dir), 4)


@query()
def maze_rescue(spark, sf_dir):
    starts = fx.dots(spark, sf_dir).select("image_id", F.col("dot_id").alias("point_id"), "x", "y", F.array(F.lit(1).cast("bigint")).alias("banned"))
    return raster.routes(raster.fragments(fx.pixels(spark, sf_dir), 4), starts, width=240, height=240)


@query()
def skeleton(spark, sf_dir):
    return raster.skeleton(opened_blobs(spark, sf_dir))


@query(
    _with(fx.PIXELS_SQL.replace("pixels AS", "lines AS"), "pixels AS (SELECT image_id, x, y FROM lines UNION SELECT image_id, y, x + 1 FROM lines)", f"d AS ({_DEGREE})", fx.DOTS_SQL)
    + "SELECT image_id, x, y FROM d WHERE degree >= 4 AND NOT EXISTS (SELECT 1 FROM dots WHERE dots.image_id = d.image_id AND (dots.x - d.x) ** 2 + (dots.y - d.y) ** 2 <= 196)"
)
def x_crossings(spark, sf_dir):
    one = fx.pixels(spark, sf_dir)
    crossed = one.unionByName(one.select("image_id", F.col("y").alias("x"), (F.col("x") + 1).alias("y"))).distinct()
    return raster.crossings(crossed, fx.dots(spark, sf_dir))


@query(
    _with(fx.PIXELS_SQL, fx.DOTS_SQL, "spot AS (SELECT i, CAST(round(9 * cos(2 * pi() * i / 64)) AS BIGINT) AS dx, CAST(round(9 * sin(2 * pi() * i / 64)) AS BIGINT) AS dy FROM (SELECT unnest(range(0, 64)) AS i))")
    + """, seen AS (SELECT d.image_id, d.dot_id, i, count(p.x) AS wire FROM dots d CROSS JOIN spot LEFT JOIN pixels p ON p.image_id = d.image_id AND p.x = d.x + dx AND p.y = d.y + dy GROUP BY ALL),
 walk AS (SELECT * FROM seen UNION ALL SELECT image_id, dot_id, i + 64, wire FROM seen WHERE i < 4), steps AS (SELECT *, coalesce(lag(wire) OVER (PARTITION BY image_id, dot_id ORDER BY i), 0) AS last FROM walk)
SELECT image_id, dot_id, count(*) FILTER (wire = 1 AND last = 0) AS runs FROM steps GROUP BY ALL"""
)
def ring_runs(spark, sf_dir):
    return raster.ring_runs(fx.pixels(spark, sf_dir), fx.dots(spark, sf_dir))


@query()
def asc_text(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    boxes = fx.boxes(spark, sf_dir).select(F.col("det_id").alias("comp_id"), "x0", "y0", "x1", "y1")
    placed = schematic.placements(comps.join(boxes, "comp_id"))
    return schematic.drawing(placed, fx.placed_pins(epins), graph.spanning_wires(_net_points(spark, sf_dir)))


_PASSES = _CAND.rstrip() + """,
 sickly AS (SELECT pin_id FROM pins LEFT JOIN fan USING (net) WHERE net IS NULL OR (fanout = 1 AND cls NOT IN ('gnd', 'vss'))), gone AS (SELECT comp_id FROM pins WHERE comp_id % 2 = 0 GROUP BY comp_id HAVING count(*) = count(*) FILTER (pin_id IN (SELECT pin_id FROM sickly) AND pin_id NOT IN (SELECT pin_id FROM cand))),
 left_over AS (SELECT * FROM placed WHERE comp_id NOT IN (SELECT comp_id FROM gone)), met AS (SELECT a.pin_id, b.net FROM left_over a JOIN left_over b ON a.image_id = b.image_id AND a.cls IN ('gnd', 'vss') AND b.cls IN ('gnd', 'vss') AND a.net IS NULL AND b.net IS NOT NULL AND abs(a.x - b.x) + abs(a.y - b.y) <= 120
   QUALIFY row_number() OVER (PARTITION BY a.pin_id ORDER BY abs(a.x - b.x) + abs(a.y - b.y), b.pin_id) = 1),
 homed AS (SELECT l.* REPLACE (coalesce(l.net, met.net) AS net) FROM left_over l LEFT JOIN met USING (pin_id)),
 free AS (SELECT c.*, h.comp_id FROM cand c JOIN homed h USING (pin_id) WHERE NOT EXISTS (SELECT 1 FROM homed s WHERE s.comp_id = h.comp_id AND s.pin_id <> h.pin_id AND s.net = c.enet)),
 best AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY pin_id ORDER BY rank) = 1)
SELECT 'prune' AS pass, comp_id AS pin_id, CAST(NULL AS BIGINT) AS before, CAST(NULL AS BIGINT) AS after FROM gone UNION ALL SELECT 'ground', pin_id, NULL, net FROM met
 UNION ALL SELECT 'attach', b.pin_id, h.net, b.enet FROM best b JOIN homed h USING (pin_id) WHERE score >= 1 AND dist <= 80 UNION ALL SELECT 'no-op', NULL, NULL, NULL"""


@query(_PASSES)
def corrected_pins(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    placed = fx.placed_pins(epins)
    candidates = materialize(repair.repair_candidates(comps, placed, motifs.voltage_dividers(comps, epins).select("tap")), "candidates")
    return repair.corrected(comps.withColumn("is_rescued", F.col("comp_id") % 2 == 0), placed, candidates)[2]


# ---- more of the same inventory ----


@query((_CAND + "SELECT * FROM cand").replace("GROUP BY s.pin_id, l.enet)", "GROUP BY s.pin_id, l.enet UNION ALL SELECT s.pin_id, c.enet, min(abs(s.x - c.x) + abs(s.y - c.y)), min(s.cls), min(f.fanout) FROM sick s JOIN copper c ON c.image_id = s.image_id AND abs(s.x - c.x) + abs(s.y - c.y) <= 120 AND (s.enet IS NULL OR s.enet <> c.enet) JOIN efan f ON f.enet = c.enet GROUP BY s.pin_id, c.enet), merged AS (SELECT pin_id, enet, min(dist) AS dist, min(cls) AS cls, min(fanout) AS fanout FROM near GROUP BY ALL)").replace("- dist AS fortieths FROM near)", "- dist AS fortieths FROM merged)").replace("near AS (SELECT s.pin_id", "copper AS (SELECT image_id, (x * 3 + 40) % 4001 AS x, (y * 7 + 11) % 4003 AS y, enet FROM placed WHERE enet IS NOT NULL), near AS (SELECT s.pin_id", 1))
def repair_with_copper(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    placed = fx.placed_pins(epins)
    copper = placed.where("enet is not null").select("image_id", ((F.col("x") * 3 + 40) % 4001).alias("x"), ((F.col("y") * 7 + 11) % 4003).alias("y"), "enet")
    return repair.repair_candidates(comps, placed, motifs.voltage_dividers(comps, epins).select("tap"), net_pixels=copper)


def _crossed(spark, sf_dir):
    one = fx.pixels(spark, sf_dir)
    return one.unionByName(one.select("image_id", F.col("y").alias("x"), (F.col("x") + 1).alias("y"))).distinct()


@query(
    "WITH RECURSIVE " + fx.PIXELS_SQL.replace("pixels AS", "lines AS") + ", pixels AS (SELECT image_id, x, y FROM lines UNION SELECT image_id, y, x + 1 FROM lines), " + f"d AS ({_DEGREE}), " + fx.DOTS_SQL + ", " + fx.BOXES_SQL + ", " + _SMALL + """,
 label(image_id, x, y, root) USING KEY (image_id, x, y) AS (SELECT image_id, x, y, y * 1000 + x FROM pixels UNION (SELECT p.image_id, p.x, p.y, min(l.root) FROM label l JOIN pixels p ON p.image_id = l.image_id AND abs(p.x - l.x) <= 1 AND abs(p.y - l.y) <= 1 JOIN recurring.label r ON r.image_id = p.image_id AND r.x = p.x AND r.y = p.y WHERE l.root < r.root GROUP BY p.image_id, p.x, p.y)),
 large AS (SELECT image_id, x, y FROM label QUALIFY count(*) OVER (PARTITION BY image_id, root) >= 25),
 c AS (SELECT image_id, x, y FROM d JOIN large USING (image_id, x, y) WHERE degree >= 4 AND NOT EXISTS (SELECT 1 FROM dots WHERE dots.image_id = d.image_id AND (dots.x - d.x) ** 2 + (dots.y - d.y) ** 2 <= 196)
   AND NOT EXISTS (SELECT 1 FROM small_boxes b WHERE b.image_id = d.image_id AND d.x BETWEEN b.x0 - 1 AND b.x1 + 1 AND d.y BETWEEN b.y0 - 1 AND b.y1 + 1)),
 wide AS (SELECT DISTINCT image_id, x + dx AS x, y + dy AS y FROM c, (SELECT unnest(range(-2, 3)) AS dx), (SELECT unnest(range(-2, 3)) AS dy)),
 part(image_id, x, y, root) USING KEY (image_id, x, y) AS (SELECT image_id, x, y, (y + 10) * 1000 + x + 10 FROM wide UNION (SELECT p.image_id, p.x, p.y, min(l.root) FROM part l JOIN wide p ON p.image_id = l.image_id AND abs(p.x - l.x) <= 1 AND abs(p.y - l.y) <= 1 JOIN recurring.part r ON r.image_id = p.image_id AND r.x = p.x AND r.y = p.y WHERE l.root < r.root GROUP BY p.image_id, p.x, p.y))
SELECT image_id, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS point_id, avg(x) AS x, avg(y) AS y, count(*) AS n FROM part GROUP BY image_id, root"""
)
def x_clusters(spark, sf_dir):
    pixels = _crossed(spark, sf_dir)
    return raster.crossing_clusters(pixels, raster.fragments(pixels, 1), fx.dots(spark, sf_dir), _small(spark, sf_dir), margin=1, least_area=25)


@query("WITH x AS (" + ORACLES["explained_crossings"] + ") SELECT image_id, CASE WHEN count(*) FILTER (kind = 'unexplained') > 0 THEN 'FLAG' ELSE 'PASS' END AS verdict, count(*) AS x_total, count(*) FILTER (kind = 'dotted') AS dotted, count(*) FILTER (kind = 'explained') AS explained, count(*) FILTER (kind = 'text') AS text, count(*) FILTER (kind = 'unexplained') AS unexplained, array_to_string(list_sort(list(point_id) FILTER (kind = 'unexplained'))[1:15], ',') AS examples FROM x GROUP BY image_id")
def crossing_no_dot(spark, sf_dir):
    out = checks.crossing_no_dot(explained_crossings(spark, sf_dir))
    return out.withColumn("examples", F.when(F.size("examples") > 0, F.array_join(F.transform("examples", lambda x: x.cast("string")), ",")))


@query(_with(SPARSE, *_ELEMENTS, "t AS (SELECT string_split(trim(string_split(text, ';')[1]), ' ') AS w FROM elements WHERE text IS NOT NULL)") + "SELECT w[1] AS element, place, w[place + 1] AS node FROM (SELECT w, unnest(range(1, 3)) AS place FROM t WHERE w[1][1] IN ('R', 'C', 'L', 'D', 'V', 'I')) UNION ALL SELECT w[1], place, w[place + 2] FROM (SELECT w, unnest(range(0, len(w) - 2)) AS place FROM t WHERE w[1][1] = 'X')")
def net_incidence(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    return netlist.net_incidence(netlist.spice_elements(comps, epins).select(F.split("text", ";")[0].alias("text")))


@query(_with(fx.BOXES_SQL, _SMALL, fx.DOTS_SQL) + "SELECT image_id, dot_id AS point_id, x, y FROM dots d WHERE NOT EXISTS (SELECT 1 FROM small_boxes b WHERE b.image_id = d.image_id AND d.x BETWEEN b.x0 - 6 AND b.x1 + 6 AND d.y BETWEEN b.y0 - 6 AND b.y1 + 6)")
def free_circles(spark, sf_dir):
    """Circles that no box explains, before they are grouped."""
    return spatial.points_near_boxes(fx.dots(spark, sf_dir).withColumnRenamed("dot_id", "point_id"), _small(spark, sf_dir), 6, near=False)


@query("SELECT doc_id, CASE WHEN lower(source) LIKE '%c1%' THEN 'c1' WHEN lower(source) LIKE 'src2%' THEN 'src2' ELSE 'other' END AS by_parts, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN source || '_a' END AS before_split FROM documents")
def source_rules(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("_train_x_test_y"))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("_a_valid_z"))).otherwise(F.col("source"))
    return docs.select("doc_id", tx.source_by_parts(F.upper("source"), ["c1"], ["src2"]).alias("by_parts"), tx.source_before_split(name).alias("before_split"))


@query(_with(fx.LABELS_SQL, "side AS (SELECT file, line_no, 'R' || (line_no % 4 * 90) AS orientation FROM label_lines WHERE line_no % 5 > 0)") + "SELECT l.file, l.line_no, orientation FROM label_lines l LEFT JOIN side s ON s.file = l.file AND s.line_no = l.line_no")
def orientation_zip(spark, sf_dir):
    lines = fx.label_lines(spark, sf_dir)
    side = lines.where("line_no % 5 > 0").select("file", "line_no", F.concat(F.lit("R"), (F.col("line_no") % 4 * 90).cast("string")).alias("orientation"))
    return etl.with_orientation(lines.select("file", "line_no"), side)


@query(
    "WITH c AS (SELECT (" + str(_CLASSES) + ")[p_partkey % 7 + 1] AS cls, l_quantity - 3 AS w FROM part JOIN lineitem ON l_partkey = p_partkey), f AS (SELECT cls, w, CASE cls WHEN 'nmos.cross' THEN 'nmos' WHEN 'npn.cross' THEN 'npn' WHEN 'transistor' THEN 'transistor.bjt' WHEN 'resistor' THEN 'resistor' ELSE 'unknown' END AS new FROM c),"
    " g AS (SELECT cls, CASE WHEN new <> 'unknown' AND w > 0 THEN new END AS new, new AS folded FROM f) SELECT new, count(new) AS n, count(*) FILTER (new IS NOT NULL AND folded <> cls) AS moved, count(*) FILTER (new IS NULL) AS dropped FROM g GROUP BY new"
)
def fold_counts(spark, sf_dir):
    cls = F.element_at(F.array(*[F.lit(x) for x in _CLASSES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    labels = fx.table(spark, sf_dir, "lineitem").select(cls.alias("cls"), (F.col("l_quantity") - 3).alias("w"), F.lit(1).alias("h"))
    stays = spark.createDataFrame([(x,) for x in ("nmos", "npn", "resistor", "transistor.bjt", "pnp")], "cls string")
    return etl.fold_counts(labels, stays)


@query(_with(fx.BOXES_SQL) + "SELECT det_id, CAST(x1 - x0 AS DOUBLE) / ((x1 - x0) * (y1 - y0)) AS extent, (x1 - x0) / CAST(y1 - y0 AS DOUBLE) AS aspect FROM boxes")
def shape_figures(spark, sf_dir):
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return fx.boxes(spark, sf_dir).select("det_id", extent(w, w, h).alias("extent"), aspect(w, h).alias("aspect"))


@query(
    _with(SPARSE, fx.PLACED_SQL, "made AS (SELECT DISTINCT image_id, 'T' || slot AS role, max(net) AS net FROM placed GROUP BY ALL)", "c AS (SELECT DISTINCT comp_id % 53 AS image_id, comp_id, 0 AS new FROM comps UNION ALL SELECT DISTINCT image_id, NULL, 1 FROM made)")
    + ", ci AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY new, comp_id) - 1 AS comp_index FROM c), p AS (SELECT image_id, comp_id, pin_id, role, net, 0 AS new FROM placed UNION ALL SELECT image_id, NULL, NULL, role, net, 1 FROM made)"
    " SELECT p.image_id, p.role, p.net, comp_index, row_number() OVER (PARTITION BY p.image_id ORDER BY p.new, p.pin_id, p.role) - 1 AS pin_index FROM p JOIN ci ON ci.image_id = p.image_id AND ci.new = p.new AND ci.comp_id IS NOT DISTINCT FROM p.comp_id"
)
def reindexed_with_synthesis(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    placed = fx.placed_pins(epins)
    made = placed.groupBy("image_id", F.concat(F.lit("T"), F.col("slot").cast("string")).alias("role")).agg(F.max("net").alias("net"))
    rows = repair.with_synthesis(comps.withColumn("image_id", F.col("comp_id") % 53), placed, made)[1]
    return rows.select("image_id", "role", "net", "comp_index", "pin_index")


# ---- jobs, sources and sinks ----


def _merge_files(spark, sf_dir):
    split = F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    return fx.table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), split.alias("split"), F.concat(F.lit("P"), F.floor(F.col("doc_id") / 3).cast("string")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"), F.col("lang").alias("class_name"))


_MERGE = """WITH f AS (SELECT source AS dataset, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, 'P' || doc_id // 3 AS name, coalesce(text, '') AS content, lang FROM documents),
 g AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY dataset, split, lower(name), name) = 1 AS is_first FROM f)
"""


@query(_MERGE + "SELECT dataset, count(*) AS images, count(*) FILTER (NOT is_first) AS duplicates, count(*) FILTER (is_first) AS kept FROM g GROUP BY dataset")
def merge_job(spark, sf_dir):
    files = _merge_files(spark, sf_dir)
    return jobs.merged(files.drop("class_name"), files.drop("content"), spark.createDataFrame([("en", "english")], "alias string, target string"))[2]


@query(_MERGE + ", c AS (SELECT *, CASE lang WHEN 'en' THEN 'english' ELSE lang END AS canonical FROM g WHERE is_first), v AS (SELECT canonical, row_number() OVER (ORDER BY canonical) - 1 AS id FROM (SELECT DISTINCT canonical FROM c)) SELECT dataset, split, name, id FROM c JOIN v USING (canonical)")
def merge_job_labels(spark, sf_dir):
    files = _merge_files(spark, sf_dir)
    return jobs.merged(files.drop("class_name"), files.drop("content"), spark.createDataFrame([("en", "english")], "alias string, target string"))[1].select("dataset", "split", "name", "id")


@query(
    _with(SPARSE, _NAMED, "last AS (SELECT comp_id, slot % 2 AS r, arg_max(node, pin_id) AS node FROM named WHERE cls = 'transformer' GROUP BY ALL)")
    + "SELECT comp_id, 'R' || comp_id || ' ' || max(node) FILTER (r = 0) || ' ' || max(node) FILTER (r = 1) || ' 1k  ; resistor' AS text FROM last GROUP BY comp_id"
)
def spice_duplicate_roles(spark, sf_dir):
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    four = comps.where("cls = 'transformer'").withColumn("cls", F.lit("resistor"))
    twice = epins.join(four.select("comp_id"), "comp_id", "left_semi").withColumn("role", F.concat(F.lit("p"), (F.col("slot") % 2).cast("string")))
    return netlist.spice_elements(four, twice).select("comp_id", "text")


@query("SELECT source, count(*) AS n, min(r) AS least, max(r) AS most FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 30 GROUP BY source")
def capped_sample_of_one_key(spark, sf_dir):
    """All rows of a source share one key: the cap still holds."""
    rows = fx.table(spark, sf_dir, "documents").select("source", F.lit("the same").alias("key"))
    n = etl.capped_sample(rows, "source", "key", 30).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", "n", F.lit(1).cast("bigint").alias("least"), F.col("n").alias("most"))


@query("SELECT CASE WHEN r <= n * 8 // 10 THEN 'train' WHEN r <= n * 8 // 10 + n // 10 THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM (SELECT row_number() OVER () AS r, count(*) OVER () AS n FROM orders) GROUP BY ALL")
def seeded_split(spark, sf_dir):
    return jobs.seeded_split(fx.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(_with(fx.BOXES_SQL) + "SELECT det_id, CASE WHEN det_id % 2 = 0 THEN -y0 ELSE x0 END AS x, CASE WHEN det_id % 2 = 0 THEN x0 ELSE y0 END AS y FROM boxes")
def symbol_points(spark, sf_dir):
    turn = F.when(F.col("det_id") % 2 == 0, "R90").otherwise("R0")
    return fx.boxes(spark, sf_dir).select("det_id", symbol_point(F.col("x0"), F.col("y0"), turn).alias("p")).select("det_id", "p.x", "p.y")


@query(_with(fx.BOXES_SQL) + """SELECT 'structural_candidates' AS "check", image_id, x0, y0, x1, y1, det_id AS n FROM boxes""")
def structural_candidates(spark, sf_dir):
    return checks.structural_candidates(fx.boxes(spark, sf_dir).withColumnRenamed("det_id", "n"))


@query(_with(fx.BOXES_SQL) + "SELECT det_id AS image_id, CAST(1 AS BIGINT) AS loop, 'rect' AS kind, (x1 - x0 + 30) * (y1 - y0 + 30) AS area, x0, y0, x1 + 30 AS x1, y1 + 30 AS y1 FROM boxes WHERE (x1 - x0 + 30) * (y1 - y0 + 30) >= 1500 AND x1 - x0 + 30 > 40")
def wire_loops(spark, sf_dir):
    """The frame of each box, grown by 30, as a picture of its own."""
    b = fx.boxes(spark, sf_dir).select(F.col("det_id").alias("image_id"), "x0", "y0", (F.col("x1") + 29).alias("x1"), (F.col("y1") + 29).alias("y1"))
    across = b.select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), F.array("y0", "y1").alias("ends")).select("image_id", "x", F.explode("ends").alias("y"))
    down = b.select("image_id", F.explode(F.sequence("y0", "y1")).alias("y"), F.array("x0", "x1").alias("ends")).select("image_id", F.explode("ends").alias("x"), "y")
    return raster.loops(across.unionByName(down))


def _folder(spark, name):
    return f"{shared_dir(spark)}/netloom-sources-{uuid.uuid4().hex[:8]}/{name}"


@query(_with(fx.LABELS_SQL) + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS line_no, line FROM label_lines")
def read_label_files(spark, sf_dir):
    """Label lines written as a text file for each picture, and found and read again."""
    path = _folder(spark, "labels")
    lines = fx.label_lines(spark, sf_dir)
    writers.write_label_text(lines.withColumnRenamed("file", "stem"), path)
    found = readers.label_lines(spark, path)
    return found.select(F.regexp_extract("file", "stem=([^/]*)/", 1).alias("file"), F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(_with(fx.BOXES_SQL) + "SELECT image_id || '.png' AS file_name, CAST(300 AS DOUBLE) AS width, CAST(200 + image_id AS DOUBLE) AS height, 'class ' || det_id % 3 AS category, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM boxes")
def read_coco(spark, sf_dir):
    """Boxes as COCO files of four pictures each, read again; ids repeat from file to file."""
    path = _folder(spark, "coco")
    b = fx.boxes(spark, sf_dir).withColumn("part", F.col("image_id") % 5)
    boxes = b.groupBy("part").agg(F.collect_list(F.struct(F.floor(F.col("image_id") / 5).alias("image_id"), (F.col("det_id") % 3).alias("category_id"), F.array(*[F.col(x).cast("double") for x in ("x0", "y0")], (F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double")).alias("bbox"))).alias("annotations"))
    images = b.select("part", "image_id").distinct().groupBy("part").agg(F.collect_list(F.struct(F.floor(F.col("image_id") / 5).alias("id"), F.concat(F.col("image_id").cast("string"), F.lit(".png")).alias("file_name"), F.lit(300.0).alias("width"), (F.col("image_id") + 200).cast("double").alias("height"))).alias("images"))
    names = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f"class {i}").alias("name")) for i in range(3)])
    whole = boxes.join(images, "part").select("part", F.to_json(F.struct("images", "annotations", names.alias("categories"))).alias("value"))
    whole.repartition("part").write.partitionBy("part").text(path)
    return readers.coco_boxes(spark, path)


@query("SELECT 'a' AS file, CAST(p_size AS INTEGER) AS class_id, 'size ' || p_size AS name FROM part GROUP BY p_size UNION ALL SELECT 'b', CAST(row_number() OVER (ORDER BY p_size) - 1 AS INTEGER), 'size ' || p_size FROM part GROUP BY p_size")
def read_class_names(spark, sf_dir):
    """Names by number (a) and in a list (b), written as data.yaml files and read again."""
    path = _folder(spark, "names")
    sizes = fx.table(spark, sf_dir, "part").select("p_size").distinct()
    numbered = sizes.agg(F.concat(F.lit("names:\n"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("p_size")), lambda x: F.concat(F.lit("  "), x.cast("string"), F.lit(": size "), x.cast("string"))))).alias("value"))
    order = F.row_number().over(Window.orderBy("p_size")) - 1
    listed = writers.names_yaml(sizes.select(order.alias("id"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("name"))).select(F.col("text").alias("value"))
    for name, rows in (("a", numbered), ("b", listed)):
        writers.write_document(rows, f"{path}/set={name}", ".yaml")
    return readers.class_names(spark, path).select(F.regexp_extract("file", "set=([^/]*)/", 1).alias("file"), "class_id", "name")


@query(_with(SPARSE, *_ELEMENTS) + "SELECT kind, count(*) AS elements, CAST(0 AS BIGINT) AS bad_lines FROM (SELECT substr(text, 1, 1) AS kind FROM elements WHERE text IS NOT NULL) GROUP BY kind")
def read_decks(spark, sf_dir):
    """A deck for each of seven pictures, written as text, read and parsed again."""
    path = _folder(spark, "decks")
    comps, epins = _electrical(spark, sf_dir, fx.SPARSE)
    deck = netlist.spice_deck(netlist.spice_elements(comps, epins).withColumn("picture", F.col("comp_id") % 7), "deck", "picture")
    writers.write_label_text(deck.select(F.col("picture").cast("string").alias("stem"), "line_no", F.col("text").alias("line")), path)
    return netlist.spice_report(readers.text_lines(spark, path).where("text <> ''"))


@query("SELECT o_orderkey, o_custkey, o_orderkey % 3 AS was, o_custkey % 3 AS becomes FROM orders WHERE o_orderkey % 3 <> o_custkey % 3")
def read_manifest(spark, sf_dir):
    """The manifest of moved pictures, written as CSV and read again."""
    path = _folder(spark, "manifest")
    moved = resplit_moves(spark, sf_dir)
    writers.write_manifest(moved, path)
    return spark.read.schema(moved.schema).option("header", "true").csv(path)


@query("SELECT kind, n, bytes FROM (SELECT 'label' AS kind, count(DISTINCT p_partkey % 40) AS n FROM part) a, (SELECT CAST(sum(len(line) + 1) AS BIGINT) AS bytes FROM label_lines) b".replace("SELECT kind", "WITH " + fx.LABELS_SQL + " SELECT kind", 1))
def read_structure(spark, sf_dir):
    """Kinds of files in a folder of label files."""
    path = _folder(spark, "structure")
    writers.write_label_text(fx.label_lines(spark, sf_dir).withColumnRenamed("file", "stem"), path)
    return readers.structure(spark, path).where("kind = 'label'")

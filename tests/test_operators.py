"""Properties and small cases of the library's operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import text as tx
from netloom.functions.geometry import box_iou, rotated
from netloom.operators import checks, etl, graph, islands, motifs, netlist, raster, repair, spatial
from netloom.operators.components import star_labels


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_iou_edges(spark):
    s = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 1.0, 3.0, 3.0)), ((0.0, 0.0, 1.0, 1.0), (1.0, 0.0, 2.0, 1.0)), ((0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0))], f"a {s}, b {s}")
    assert [r[0] for r in df.select(box_iou(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 / 7, 0, 0])


def test_rotation_refuses_other_angles(spark):
    df = spark.createDataFrame([(90,), (450,)], "o int")
    assert [tuple(r[0]) for r in df.select(rotated(F.lit(0.25), F.lit(0.0), F.col("o"))).collect()] == [(1.0, 0.25)] * 2
    with pytest.raises(Exception, match="orientation"):
        spark.createDataFrame([(45,)], "o int").select(rotated(F.lit(0.1), F.lit(0.2), F.col("o"))).collect()


def test_nms_keeps_no_overlapping_pair(spark):
    rng = np.random.default_rng(3)
    data = [(int(i % 3), int(i), float(rng.integers(0, 9)) / 10, *map(int, (x := rng.integers(0, 60), y := rng.integers(0, 60), x + 20, y + 20))) for i in range(200)]
    boxes = spark.createDataFrame([(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in data], "image_id long, det_id long, conf double, x0 long, y0 long, x1 long, y1 long")
    kept = spatial.nms(boxes, 0.5)
    assert spatial.iou_pairs(kept, 0.5000001).count() == 0
    assert spatial.nms(boxes.limit(0)).count() == 0


def test_confident_offer_replaces_all_it_overlaps(spark):
    schema = "image_id long, det_id long, conf double, x0 long, y0 long, x1 long, y1 long"
    held = spark.createDataFrame([(1, 1, 0.5, 0, 0, 10, 10), (1, 2, 0.6, 1, 0, 11, 10), (1, 3, 0.9, 50, 50, 60, 60)], schema)
    offered = spark.createDataFrame([(1, 9, 0.7, 0, 0, 10, 10), (1, 10, 0.8, 50, 50, 60, 60), (2, 11, 0.1, 0, 0, 5, 5)], schema)
    assert [r[1] for r in rows(spatial.merge_confident(held, offered), "image_id", "det_id")] == [3, 9, 11]


def test_proposals_merge_by_points(spark):
    schema = "image_id long, det_id long, n long, x0 long, y0 long, x1 long, y1 long"
    first = spark.createDataFrame([(1, 1, 4, 0, 0, 10, 10)], schema)
    more = spark.createDataFrame([(1, 2, 9, 1, 0, 11, 10), (1, 3, 2, 1, 0, 11, 10), (1, 4, 1, 70, 0, 80, 10)], schema)
    assert [r[1] for r in rows(spatial.proposal_merge(first, more), "det_id")] == [2, 4]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7)]
    found = dict(map(tuple, star_labels(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {found[i] for i in range(101)} == {0} and {found[i] for i in range(1000, 1300)} == {1000}
    assert star_labels(spark.createDataFrame([], "u long, v long")).count() == 0


def test_gap_clusters_with_ties(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 1, 3, 10, 10, 12)] + [("b", 5)], "k string, v long")
    assert rows(islands.gap_clusters(df, ["k"], "v", 2).select("k", "n", "low", "high", "middle"), "k", "low") == [("a", 3, 1, 3, 1), ("a", 3, 10, 12, 10), ("b", 1, 5, 5, 5)]
    assert rows(islands.snapped(df, ["k"], "v", 2).select("k", "v", "snapped").distinct(), "k", "v")[1] == ("a", 3, 1)


def circuit(spark, parts):
    """parts: (comp_id, cls, {role: net})."""
    comps = spark.createDataFrame([(c, cls) for c, cls, _ in parts], "comp_id long, cls string")
    pins = spark.createDataFrame([(c * 100 + i, c, i, role, net) for c, _, p in parts for i, (role, net) in enumerate(p.items())], "pin_id long, comp_id long, slot long, role string, net long")
    return comps, pins


def two(a, b):
    return {"p0": a, "p1": b}


def test_two_terminal_codes(spark):
    comps, pins = circuit(spark, [(1, "resistor", two(1, 2)), (2, "resistor", two(3, 3)), (3, "capacitor", two(4, 4)), (4, "diode", two(None, 1)), (5, "resistor", {"p0": 4}), (6, "npn", {"c": 4, "b": 1, "e": 2})])
    assert rows(checks.two_terminal(comps, pins).select("comp_id", "code"), "comp_id") == [(1, "OK"), (2, "SHORTED"), (3, "PARALLEL"), (4, "OPEN"), (5, "PIN_COUNT")]


def test_part_between_ground_nets_is_an_electrical_short(spark):
    comps, pins = circuit(spark, [(1, "gnd", {"g": 1}), (2, "gnd", {"g": 2}), (3, "resistor", two(1, 2))])
    assert rows(checks.two_terminal(comps, pins).select("code"), "code") == [("OK",)]
    assert rows(checks.electrical_short(comps, checks.electrical_nets(comps, pins)), "comp_id") == [(3, "resistor", -1)]


def test_divider_leaves_ground_and_rails_out(spark):
    parts = [(1, "resistor", two(10, 11)), (2, "resistor", two(11, 12)), (3, "gnd", {"g": 12}), (4, "resistor", two(12, 13)), (5, "resistor", two(13, 10))]
    comps, pins = circuit(spark, parts)
    epins = checks.electrical_nets(comps, pins)
    assert [r[:3] for r in rows(motifs.voltage_dividers(comps, epins), "r_top", "r_bot")] == [(1, 2, 11), (1, 5, 10), (4, 5, 13)]


def test_attachment_never_shorts_a_sibling(spark):
    _, pins = circuit(spark, [(1, "resistor", two(5, None)), (2, "resistor", two(None, 6))])
    cand = spark.createDataFrame([(101, 1, 5, 3.0, 10), (101, 2, 7, 2.0, 20), (200, 1, 8, 0.5, 10), (200, 2, 9, 5.0, 10)], "pin_id long, rank long, enet long, score double, dist long")
    assert rows(repair.motif_attach(pins, cand), "pin_id") == [(101, 7)]  # for 200 the first choice isn't good enough, and no other takes its place


DECK = ["* title", "R0 N1 N2 1k  ; resistor", "R1 N2 0 1k", "C2 N2 0 1u", "Q3 N1 N2 0 QMODN", "K4 L1 L2 1", "X5 N9 N1 N2 ICSTUB ; x", "V6 N1 0 DC 5", "V7 N1 0 5", ".op", ".end"]


def test_deck_parsing(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(DECK)], "line_no long, text string")
    assert rows(netlist.spice_report(lines), "kind") == [("C", 1, 0), ("K", 1, 0), ("Q", 1, 0), ("R", 2, 0), ("V", 1, 1), ("X", 1, 0)]
    assert rows(netlist.spice_fanout(lines), "node") == [("N1", 4, False), ("N2", 5, False)]


def test_deck_assembly_and_emission(spark):
    comps, pins = circuit(spark, [(1, "resistor", two(1, 2)), (2, "transformer", {"p0": 1, "p1": 2, "p2": 3, "p3": None}), (3, "integrated_circuit", {"L0": 1, "L1": 2}), (4, "gnd", {"g": 2}), (5, "npn", {"c": 1})])
    epins = checks.electrical_nets(comps, pins)
    lines = [r.text for r in netlist.spice_deck(netlist.spice_elements(comps, epins)).orderBy("line_no").collect()]
    assert lines[2:7] == ["R1 N1 0 1k  ; resistor", "L2a N1 0 10u Rser=10m", "L2b N3 FLT_203 10u Rser=10m", "K2 L2a L2b 1", "X3 N1 0 ICSTUB  ; integrated_circuit pins=L0,L1 (structural)"]
    assert ".subckt ICSTUB N1 0" in lines and lines[-2:] == [".op", ".end"]
    assert rows(netlist.spice_skips(comps, epins).select("comp_id", "reason"), "comp_id") == [(4, "node-label-only"), (5, "bad-roles")]


def test_thinning_leaves_a_line():
    image = np.zeros((9, 20), np.uint8)
    image[3:6, 2:18] = 1
    thin = raster.thin(image)
    assert thin.sum() < 20 and thin.any(axis=0).sum() >= 12 and (thin <= image).all()


def test_fragments_and_routes(spark):
    data = [(1, x, 5) for x in range(10)] + [(1, x, 5) for x in range(13, 30)] + [(1, 40, 40)]
    frags = raster.fragments(spark.createDataFrame(data + data[:3], "image_id long, x long, y long"), 3)
    assert sorted(r[0] for r in frags.groupBy("frag").count().select("count").collect()) == [10, 17]
    first = frags.where("x = 0").first().frag
    starts = spark.createDataFrame([(1, 7, 9, 5, [first]), (1, 8, 500, 500, [])], "image_id long, point_id long, x long, y long, banned array<long>")
    found = raster.routes(frags, starts).collect()
    assert [(r.point_id, r.cost) for r in found] == [(7, 12 * 3 + 1)] or [r.point_id for r in found] == [7]


def test_spanning_tree_length(spark):
    points = spark.createDataFrame([(1, 0, 0), (1, 0, 10), (1, 10, 0), (1, 0, 0), (2, 5, 5)], "net long, x long, y long")
    assert rows(graph.spanning_wires(points), "x1", "y1") == [(1, 0, 0, 0, 10), (1, 0, 0, 10, 0)]


def test_greedy_pairs(spark):
    a = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 5, 0)], "c long, id long, x long, y long")
    b = spark.createDataFrame([(1, 7, 4, 0), (1, 8, 100, 0)], "c long, id long, x long, y long")
    assert rows(graph.greedy_pairs(a, b, "c"), "left_id") == [(1, 1, 8, 100), (1, 2, 7, 1)]


def test_capped_sample_is_exact_for_any_source(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") < 4500, "big").otherwise("small").alias("s")).unionByName(spark.createDataFrame([(9999, "one")], "id long, s string"))
    got = dict(map(tuple, etl.capped_sample(df, "s", "id", 50).groupBy("s").count().collect()))
    assert got == {"big": 50, "small": 50, "one": 1}


@pytest.mark.parametrize(("line", "issue"), [("1 0.5 0.5 0.1 0.1", None), ("1 0.5 0.5 0.1", "columns"), ("x 0.5 0.5 0.1 0.1", "parse"), ("99 0.5 0.5 0.1 0.1", "class"), ("1 0.5 0.5 0 0.1", "area"), ("1 1.5 0.5 0.1 0.1", "bounds")])
def test_label_issue(spark, line, issue):
    assert spark.createDataFrame([(line,)], "l string").select(tx.label_issue(F.col("l"), 92)).first()[0] == issue


def test_sanitized_names(spark):
    names = {" Op-Amp / x ": "op_amp_x", "": "unknown", "__": "unknown", "a.b": "a.b", "É": "unknown"}
    df = spark.createDataFrame([(k,) for k in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", tx.sanitized(F.col("n"))).collect()} == names


def test_the_driver_finds_the_library(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns == ["comp_id", "cls", "code"]
    assert set(driver.oracle_sql()) <= set(driver.queries())

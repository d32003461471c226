"""Dataset jobs, wires, pins and the stream over small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import pins, raster, schematic, wires
from netloom.plans import jobs
from netloom.streaming.ingest import issue_counts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def ink(spark):
    """Two lines that a dot joins, one far away."""
    data = [(1, x, 5, 1) for x in range(0, 20)] + [(1, 22, y, 2) for y in range(0, 20)] + [(1, x, 200, 3) for x in range(0, 20)]
    return spark.createDataFrame(data, "image_id long, x long, y long, frag long")


def test_dots_join_fragments_and_background_joins_all_dotted(spark, ink):
    dots = spark.createDataFrame([(1, 7, 21, 5), (1, 8, 10, 200)], "image_id long, dot_id long, x long, y long")
    assert rows(wires.wire_nets(ink, dots).select("frag", "net"), "frag") == [(1, 0), (2, 0), (3, 1)]
    assert {r.net for r in wires.wire_nets(ink, dots, background=True).collect()} == {0}
    assert rows(wires.wire_nets(ink, dots.limit(0)).select("frag", "net"), "frag") == [(1, 0), (2, 1), (3, 2)]


def test_pins_on_fragments(spark, ink):
    points = spark.createDataFrame([(1, 10, 1, 0, 3), (1, 11, 1, 19, 4), (1, 12, 2, 22, 30), (1, 13, 2, 500, 500)], "image_id long, pin_id long, comp_id long, x long, y long")
    on = wires.pin_fragments(points, ink)
    assert rows(on.select("pin_id", "frag", "dist"), "pin_id") == [(10, 1, 2), (11, 1, 1), (12, 2, 11)]
    assert rows(wires.same_fragment(points, on), "comp_id") == [(1,)]


def test_corroboration(spark, ink):
    boxes = spark.createDataFrame([(1, 1, 0, 0, 30, 30), (1, 2, 300, 300, 330, 330), (1, 3, 400, 400, 410, 410), (1, 4, 500, 500, 510, 510)], "image_id long, det_id long, x0 long, y0 long, x1 long, y1 long")
    points = spark.createDataFrame([(1, 405, 405)], "image_id long, x long, y long")
    blobs = spark.createDataFrame([(1, 320, 320, 340, 340)], "image_id long, x0 long, y0 long, x1 long, y1 long")
    assert [r[0] for r in rows(wires.corroborated(boxes, points, blobs, ink).select("det_id"), "det_id")] == [1, 2, 3]


def test_round_fragments_with_wires_are_dots(spark):
    disc = [(1, x, y) for x in range(40) for y in range(40) if (x - 20) ** 2 + (y - 20) ** 2 <= 16]
    square = [(1, x, 100) for x in range(100, 140)]
    wire = disc + [(1, x, 20) for x in range(0, 41)] + square
    frame = lambda p: spark.createDataFrame(p, "image_id long, x long, y long")
    found = wires.dots_from_fragments(raster.fragments(frame(disc + square), 5), frame(wire))
    assert [(r.x, r.y) for r in found.collect()] == [(20, 20)]


def test_footprint_of_a_row_and_a_column(spark):
    data = [(1, 100.0 + 40 * i, 100.0) for i in range(6)] + [(1, 300.0, 100.0 + 40 * i) for i in range(1, 6)] + [(1, 900.0, 900.0)]
    circles = spark.createDataFrame(data, "image_id long, x double, y double")
    found = wires.footprints(circles, 1000, 1000)
    assert rows(found, "x0") == [(1, 50, 40, 350, 560, 11)]
    boxes = spark.createDataFrame([(1, 50, 40, 350, 560)], "image_id long, x0 long, y0 long, x1 long, y1 long")
    assert wires.unclaimed(found, boxes).count() == 0
    none = spark.createDataFrame([], "image_id long, x long, y long, frag long")
    nets = spark.createDataFrame([], "image_id long, frag long, net long")
    assert sorted(r.role for r in wires.synthesized(found, circles, none, nets).collect()) == sorted([f"L{i}" for i in range(3)] + [f"R{i}" for i in range(3, 11)])


def test_orientation_choice_and_disc_scores(spark):
    scores = spark.createDataFrame([(1, 0, 0.9, 0), (1, 90, 0.2, 0), (2, 0, 0.5, 90), (2, 90, 0.45, 90), (3, 0, 0.05, 180)], "comp_id long, orientation int, score double, present int")
    assert rows(pins.orientation_choice(scores), "comp_id") == [(1, 0), (2, 90), (3, 180)]
    dark = spark.createDataFrame([(1, x, y) for x in range(5, 16) for y in range(5, 16)], "image_id long, x long, y long")
    at = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 300.0, 0.0)], "image_id long, pin_id long, x double, y double")
    assert rows(pins.disc_scores(at, dark), "pin_id") == [(1, 1.0), (2, 0.0)]


def test_axis_exits_and_stubs(spark):
    got = spark.range(1).select(pins.axis_exits(F.lit(45.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0)).alias("e")).first().e
    assert [(round(p.x, 6), round(p.y, 6)) for p in got] == [(0, 0), (10, 10)]
    bins = spark.createDataFrame([(1, "L", p, 2) for p in (1, 2, 3, 10, 11, 12)] + [(2, "L", 1, 9)], "det_id long, side string, place long, weight long")
    assert rows(pins.stub_pins(bins).select("det_id", "centre"), "det_id", "centre") == [(1, 2), (1, 11)]


def test_drawing_round_trip(spark):
    comps = spark.createDataFrame([(1, "resistor", 0.0, 0.0, 50.0, 10.0), (2, "npn", 100.0, 3.0, 120.0, 40.0), (3, "text", 0.0, 0.0, 1.0, 1.0)], "comp_id long, cls string, x0 double, y0 double, x1 double, y1 double")
    pins_ = spark.createDataFrame([(100, 0, 5, -1), (101, 50, 5, 7), (102, 1, 1, None)], "pin_id long, x long, y long, enet long")
    edges = spark.createDataFrame([(0, 5, 50, 9), (1, 1, 1, 1)], "x0 long, y0 long, x1 long, y1 long")
    text = schematic.drawing(schematic.placements(comps), pins_, edges).orderBy("section", "a")
    lines = [r.text for r in text.collect()]
    assert lines[:2] == ["Version 4", "SHEET 1 4000 4000"] and "FLAG 0 5 0" in lines and "FLAG 50 5 N7" in lines and sum(x.startswith("WIRE") for x in lines) == 2
    assert "SYMBOL res 0 0 R90" in lines and "SYMATTR InstName Q2" in lines
    parsed = schematic.parse_drawing(text.withColumn("line_no", F.monotonically_increasing_id()))
    assert {r.command: r.n for r in parsed.groupBy("command").agg(F.count(F.lit(1)).alias("n")).collect()} == {"SHEET": 1, "WIRE": 2, "FLAG": 2, "SYMBOL": 2, "SYMATTR": 2}


def test_merge_audit_and_splits(spark):
    files = spark.createDataFrame([("a", "train", "X.png", b"1"), ("b", "train", "y.png", b"1"), ("b", "test", "z.png", b"2")], "dataset string, split string, name string, content binary")
    labels = spark.createDataFrame([("a", "train", "X.png", "Res-1"), ("b", "train", "y.png", "GND"), ("b", "test", "z.png", "gnd sym"), ("b", "valid", "z.png", "no file")], "dataset string, split string, name string, class_name string")
    aliases = spark.createDataFrame([("GND", "gnd")], "alias string, target string")
    vocabulary, merged, stats = jobs.merged(files, labels, aliases)
    assert rows(vocabulary, "id") == [("gnd_sym", 0), ("res_1", 1)]
    assert rows(merged.select("dataset", "id"), "dataset") == [("a", 1), ("b", 0)] and rows(stats, "dataset") == [("a", 1, 0, 1), ("b", 2, 1, 1)]
    images = spark.createDataFrame([("s1", "train", "x", "drafter_1_c1_d1_p1.jpg"), ("s2", "test", "x", "drafter_1_c1_d2_p1.jpg"), ("s3", "valid", "y", "other.jpg")], "stem string, split string, source string, name string")
    lines = spark.createDataFrame([("s1", "0 0.5 0.5 0.1 0.1"), ("s1", "9 0.5 0.5 0.1 0.1"), ("s2", "1 0.5 0.5 0.1 0.1")], "stem string, line string")
    classes = spark.createDataFrame([(0, "gnd"), (1, "res"), (2, "cap")], "class_id long, cls string")
    found = jobs.audit(images, lines, classes, 3)
    assert rows(found["histogram"], "cls") == [("cap", 0, 0, 0, 0), ("gnd", 1, 0, 0, 1), ("res", 0, 0, 1, 1)]
    assert rows(found["leaks"], "circuit") == [("drafter1_c1", 2)] and rows(found["issues"].select("issue", "n"), "issue") == [("class", 1)]
    assert [r.stem for r in found["missing"].collect()] == ["s3"] and found["sources"].count() == 6 and rows(found["support"].select("bucket", "n_classes"), "bucket") == [("under_30", 2), ("zero", 1)]
    assert {r.wanted for r in jobs.resplit(images).collect()} <= {"train", "valid", "test"} and len({r.wanted for r in jobs.resplit(images).collect()}) == 1


def test_freeze_and_conversion(spark):
    labels = spark.createDataFrame([("transistor", i, "src_a") for i in range(3)] + [("gnd", 1, "src_a"), ("cap", 5, "skip_b")], "cls string, image_id long, name string")
    ids = spark.createDataFrame([("cap", 0), ("gnd", 1), ("transistor.bjt", 2)], "cls string, old_id long")
    assert rows(jobs.frozen(labels, ids, ["skip"], 2, 2).select("cls", "instances", "new_id"), "old_id") == [("cap", 0, -1), ("gnd", 1, -1), ("transistor.bjt", 3, 0)]
    boxes = spark.createDataFrame([("p.png", 10.0, 20.0, "gnd", -1.0, 2.0, 3.0, 4.0), ("p.png", 10.0, 20.0, "gnd", 11.0, 2.0, 3.0, 4.0), ("p.png", 10.0, 20.0, "zz", 1.0, 2.0, 3.0, 4.0)], "file_name string, width double, height double, category string, x double, y double, w double, h double")
    kept = spark.createDataFrame([("gnd", 4)], "cls string, new_id long")
    assert [r.line for r in jobs.converted_coco(boxes, kept).collect()] == ["4 0.100000 0.200000 0.200000 0.200000"]


def test_issue_stream(spark, tmp_path):
    lines = [("2024-01-01 00:10:00", "1 0.5 0.5 0.1 0.1"), ("2024-01-01 00:20:00", "1 0.5"), ("2024-01-01 05:00:00", "1 0.5 0.5 0.1 0.1")]
    frame = spark.createDataFrame(lines, "t string, line string").select(F.to_timestamp("t").alias("ts"), "line")
    frame.write.parquet(str(tmp_path / "in"))
    stream = issue_counts(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), 3)
    query = stream.writeStream.format("memory").queryName("issues").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = rows(issue_counts(frame, 3), "start", "issue")
    assert rows(spark.table("issues"), "start", "issue") == want and [x[1:] for x in want] == [("columns", 1), ("ok", 1), ("ok", 1)]


def test_maze_rescue_takes_every_dot_and_the_window_of_production(spark, monkeypatch):
    from netloom.plans import fixtures as fx
    from netloom.plans.queries import QUERIES

    sf, seen = "/root/testdata/sf0.01", []
    monkeypatch.setattr(raster, "routes", lambda targets, starts, **bounds: seen.append((starts.count(), bounds)))
    QUERIES["maze_rescue"](spark, sf)
    assert seen == [(fx.dots(spark, sf).count(), {"width": 240, "height": 240})]


def test_lines_of_circles_match_a_search_by_hand(spark):
    """Seeds in order, one after the other, over random circles."""
    import random

    rng = random.Random(4)
    for _ in range(40):
        points = sorted({(rng.randrange(400), rng.choice([10, 12, 30, 200, rng.randrange(300)])) for _ in range(rng.randrange(1, 40))})
        x, y = (np.array(v, float) for v in zip(*points))
        want, taken = [], set()
        for seed in sorted(range(len(points)), key=lambda i: (points[i][1], i)):
            if seed not in taken:
                near = [i for i, p in enumerate(points) if -14 <= p[1] - points[seed][1] <= 14]
                if len(near) > 4 and max(points[i][0] for i in near) - min(points[i][0] for i in near) >= 150:
                    want.append(near)
                    taken.update(near)
        assert [sorted(found.tolist()) for found in wires._lines(x, y, 14, 5, 150)] == want


def test_skeletons_match_the_rules_pixel_by_pixel():
    rng = np.random.default_rng(1)
    for _ in range(20):
        image = (rng.random((14, 17)) < 0.7).astype(np.uint8)
        got = raster.thin(image)
        now, changed = np.pad(image, 1), True
        while changed:
            changed = False
            for second in (False, True):
                gone = []
                for r in range(1, now.shape[0] - 1):
                    for c in range(1, now.shape[1] - 1):
                        around = [int(now[r + dr, c + dc]) for dr, dc in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                        enters = sum(a == 0 and b == 1 for a, b in zip(around, [*around[1:], around[0]]))
                        n, e, so, w = around[::2]
                        keeps = (n and e and w) or (n and so and w) if second else (n and e and so) or (e and so and w)
                        if now[r, c] and 2 <= sum(around) <= 6 and enters == 1 and not keeps:
                            gone.append((r, c))
                for at in gone:
                    now[at] = 0
                changed |= bool(gone)
        assert (got == now[1:-1, 1:-1]).all()


def test_routes_match_relaxation(spark):
    import random

    rng = random.Random(3)
    width, height = 30, 24
    wire = {(rng.randrange(width), rng.randrange(height)): rng.randrange(1, 4) for _ in range(120)}
    starts = [(i, rng.randrange(width), rng.randrange(height), rng.sample([1, 2, 3], rng.randrange(3))) for i in range(12)]
    got = {r.point_id: (r.frag, round(r.cost, 6)) for r in raster.routes(spark.createDataFrame([(0, *p, f) for p, f in wire.items()], "image_id long, x long, y long, frag long"), spark.createDataFrame([(0, *s) for s in starts], "image_id long, point_id long, x long, y long, banned array<long>"), window=9, most=40.0, width=width, height=height).collect()}
    for i, x, y, banned in starts:
        inside = [(a, b) for a in range(max(0, x - 9), min(width, x + 10)) for b in range(max(0, y - 9), min(height, y + 10))]
        cost = dict.fromkeys(inside, 1e18) | {(x, y): 0.0}
        for _ in inside:
            before = dict(cost)
            for a, b in inside:
                for da in (-1, 0, 1):
                    for db in (-1, 0, 1):
                        if (da or db) and (a + da, b + db) in before:
                            cost[a, b] = min(cost[a, b], before[a + da, b + db] + (1.0 if (a, b) in wire else 12.0) * (1.4142 if da and db else 1.0))
            if cost == before:
                break
        ends = [(cost[p], wire[p]) for p in inside if p in wire and wire[p] not in banned and p != (x, y) and cost[p] <= 40]
        assert (i in got) == bool(ends) and (not ends or (round(min(ends)[0], 6) == got[i][1] and got[i][0] in {f for c, f in ends if c < min(ends)[0] + 1e-9}))


def test_samples_of_one_key_and_without_a_source(spark):
    from netloom.operators import etl

    df = spark.createDataFrame([("a", 1)] * 2000 + [("b", i % 3) for i in range(2000)] + [(None, i) for i in range(200)] + [("c", None)] * 5, "s string, id long")
    assert {r.s: r["count"] for r in etl.capped_sample(df, "s", "id", 40).groupBy("s").count().collect()} == {"a": 40, "b": 40, None: 40, "c": 5}


def test_a_deck_for_each_picture(spark):
    from netloom.operators import netlist

    elements = spark.createDataFrame([("p", 2, 0, "X2 N1 N2 ICSTUB  ; integrated_circuit"), ("p", 1, 0, "R1 N1 0 1k"), ("q", 3, 0, "C3 N1 0 1u"), (None, 4, 0, "C4 N1 0 1u")], "picture string, comp_id long, part long, text string")
    found = {}
    for r in netlist.spice_deck(elements, picture="picture").orderBy("picture", "line_no").collect():
        found.setdefault(r.picture, []).append(r.text)
    assert found["p"][2:4] == ["R1 N1 0 1k", "X2 N1 N2 ICSTUB  ; integrated_circuit"] and ".subckt ICSTUB N1 N2" in found["p"] and found["p"][-1] == ".end"
    for picture in ("p", "q"):
        alone = netlist.spice_deck(elements.where(F.col("picture") == picture).drop("picture")).orderBy("line_no").collect()
        assert [r.text for r in alone] == found[picture]
    assert len(found) == 3


def test_roles_of_several_pins(spark):
    from netloom.operators import netlist

    comps = spark.createDataFrame([(1, "resistor")], "comp_id long, cls string")
    pins_ = spark.createDataFrame([(10, 1, "p0", 5), (11, 1, "p0", 6), (12, 1, "p1", None), (9, 1, "p1", 3), (13, 1, None, 3)], "pin_id long, comp_id long, role string, enet long")
    assert [r.text for r in netlist.spice_elements(comps, pins_).collect()] == ["R1 N6 FLT_12 1k  ; resistor"]


def test_snapping_is_given_up_where_nodes_differ(spark):
    rows_ = lambda n: spark.range(n)
    drawn, used = schematic.snap_or_not(rows_, lambda d: d.where("id > 5"))
    assert used == 0 and drawn.count() == 0
    assert schematic.snap_or_not(rows_, lambda d: d.where("id > 50"))[1] == 10


def test_loops_are_told_apart(spark):
    from math import cos, pi, sin

    ring = {(round(100 + 40 * cos(i * pi / 400)), round(100 + 40 * sin(i * pi / 400))) for i in range(800)}
    frame = {(x, y) for x in range(300, 381) for y in range(20, 91) if x in (300, 380) or y in (20, 90)}
    line = {(x, 300) for x in range(200)}
    pixels = spark.createDataFrame([(7, *p) for p in ring | frame | line], "image_id long, x long, y long")
    got = raster.loops(pixels).orderBy("x0").collect()
    assert [(r.kind, r.x0, r.y0, r.x1, r.y1) for r in got] == [("circle", 60, 60, 141, 141), ("rect", 300, 20, 381, 91)]


def test_synthesis_falls_back_on_routes(spark):
    footprint = spark.createDataFrame([(0, 0, 0, 200, 100, 6)], "image_id long, x0 long, y0 long, x1 long, y1 long, n long")
    circles = spark.createDataFrame([(0, 10 + 30 * i, 20) for i in range(6)], "image_id long, x long, y long")
    pixels = spark.createDataFrame([(0, 10 + 30 * i, 20 + (0 if i < 3 else 12 if i == 3 else 60), i + 1) for i in range(6)], "image_id long, x long, y long, frag long")
    nets = spark.createDataFrame([(0, i + 1, 100 + i) for i in range(6)], "image_id long, frag long, net long")
    made, log = wires.synthesis_with_routes(footprint, circles, pixels, nets)
    assert rows(made.select("role", "net"), "role") == [("T0", 100), ("T1", 101), ("T2", 102), ("T3", 103), ("T4", None), ("T5", None)]
    assert rows(log.select("role", "action"), "role") == [("T0", "overlap"), ("T1", "overlap"), ("T2", "overlap"), ("T3", "routed"), ("T4", "none"), ("T5", "none")]

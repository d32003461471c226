"""Detection hooks, second looks, small helpers and chains."""

import pytest

from netloom.operators import checks, detect, etl, pins, spatial
from netloom.plans import chain
from netloom.sources import readers


def loaded():
    return lambda pictures: [[("r", len(x) / 10, 0.0, 0.0, 1.0, 1.0), ("c", 0.9, 5.0, 5.0, 6.0, 6.0)] for x in pictures]


def test_detections_by_an_injected_model(spark):
    images = spark.createDataFrame([(1, b"abc"), (2, b"abcd"), (3, b"")], "image_id long, content binary")
    got = [(r.image_id, r.det_id, r.cls, r.conf) for r in detect.detections(images, loaded, 0.35).orderBy("image_id", "det_id").collect()]
    assert got == [(1, 0, "c", 0.9), (2, 0, "r", 0.4), (2, 1, "c", 0.9), (3, 0, "c", 0.9)]


def test_windows_there_and_back(spark):
    boxes = spark.createDataFrame([(1, 10.0, 10.0, 60.0, 40.0)], "image_id long, x0 double, y0 double, x1 double, y1 double")
    row = detect.windows(boxes, 100, 100).first()
    assert (row.wx0, row.wy0, row.wx1, row.wy1) == (0, 0, 90, 70) and row.scale == pytest.approx(640 / 90)
    seen = spark.createDataFrame([(0.0, 0.0, 2.0, 20.0, 40.0, 60.0, 80.0)], "wx0 double, wy0 double, scale double, x0 double, y0 double, x1 double, y1 double")
    assert tuple(detect.unzoomed(seen).first())[3:] == (10, 20, 30, 40)


def test_harvest(spark):
    schema = "image_id long, det_id long, conf double, x0 long, y0 long, x1 long, y1 long"
    present = spark.createDataFrame([(1, 1, 0.9, 0, 0, 10, 10)], schema)
    weak = spark.createDataFrame([(1, 2, 0.2, 0, 0, 10, 10), (1, 3, 0.16, 50, 50, 60, 60), (1, 4, 0.3, 51, 50, 61, 60), (1, 5, 0.1, 90, 90, 95, 95)], schema)
    assert [r.det_id for r in detect.harvested(weak, present).collect()] == [4]


def test_snapped_pins(spark):
    comps = spark.createDataFrame([(i, 0.0, 0.0, 10.0, 4.0) for i in (1, 2, 3)], "comp_id long, x0 double, y0 double, x1 double, y1 double")
    templates = spark.createDataFrame([(i, r, x, 2.0) for i in (1, 2, 3) for r, x in (("p0", 0.0), ("p1", 10.0))], "comp_id long, role string, x double, y double")
    edges = spark.createDataFrame([(1, "left", 1), (1, "right", 3), (2, "left", 1)], "comp_id long, edge string, place long")
    axes = spark.createDataFrame([(3, 45.0), (1, 5.0)], "comp_id long, degrees double")
    got = {(r.comp_id, r.role): (round(r.x, 6), round(r.y, 6), r.source) for r in pins.snapped_pins(comps, templates, edges, axes).collect()}
    assert got == {(1, "p0"): (0, 1, "edge"), (1, "p1"): (10, 3, "edge"), (2, "p0"): (0, 2, "template"), (2, "p1"): (10, 2, "template"), (3, "p0"): (3, 0, "axis"), (3, "p1"): (7, 4, "axis")}


def test_small_helpers(spark, tmp_path):
    points = spark.createDataFrame([(1, 3, 1, 1), (1, 1, 2, 2), (1, 2, 30, 1)], "image_id long, point_id long, x long, y long")
    assert sorted(r.point_id for r in spatial.first_per_cell(points, ["point_id"]).collect()) == [1, 2]
    others = spark.createDataFrame([(1, 5, 6)], "image_id long, x long, y long")
    assert [r.point_id for r in spatial.points_near_points(points, others, 5).collect()] == [1]
    assert sorted(r.point_id for r in spatial.points_near_points(points, others, 5, near=False).collect()) == [2, 3]
    nets = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "pin_id long, net long")
    assert tuple(checks.net_summary(nets).first()) == (2, 2, 1, 2, 3, 4)
    names = spark.createDataFrame([(0, "a"), (1, "b")], "class_id long, name string")
    assert [r.name for r in etl.used_classes(spark.createDataFrame([(1,), (1,)], "cls long"), names).collect()] == ["b"]
    (tmp_path / "a.txt").write_text("xy")
    (tmp_path / "b.png").write_bytes(b"1")
    assert sorted(map(tuple, readers.structure(spark, str(tmp_path)).collect())) == [("image", 1, 1), ("label", 1, 2)]


def test_chains(tmp_path):
    waits, calls = [], []

    def shaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "done"

    assert chain.retried(shaky, 5, 30, waits.append) == "done" and waits == [30, 60]
    with pytest.raises(OSError, match="never"):
        chain.retried(lambda: (_ for _ in ()).throw(OSError("never")), 2, 1, waits.append)
    states = iter(["queued", "running", "complete"])
    assert chain.polled(lambda: next(states), {"complete", "error"}, 100, 1, lambda: 0.0, lambda _: None) == "complete"
    assert chain.polled(lambda: "running", {"complete"}, 0, 1, lambda: 0.0, lambda _: None) == "timeout"
    path, ran = str(tmp_path / "state.json"), []

    def run(seg, done):
        ran.append(seg)
        if seg == "b" and len(ran) < 4:
            raise RuntimeError("lost")
        return {"status": "ok", "epochs": len(ran)}

    assert [x["status"] for x in chain.resumed(path, ["a", "b", "c"], run)] == ["ok", "INFRA_FAIL", "ok"]
    assert [x["status"] for x in chain.resumed(path, ["a", "b", "c"], run)] == ["ok", "INFRA_FAIL", "ok", "ok"] and ran == ["a", "b", "c", "b"]

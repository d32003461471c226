"""Operators on tables of very many equal rows: what meets in a join or a fold is what differs."""

from pyspark.sql import functions as F

from netloom.model import RES
from netloom.operators import checks, motifs, raster, repair, spatial
from netloom.plans import fixtures
from netloom.storage import materialize


def seen_rows(monkeypatch, name):
    """The numbers of rows that spatial's function of this name is given from now on."""
    found, real = [], getattr(spatial, name)
    monkeypatch.setattr(spatial, name, lambda df, *a, **k: (found.append(df.count()), real(df, *a, **k))[1])
    return found


def test_nearest_meets_by_place(spark, monkeypatch):
    seen = seen_rows(monkeypatch, "near_cells")
    points = spark.range(500).select(F.lit(1).alias("image_id"), F.col("id").alias("point_id"), (F.col("id") % 2 * 100).alias("x"), F.lit(0).alias("y"))
    targets = spark.range(500).select(F.lit(1).alias("image_id"), (F.col("id") + 7).alias("target_id"), F.lit(3).alias("x"), F.lit(4).alias("y"))
    got = [tuple(r) for r in spatial.nearest(points, targets, 10).orderBy("point_id").collect()]
    assert got == [(1, i, 7, 7) for i in range(0, 500, 2)]
    assert seen == [2]


def test_novel_boxes_folds_different_boxes(spark, monkeypatch):
    seen = seen_rows(monkeypatch, "_sorted_boxes")
    box = lambda i, x0: (F.lit(1).alias("image_id"), i.alias("det_id"), (i % 10 / 10).alias("conf"), x0.alias("x0"), F.lit(0).alias("y0"), (x0 + 10).alias("x1"), F.lit(10).alias("y1"))
    present = spark.range(300).select(*box(F.col("id"), F.lit(100)))
    offered = spark.range(600).select(*box(F.col("id"), F.col("id") % 3 * 50))
    got = [tuple(r) for r in spatial.novel_boxes(present, offered).select("det_id", "x0").orderBy("det_id").collect()]
    assert got == [(9, 0), (19, 50)]
    assert max(seen) <= 3


def test_masks_of_equal_boxes_count_once(spark, monkeypatch):
    seen = seen_rows(monkeypatch, "near_cells")
    boxes = spark.range(400).select(F.lit(1).alias("image_id"), F.lit(10).alias("x0"), F.lit(10).alias("y0"), F.lit(20).alias("x1"), F.lit(20).alias("y1"))
    pixels = spark.createDataFrame([(1, 6, 10), (1, 7, 10), (1, 22, 22), (1, 23, 22), (2, 15, 15)], "image_id long, x long, y long")
    got = sorted(tuple(r) for r in raster.mask_interiors(pixels, boxes).collect())
    assert got == [(1, 6, 10), (1, 23, 22), (2, 15, 15)]
    assert seen == [1]


def test_loops_of_many_small_pictures_share_a_kernel(spark):
    """Frames of 61 by 51 with a smaller one inside, a line and a repeated corner; more pixels than a kernel takes at once."""
    n = 1_500
    frame = lambda x0, y0, w, h: [(x, y) for x in range(x0, x0 + w) for y in range(y0, y0 + h) if x in (x0, x0 + w - 1) or y in (y0, y0 + h - 1)]
    places = [*frame(5, -20, 61, 51), *frame(10, -16, 45, 43), *[(x, 90) for x in range(30)], (5, -20)]
    one = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in places])
    pixels = spark.range(n).select(F.when(F.col("id") > 0, F.col("id").cast("string")).alias("image_id"), F.explode(one).alias("p")).select("image_id", "p.x", "p.y")
    assert n * len(places) > getattr(raster, "LOOP_PIXELS", 0)
    found = raster.loops(pixels, least=400)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert {r.image_id for r in got} == {None, *map(str, range(1, n))} and len(got) == 2 * n
    assert {tuple(r)[1:] for r in got} == {(1, "rect", 61 * 51, 5, -20, 66, 31), (2, "rect", 45 * 43, 10, -16, 55, 27)}


def test_repair_broadcasts_no_table_of_all_components(spark):
    """Two million components take few bytes on disk; the driver mustn't gather them because of that."""
    ids = spark.range(2_000_000).select(F.col("id").alias("comp_id"), F.element_at(F.array(F.lit("gnd"), F.lit("resistor")), (F.col("id") % 2 + 1).cast("int")).alias("cls"))
    comps = materialize(ids, "comps")
    pins = materialize(comps.select(F.col("comp_id").alias("pin_id"), "comp_id", (F.col("comp_id") % 53).alias("image_id"), (F.col("comp_id") * 7 % 4001).alias("x"), (F.col("comp_id") * 9 % 4003).alias("y"), F.when(F.col("comp_id") % 9 > 0, F.col("comp_id") % 2_000).alias("enet")), "pins")
    taps = spark.createDataFrame([(5,)], "tap long")
    plan = repair.repair_candidates(comps, pins, taps)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [comp_id" in plan and "BroadcastHashJoin [comp_id" not in plan


def test_circuit_broadcasts_no_orders(spark, tmp_path):
    """Orders whose files are small may be millions of rows."""
    spark.range(2_000_000).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(str(tmp_path / "orders.parquet"))
    lines = spark.range(2_000_000).select(F.col("id").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit(9.0).alias("l_quantity"), F.lit(1.0).alias("l_extendedprice"), F.current_timestamp().alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    comps, _ = fixtures._circuit(spark, str(tmp_path), 200)
    plan = comps._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [comp_id" in plan and "Broadcast" not in plan
    assert comps.where("cls = 'gnd'").count() == 2_000_000


def test_families_and_grounds_meet_by_merge_joins(spark):
    # tables of known size, that the planner would broadcast
    comps = spark.sql("SELECT * FROM VALUES (1L, 'resistor'), (2L, 'gnd'), (3L, 'resistor') AS t(comp_id, cls)")
    pins = spark.sql("SELECT * FROM VALUES (1L, 0L, 7L, 7L), (1L, 1L, 8L, 8L), (2L, 0L, 8L, 8L), (3L, 0L, 7L, NULL), (3L, 1L, 8L, 8L) AS t(comp_id, slot, net, enet)")
    for found, rows in ((motifs.two_ends(comps, pins, RES), [(1, 7, 8)]), (checks.ground_nets(comps, pins), [(8,)])):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in found.collect()] == rows


def test_repair_sorts_no_pins_that_meet(spark):
    """Pins of one spot all meet; what is gathered of them is hashed, not sorted, and a ground symbol's class still counts."""
    comps = spark.createDataFrame([(1, "gnd"), (2, "resistor"), (3, "resistor"), (4, "npn")], "comp_id long, cls string")
    pins = spark.createDataFrame([(10, 1, 0, 0, 0, None), (20, 2, 0, 4, 0, -1), (30, 3, 0, 8, 0, -1), (40, 4, 0, 0, 9, None), (50, 2, 0, 6, 0, 5)], "pin_id long, comp_id long, image_id long, x long, y long, enet long")
    found = repair.repair_candidates(comps, pins, spark.createDataFrame([(5,)], "tap long"))
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in found.where("pin_id <> 50").collect())
    assert got == [(10, 1, -1, 1.9, 4), (10, 2, 5, 1.85, 6), (40, 1, 5, 1.625, 15), (40, 2, -1, -0.325, 13)]

"""Deterministic circuits, boxes, pixels and label rows derived from the driver's tables, the same in Spark and in SQL.

Circuit: an order is a component, its lines are its pins, the class follows from the number of pins and the order's priority, and a pin's net
is a number modulo the profile (sparse 20000, mid 2000, dense 200). Lines of quantity below 3 dangle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialize

SPARSE, MID, DENSE = 20_000, 2_000, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(column: str, cases: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cases.items()) + f" ELSE '{other}' END"


# Text that Spark and DuckDB read alike.
CLASS_SQL = f"""CASE np
 WHEN 1 THEN {_cases("substr(o_orderpriority, 1, 1)", {"1": "gnd", "2": "vss", "3": "vdd"}, "port")}
 WHEN 2 THEN {_cases("substr(o_orderpriority, 1, 1)", {"1": "resistor", "2": "capacitor", "3": "diode", "4": "resistor"}, "voltage.dc")}
 WHEN 3 THEN {_cases("substr(o_orderpriority, 1, 1)", {"1": "npn", "2": "pnp"}, "nmos")}
 WHEN 4 THEN 'transformer' ELSE 'integrated_circuit' END"""
ROLE_SQL = """CASE WHEN np = 2 OR np = 4 THEN concat('p', CAST(slot AS VARCHAR(10)))
 WHEN np = 3 AND cls = 'nmos' THEN substr('dgs', CAST(slot + 1 AS INT), 1) WHEN np = 3 THEN substr('cbe', CAST(slot + 1 AS INT), 1)
 WHEN cls IN ('gnd', 'vss') THEN 'g' WHEN cls = 'vdd' THEN 'pwr' WHEN cls = 'port' THEN '1' ELSE concat('L', CAST(slot AS VARCHAR(10))) END"""


_stored: dict[tuple, tuple[DataFrame, ...]] = {}


def stored(spark: SparkSession, key: tuple, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    """Derived tables, written once for an application, as the tables of a real corpus would be: queries read them instead of deriving them at each use."""
    at = (spark.sparkContext.applicationId, *key)
    if at not in _stored:
        _stored[at] = tuple(materialize(df, f"fixture-{i}") for i, df in enumerate(make()))
    return _stored[at]


def circuit(spark: SparkSession, sf_dir: str, modulus: int) -> tuple[DataFrame, DataFrame]:
    """components (comp_id, np, cls) and pins (pin_id, comp_id, slot, role, net)."""
    comps, pins = stored(spark, ("circuit", sf_dir, modulus), lambda: _circuit(spark, sf_dir, modulus))
    return comps, pins


def _circuit(spark: SparkSession, sf_dir: str, modulus: int) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem")
    net = F.when(F.col("l_quantity") < 3, None).otherwise(F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey") * 13, F.lit(modulus))).cast("bigint")
    raw = lines.select(F.col("l_orderkey").alias("comp_id"), (F.row_number().over(order) - 1).cast("bigint").alias("slot"), net.alias("net"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("comp_id"), "o_orderpriority")
    comps = lines.groupBy(F.col("l_orderkey").alias("comp_id")).agg(F.count(F.lit(1)).alias("np")).join(orders.hint("merge"), "comp_id")  # the planner knows the files of orders alone, which may be a tenth of the rows
    comps = comps.select("comp_id", "np", F.expr(CLASS_SQL).alias("cls"))
    pins = raw.join(comps, "comp_id").select((F.col("comp_id") * 100 + F.col("slot")).alias("pin_id"), "comp_id", "slot", F.expr(ROLE_SQL).alias("role"), "net")
    return comps, pins


def circuit_sql(modulus: int) -> str:
    """CTEs raw, comps, pins, gnd, epins, fan (raw nets), efan (electrical nets)."""
    return f"""raw AS (SELECT l_orderkey AS comp_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS slot,
   CASE WHEN l_quantity < 3 THEN NULL ELSE (l_partkey * 7 + l_suppkey * 13) % {modulus} END AS net FROM lineitem),
 counted AS (SELECT comp_id, count(*) AS np FROM raw GROUP BY comp_id),
 comps AS (SELECT comp_id, np, {CLASS_SQL} AS cls FROM counted JOIN orders ON o_orderkey = comp_id),
 pins AS (SELECT comp_id * 100 + slot AS pin_id, comp_id, slot, cls, {ROLE_SQL} AS role, net FROM raw JOIN comps USING (comp_id)),
 gnd AS (SELECT DISTINCT net FROM pins WHERE cls IN ('gnd', 'vss') AND net IS NOT NULL),
 epins AS (SELECT pins.*, CASE WHEN gnd.net IS NOT NULL THEN -1 ELSE pins.net END AS enet FROM pins LEFT JOIN gnd ON pins.net = gnd.net),
 fan AS (SELECT net, count(*) AS fanout FROM pins WHERE net IS NOT NULL GROUP BY net),
 efan AS (SELECT enet, count(*) AS fanout FROM epins WHERE enet IS NOT NULL GROUP BY enet)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id, image_id, x0, y0, x1, y1, conf: twenty pictures of boxes."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    rows = part.select(key.alias("det_id"), (key % 20).alias("image_id"), ((key * 37) % 200).alias("x0"), ((key * 91) % 200).alias("y0"), (((key * 7919) % 1000) / 1000.0).alias("conf"), F.col("p_size").cast("bigint").alias("size"))
    return rows.select("det_id", "image_id", "x0", "y0", (F.col("x0") + 10 + F.col("size")).alias("x1"), (F.col("y0") + 10 + F.col("size")).alias("y1"), "conf")


BOXES_SQL = """boxes AS (SELECT p_partkey AS det_id, p_partkey % 20 AS image_id, (p_partkey * 37) % 200 AS x0, (p_partkey * 91) % 200 AS y0,
   (p_partkey * 37) % 200 + 10 + p_size AS x1, (p_partkey * 91) % 200 + 10 + p_size AS y1, ((p_partkey * 7919) % 1000) / CAST(1000.0 AS DOUBLE) AS conf FROM part)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y: a line of pixels for every fifth part, along for an even size, else down."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").where(key % 5 == 0).select((key % 20).alias("image_id"), ((key * 37) % 100).alias("x"), ((key * 91) % 100).alias("y"), "p_size", F.explode(F.sequence(F.lit(0), F.col("p_size") % 20 + 3)).alias("i"))
    flat = F.col("p_size") % 2 == 0
    return rows.select("image_id", (F.col("x") + F.when(flat, F.col("i")).otherwise(0)).cast("bigint").alias("x"), (F.col("y") + F.when(flat, 0).otherwise(F.col("i"))).cast("bigint").alias("y")).distinct()


PIXELS_SQL = """pixels AS (SELECT DISTINCT p_partkey % 20 AS image_id, (p_partkey * 37) % 100 + CASE WHEN p_size % 2 = 0 THEN i ELSE 0 END AS x,
   (p_partkey * 91) % 100 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE i END AS y FROM (SELECT *, unnest(range(0, p_size % 20 + 4)) AS i FROM part WHERE p_partkey % 5 = 0))"""


def dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y, dot_id: a dot for every seventh part."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").where(key % 7 == 0).select((key % 20).alias("image_id"), ((key * 53) % 240).alias("x"), ((key * 29) % 240).alias("y"), key.alias("dot_id"))


DOTS_SQL = "dots AS (SELECT p_partkey % 20 AS image_id, (p_partkey * 53) % 240 AS x, (p_partkey * 29) % 240 AS y, p_partkey AS dot_id FROM part WHERE p_partkey % 7 = 0)"


def placed_pins(pins: DataFrame) -> DataFrame:
    """pins with image_id and a place, for the repair operators."""
    x, y = F.col("comp_id") * 2111 + F.col("slot") * 97, F.col("comp_id") * 1693 + F.col("slot") * 211
    return pins.withColumn("image_id", F.col("comp_id") % 53).withColumn("x", x % 4001).withColumn("y", y % 4003)


PLACED_SQL = "placed AS (SELECT *, comp_id % 53 AS image_id, (comp_id * 2111 + slot * 97) % 4001 AS x, (comp_id * 1693 + slot * 211) % 4003 AS y FROM epins)"


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, line_no, line: label lines from parts; some with six words, a bad word, or a class or size out of range."""
    key = F.col("p_partkey")
    cx = ((key * 37) % 1000).cast("string")
    words = F.concat_ws(" ", F.when(key % 97 == 0, "x1").otherwise((key % 110).cast("string")), F.concat(F.lit("0."), F.lpad(cx, 3, "0")), F.concat(F.when(key % 89 == 0, "1.").otherwise("0."), F.lpad(((key * 91) % 1000).cast("string"), 3, "0")), F.concat(F.lit("0."), F.lpad(F.col("p_size").cast("string"), 3, "0")), F.when(key % 83 == 0, "0.000").otherwise("0.250"), F.when(key % 7 == 0, "R90"))
    return table(spark, sf_dir, "part").select((key % 40).cast("string").alias("file"), key.alias("line_no"), words.alias("line"))


LABELS_SQL = """label_lines AS (SELECT CAST(p_partkey % 40 AS VARCHAR) AS file, p_partkey AS line_no, concat_ws(' ', CASE WHEN p_partkey % 97 = 0 THEN 'x1' ELSE CAST(p_partkey % 110 AS VARCHAR) END,
   '0.' || lpad(CAST((p_partkey * 37) % 1000 AS VARCHAR), 3, '0'), (CASE WHEN p_partkey % 89 = 0 THEN '1.' ELSE '0.' END) || lpad(CAST((p_partkey * 91) % 1000 AS VARCHAR), 3, '0'),
   '0.' || lpad(CAST(p_size AS VARCHAR), 3, '0'), CASE WHEN p_partkey % 83 = 0 THEN '0.000' ELSE '0.250' END, CASE WHEN p_partkey % 7 = 0 THEN 'R90' END) AS line FROM part)"""


def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cls, image_id, split, source: an instance for each order line, its class from the part's type."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower(F.col("p_type")).alias("cls"))
    return lines.join(parts, "l_partkey").select("cls", F.col("l_orderkey").alias("image_id"), F.element_at(F.array(F.lit("train"), F.lit("valid"), F.lit("test")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("split"))


INSTANCES_SQL = "instances AS (SELECT lower(p_type) AS cls, l_orderkey AS image_id, CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split FROM lineitem JOIN part ON p_partkey = l_partkey)"

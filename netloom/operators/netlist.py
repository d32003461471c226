"""SPICE text from components and electrical pins, and back: emission, deck, parsing, verification, rail vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import BJT, CAP, DIODE, FET, GROUND, IND, ISRC, LABEL_ONLY, LOAD2, RES, VSRC, is_in

#: Model cards of a deck (fixed values).
MODELS = (".model DMOD D", ".model QMODN NPN", ".model QMODP PNP", ".model MMODN NMOS", ".model MMODP PMOS", ".model SMOD SW()")
#: Words behind the name of an element of a kind, at least, and the nodes that it connects; sources have DC before their value (fixed values).
KINDS = {"R": (3, 2), "C": (3, 2), "L": (3, 2), "D": (3, 2), "Q": (4, 3), "M": (5, 4), "S": (4, 4), "V": (4, 2), "I": (4, 2)}
SOURCES = ("V", "I")


def node_name(enet: Column, pin_id: Column) -> Column:
    """0 for ground, N and the net for others, FLT_ and the pin for a dangling pin."""
    return F.when(enet.isNull(), F.concat(F.lit("FLT_"), pin_id.cast("string"))).when(enet == GROUND, F.lit("0")).otherwise(F.concat(F.lit("N"), enet.cast("string")))


def _by_role(comps: DataFrame, epins: DataFrame) -> DataFrame:
    """comp_id, cls, nodes (role -> node name; of several pins of a role that of the greatest id counts, pins without a role don't)."""
    last = epins.where("role is not null").groupBy("comp_id", "role").agg(F.max_by(node_name(F.col("enet"), F.col("pin_id")), "pin_id").alias("node"))
    pins = last.groupBy("comp_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "node")))).alias("nodes"))
    return comps.select("comp_id", "cls").join(pins, "comp_id", "left").withColumn("nodes", F.coalesce("nodes", F.create_map().cast("map<string,string>")))


def spice_elements(comps: DataFrame, epins: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """comp_id, part, text: the lines of each modelled component (a transformer has three). values: comp_id, value of R, C and loads.

    A role without a pin gives the node FLT_- and the component; of several pins of a role the last one counts.
    """
    rows = _by_role(comps, epins)
    rows = rows.join(values, "comp_id", "left") if values is not None else rows.withColumn("value", F.lit(None).cast("string"))
    ci = F.col("comp_id").cast("string")
    n = lambda role: F.coalesce(F.element_at("nodes", F.lit(role)), F.concat(F.lit("FLT_-"), ci))
    roles = F.array_sort(F.map_keys("nodes"))
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    two = lambda letter, value, note="": F.array(line(letter, ci, " ", n("p0"), " ", n("p1"), " ", value, "  ; ", F.col("cls"), note))
    has = lambda *names: roles == F.array(*[F.lit(x) for x in sorted(names)])
    text = (
        F.when(is_in("cls", RES), two("R", F.coalesce("value", F.lit("1k"))))
        .when(is_in("cls", CAP), two("C", F.coalesce("value", F.lit("1u"))))
        .when(is_in("cls", IND), two("L", "10u Rser=10m"))
        .when(is_in("cls", DIODE), two("D", "DMOD"))
        .when(is_in("cls", BJT) & has("b", "c", "e"), F.array(line("Q", ci, " ", n("c"), " ", n("b"), " ", n("e"), " ", F.when(F.col("cls") == "pnp", "QMODP").otherwise("QMODN"), "  ; ", F.col("cls"))))
        .when(is_in("cls", FET) & has("d", "g", "s"), F.array(line("M", ci, " ", n("d"), " ", n("g"), " ", n("s"), " ", n("s"), " ", F.when(F.col("cls").startswith("pmos"), "MMODP").otherwise("MMODN"), "  ; ", F.col("cls"), " (bulk=s)")))
        .when((F.col("cls") == "transformer") & has("p0", "p1", "p2", "p3"), F.array(line("L", ci, "a ", n("p0"), " ", n("p1"), " 10u Rser=10m"), line("L", ci, "b ", n("p2"), " ", n("p3"), " 10u Rser=10m"), line("K", ci, " L", ci, "a L", ci, "b 1")))
        .when(is_in("cls", VSRC), F.array(F.when(F.map_contains_key("nodes", F.lit("p0")), line("V", ci, " ", n("p0"), " ", n("p1"), " DC 5  ; ", F.col("cls"))).otherwise(line("V", ci, " ", n("1"), " 0 DC 5  ; ", F.col("cls")))))
        .when(is_in("cls", ISRC), two("I", "DC 1m"))
        .when(F.col("cls") == "switch", two("S", "0 0 SMOD"))
        .when(is_in("cls", LOAD2), two("R", F.coalesce("value", F.lit("1k")), " as-load"))
        .when(F.col("cls") == "integrated_circuit", F.array(line("X", ci, " ", F.concat_ws(" ", F.transform(roles, lambda r: F.element_at("nodes", r))), " ICSTUB  ; ", F.col("cls"), " pins=", F.concat_ws(",", roles), " (structural)")))
    )
    rows = rows.select("comp_id", F.posexplode_outer(text).alias("part", "text")).where("text is not null")
    return rows.select("comp_id", F.col("part").cast("bigint").alias("part"), "text")


def spice_skips(comps: DataFrame, epins: DataFrame) -> DataFrame:
    """comp_id, cls, reason (bad-roles, node-label-only, no-primitive) of components without a line."""
    emitted = spice_elements(comps, epins).select("comp_id").distinct()
    rows = comps.select("comp_id", "cls").join(emitted, "comp_id", "left_anti")
    reason = F.when(is_in("cls", BJT + FET + ["transformer"]), "bad-roles").when(is_in("cls", LABEL_ONLY), "node-label-only").otherwise("no-primitive")
    return rows.withColumn("reason", reason)


def spice_deck(elements: DataFrame, title: str = "circuit", picture: str | None = None) -> DataFrame:
    """line_no, text of a whole deck: header, elements in order, models, a stub for integrated circuits, directives.

    picture: a column of elements; every picture then has a deck of its own, under that column, with a null picture being one too. Without it
    all elements are one picture's.
    """
    from pyspark.sql import Window

    spark = elements.sparkSession
    if picture:
        of = elements.select(F.col(picture).alias("of"), "comp_id", "part", "text")
        ids = of.select("of").distinct()
        lines = lambda section, texts: ids.select("of", F.lit(section).alias("section"), F.posexplode(F.array(*[F.lit(x) for x in texts])).alias("a", "text"))
        stubs = of.where(F.col("text").startswith("X")).groupBy("of").agg(F.min_by("text", F.struct("comp_id", "part")).alias("x"))
        words = F.split(F.trim(F.split("x", ";")[0]), " +")
        named = F.concat(F.lit(".subckt ICSTUB "), F.concat_ws(" ", F.slice(words, F.lit(2), F.size(words) - 2)))
        stubs = stubs.select("of", F.lit(3).alias("section"), F.posexplode(F.array(named, F.lit("* structural pins only"), F.lit(".ends ICSTUB"))).alias("a", "text"))
        every = of.select("of", F.lit(1).alias("section"), F.col("comp_id").alias("a"), F.col("part").alias("b"), "text")
        for rows in (lines(0, [f"* {title} (topology and assigned values)", "* 0=GND (ground nets collapsed)"]), lines(2, ["* --- models ---", *MODELS]), stubs, lines(4, [".op", ".end"])):
            every = every.unionByName(rows.select("of", "section", F.col("a").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "text"))
        number = F.row_number().over(Window.partitionBy("of").orderBy("section", "a", "b"))
        return every.select(F.col("of").alias(picture), number.cast("bigint").alias("line_no"), "text")
    stub = elements.where(F.col("text").startswith("X")).orderBy("comp_id").limit(1)
    pins = F.expr("slice(split(trim(split(text, ';')[0]), ' +'), 2, size(split(trim(split(text, ';')[0]), ' +')) - 2)")
    stub = stub.select(F.explode(F.array(F.concat(F.lit(".subckt ICSTUB "), F.concat_ws(" ", pins)), F.lit("* structural pins only"), F.lit(".ends ICSTUB"))).alias("text"))
    fixed = lambda part, lines: spark.createDataFrame([(part, i, 0, x) for i, x in enumerate(lines)], "section int, a bigint, b bigint, text string")
    body = elements.select(F.lit(1).alias("section"), F.col("comp_id").alias("a"), F.col("part").alias("b"), "text")
    stub = stub.select(F.lit(3).alias("section"), F.monotonically_increasing_id().alias("a"), F.lit(0).cast("bigint").alias("b"), "text")
    every = fixed(0, [f"* {title} (topology and assigned values)", "* 0=GND (ground nets collapsed)"]).unionByName(body).unionByName(fixed(2, ["* --- models ---", *MODELS])).unionByName(stub).unionByName(fixed(4, [".op", ".end"]))
    return every.select(F.row_number().over(Window.orderBy("section", "a", "b")).cast("bigint").alias("line_no"), "text")


def parse_spice(lines: DataFrame) -> DataFrame:
    """lines (text, ...) with element, kind, nodes, ok: comments, models and directives go; ok says whether the line has its kind's shape.

    Nodes that begin with a digit aren't kept, but for those of subcircuits (X), whose first node and model name go.
    """
    rows = lines.withColumn("element", F.trim(F.split("text", ";")[0])).where(F.col("element").rlike(r"^[^*.]"))
    rows = rows.withColumn("kind", F.substring("element", 1, 1))
    words = F.split("element", r"\s+")
    count = F.lit(2)
    shape = F.col("kind").isin("X", "K")
    for k, (least, nodes) in KINDS.items():
        count = F.when(F.col("kind") == k, nodes).otherwise(count)
        fits = (F.col("kind") == k) & (F.length(words[0]) > 1) & (F.size(words) > least)
        shape = shape | (fits & (F.get(words, F.lit(3)) == "DC") if k in SOURCES else fits)
    plain = F.filter(F.slice(words, F.lit(2), count), lambda x: ~x.rlike("^[0-9]"))
    nodes = F.when(F.col("kind") == "K", F.array().cast("array<string>")).when(F.col("kind") == "X", F.slice(words, F.lit(3), F.greatest(F.size(words) - 3, F.lit(0)))).otherwise(plain)
    return rows.withColumn("nodes", F.when(shape, nodes).otherwise(F.array().cast("array<string>"))).withColumn("ok", shape)


def spice_fanout(lines: DataFrame) -> DataFrame:
    """node, fanout, stub (fewer than two connections, ground aside) of a deck's nodes."""
    nodes = parse_spice(lines).where("ok").select(F.explode_outer("nodes").alias("node")).where("node is not null")
    fan = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("fanout"))
    return fan.withColumn("stub", (F.col("fanout") < 2) & (F.col("node") != "0"))


def spice_report(lines: DataFrame) -> DataFrame:
    """kind, elements, bad_lines of a deck."""
    return parse_spice(lines).groupBy("kind").agg(F.sum(F.col("ok").cast("bigint")).alias("elements"), F.sum((~F.col("ok")).cast("bigint")).alias("bad_lines"))


def net_incidence(lines: DataFrame) -> DataFrame:
    """element, place, node of the lines (text) of an external netlister: the nodes of R, C, L, D, V, S, I elements by place from 1, those of subcircuits from 0."""
    words = F.split(F.trim("text"), r"\s+")
    rows = lines.where(~F.trim("text").rlike(r"^([*.]|$)")).withColumn("w", words).withColumn("kind", F.substring(F.get("w", F.lit(0)), 1, 1))
    count = F.when(F.col("kind") == "S", 4).otherwise(2)
    plain = F.col("kind").isin(*"RCLDVSI") & (F.size("w") >= 4)
    part = (F.col("kind") == "X") & (F.size("w") >= 3)
    nodes = F.when(plain, F.slice("w", F.lit(2), count)).when(part, F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
    rows = rows.where(plain | part).select(F.get("w", F.lit(0)).alias("element"), "kind", F.posexplode(nodes).alias("place", "node"))
    return rows.select("element", (F.col("place") + F.when(F.col("kind") == "X", 0).otherwise(1)).cast("bigint").alias("place"), "node")


def incidence_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """comp_id, role, want, got, code (missing, mismatch) of the expected incidences (comp_id, role, node) that the actual ones don't have."""
    want = expected.select("comp_id", "role", F.col("node").alias("want"))
    got = actual.select("comp_id", "role", F.col("node").alias("got"))
    rows = want.join(got, ["comp_id", "role"], "left").where(~F.col("want").eqNullSafe(F.col("got")))
    return rows.withColumn("code", F.when(F.col("got").isNull(), "missing").otherwise("mismatch"))


def supply_rail_votes(comps: DataFrame, epins: DataFrame) -> DataFrame:
    """enet, votes of nets, ground aside: 1 for a resistor's pin or a collector or drain, -2 for a base or gate or a capacitor's pin."""
    plus = is_in("cls", RES) | F.col("role").isin("c", "d")
    minus = F.col("role").isin("b", "g") | is_in("cls", CAP)
    rows = epins.where((F.col("enet") != GROUND) & F.col("enet").isNotNull()).join(comps.select("comp_id", "cls"), "comp_id")
    return rows.groupBy("enet").agg(F.sum(F.when(plus, 1).otherwise(0) + F.when(minus, -2).otherwise(0)).cast("bigint").alias("votes"), F.min("pin_id").alias("first_pin"))


def simulation_lines(comps: DataFrame, epins: DataFrame) -> DataFrame:
    """text of a supply on the net of most votes (the one of the first pin on ties), initial conditions of collectors, and the transient run."""
    votes = supply_rail_votes(comps, epins)
    rail = votes.orderBy(F.desc("votes"), "first_pin").limit(1).select(F.concat(F.lit("VVCC N"), F.col("enet").cast("string"), F.lit(" 0 5")).alias("text"))
    q = comps.where(is_in("cls", BJT)).select("comp_id")
    kicks = epins.where("role = 'c' and enet is not null").join(q, "comp_id", "left_semi").where(F.col("enet") != GROUND).select("enet").distinct()
    kicks = kicks.select(F.concat(F.lit(".ic V(N"), F.col("enet").cast("string"), F.lit(")=0")).alias("text"))
    return rail.unionByName(kicks).unionByName(comps.sparkSession.createDataFrame([(".tran 10u 10m",)], "text string"))

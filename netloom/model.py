"""Schemas of the circuit tables and the fixed vocabularies of classes.

components: comp_id, cls, conf, x0, y0, x1, y1, orientation. pins: pin_id, comp_id, slot, role, x, y, net (null: dangling).
Net ids are unique over all pictures of a table, as component and pin ids are; `enet` is the electrical net, where all ground
nets are GROUND.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The electrical net of all ground nets.
GROUND = -1

# Families of component classes by their pins.
AXIAL2 = "antenna capacitor capacitor.adjustable capacitor.polarized clock crystal diac diode diode.light_emitting diode.zener fuse heating_element inductor inductor.ferrite lamp light microphone resistor resistor.adjustable resistor.photo socket speaker switch thermistor varistor voltimeter".split()
GROUND1 = "gnd vss".split()
RAIL1 = "vdd".split()
PORT1 = "generator motor port probe probe.current terminal v".split()
BJT3 = "npn pnp thyristor transistor.bjt transistor.photo".split()
FET3 = "mosfet nmos nmos.bulk pmos pmos.bulk".split()
GATES = "and nand nor not or xor".split()
OPAMP = "operational_amplifier".split()
ICS = "display.7_segment integrated_circuit integrated_circuit.ne555 integrated_circuit.voltage_regulator".split()
XFORMER = "optocoupler relay transformer".split()
NO_PINS = "block connector crossover crossover.curved explanatory junction magnetic mechanical optical text unknown".split()
SOURCES2 = "current_source current_source.ac current_source.dc dependent_current_source voltage voltage.ac voltage.battery voltage.dc voltage.dc.one_port voltage.lines".split()
TGATE4 = "tgate".split()
AMP1 = "amplifier.single_end".split()
TWO_TERMINAL = AXIAL2 + SOURCES2 + AMP1
SOURCE_LIKE = SOURCES2 + GROUND1 + RAIL1 + PORT1

# Families of the netlist.
RES = "resistor resistor.adjustable resistor.photo".split()
CAP = "capacitor capacitor.adjustable capacitor.polarized".split()
IND = "inductor inductor.ferrite".split()
DIODE = "diode diode.light_emitting diode.zener".split()
BJT = "npn pnp transistor.bjt".split()
FET = "mosfet nmos nmos.bulk pmos pmos.bulk".split()
VSRC = "voltage voltage.ac voltage.battery voltage.dc voltage.dc.one_port voltage.lines".split()
ISRC = "current_source current_source.ac current_source.dc dependent_current_source".split()
LOAD2 = "antenna clock crystal diac fuse heating_element lamp light microphone motor socket speaker thermistor varistor voltimeter".split()
LABEL_ONLY = "vdd gnd vss amplifier.single_end and block connector crossover crossover.curved dependent_voltage_source display.7_segment explanatory generator integrated_circuit.ne555 integrated_circuit.voltage_regulator junction magnetic mechanical nand nor not operational_amplifier optical optocoupler or port probe probe.current relay terminal text tgate transistor.photo unknown v xor".split()

# The pins that a family has, as (role, x, y, confidence) in a unit box.
TEMPLATES = {
    "AXIAL2": (AXIAL2 + SOURCES2, [("p0", 0, 0.5, 0.9), ("p1", 1, 0.5, 0.9)]),
    "GROUND1": (GROUND1, [("g", 0.5, 0, 0.9)]),
    "RAIL1": (RAIL1, [("pwr", 0.5, 1, 0.9)]),
    "PORT1": (PORT1, [("1", 0.5, 0.5, 0.6)]),
    "BJT3": (BJT3, [("c", 0.85, 0, 0.9), ("b", 0, 0.5, 0.9), ("e", 0.85, 1, 0.7)]),
    "FET3": (FET3, [("d", 0.85, 0, 0.9), ("g", 0, 0.5, 0.9), ("s", 0.85, 1, 0.7)]),
    "NOT": (["not"], [("in0", 0, 0.5, 0.9), ("out", 1, 0.5, 0.9)]),
    "GATES": ([x for x in GATES if x != "not"], [("in0", 0, 0.3, 0.9), ("in1", 0, 0.7, 0.9), ("out", 1, 0.5, 0.9)]),
    "OPAMP": (OPAMP, [("in-", 0, 0.3, 0.9), ("in+", 0, 0.7, 0.9), ("out", 1, 0.5, 0.9)]),
    "AMP1": (AMP1, [("in", 0, 0.5, 0.9), ("out", 1, 0.5, 0.9)]),
    "XFORMER": (XFORMER, [("p0", 0, 0.25, 0.9), ("p1", 0, 0.75, 0.9), ("p2", 1, 0.25, 0.9), ("p3", 1, 0.75, 0.7)]),
    "TGATE4": (TGATE4, [("a", 0, 0.3, 0.9), ("b", 0, 0.7, 0.9), ("c", 1, 0.3, 0.9), ("d", 1, 0.7, 0.6)]),
}
#: Families whose roles are a contract.
CONTRACTS = ("BJT3", "FET3", "NOT", "GATES", "OPAMP", "XFORMER", "TGATE4", "AMP1")

# Classes folded into others.
FOLD = {
    "nmos.cross": "nmos", "pmos.cross": "pmos", "npn.cross": "npn", "pnp.cross": "pnp", "transistor": "transistor.bjt", "generator": "unknown", "connector": "unknown",
    "diode.thyrector": "unknown", "galvanometer": "unknown", "operational_amplifier.schmitt_trigger": "unknown", "frequency_meter": "unknown", "buzzer": "unknown", "ohmmeter": "unknown", "thermistor": "unknown",
}


def is_in(column: Column | str, family: list[str]) -> Column:
    return (F.col(column) if isinstance(column, str) else column).isin(*family)


def contract_of(cls: Column) -> Column:
    """The roles that a class must have, or null."""
    found = F.lit(None).cast("array<string>")
    for name in CONTRACTS:
        classes, pins = TEMPLATES[name]
        found = F.when(cls.isin(*classes), F.array(*[F.lit(p[0]) for p in pins])).otherwise(found)
    return found


def class_kinds(spark: SparkSession) -> DataFrame:
    """cls, kind: the family of every known class; a dimension of fixed size."""
    families = {k: v[0] for k, v in TEMPLATES.items()} | {"ICS": ICS, "NONE": NO_PINS}
    return spark.createDataFrame([(c, k) for k, v in families.items() for c in v], "cls string, kind string")


def template_dimension(spark: SparkSession) -> DataFrame:
    """cls, role, nx, ny, pin_conf of every class with a template; a dimension of fixed size."""
    return spark.createDataFrame([(c, r, float(x), float(y), conf) for classes, pins in TEMPLATES.values() for c in classes for r, x, y, conf in pins], "cls string, role string, nx double, ny double, pin_conf double")


def values_sql(column: str, family: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(x) for x in family)})"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)

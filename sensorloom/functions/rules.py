"""Ordered rule tables for equipment groups, point groups and unit repair.

A table is data; ``first_match`` expands one into a single CASE expression, so every rule
stays inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sensorloom.functions.values import is_number, numeric_value

NO_RULE = "NEED TO LABEL"

# Equipment name contains (case-sensitive) -> group, first match wins.
# The "LEF" entry can never fire because "EF" comes before it.
EQUIP_RULES: list[tuple[tuple[str, ...], str]] = [
    (("Cooling", "CT"), "Cooling"),
    (("AHU",), "Air_Equip"),
    (("Windows",), "Window"),
    (("VAV",), "VAV"),
    (("Heating",), "Heating"),
    (("RAD",), "RAD"),
    (("EF",), "Air_Equip"),
    (("LEF",), "LEF"),
    (("FF",), "Fan_Equip"),
    (("FM",), "Air_Equip"),
    (("EAV",), "EAV"),
    (("PA",), "OPC(TV)"),
    (("PB",), "OPC(TV)"),
    (("FC",), "Fan_Equip"),
    (("CRAH",), "Air_Equip"),
    (("LEED",), "LEED"),
    (("Zone",), "Humidity"),
    (("WM",), "Water"),
    (("Gas",), "Gas"),
    (("DCB",), "Power"),
    (("DCA",), "Power"),
]

# Point name contains -> group, first match wins. Entries are matched on the
# lower-cased name, those starting with "=" on the name as it is, and "-" excludes.
# "Instant_Power" and the second "power" can never fire because "power" comes before them.
NAV_RULES: list[tuple[tuple[str, ...], str]] = [
    (("alarm",), "Alarm"),
    (("temp", "lwt", "ewt", "humidity"), "Temp"),
    (("water", "_cw", "chw", "=SB1_2_FWT_T", "lwco"), "Water"),
    (("air", "ach", "ahu", "inlet"), "Air"),
    (("press", "_dp"), "Pressure"),
    (("heat", "hrv", "_rh"), "Heat"),
    (("fire_rate", "firing_rate"), "Fire Rate"),
    (("power", "voltage", "vfd"), "Power"),
    (("energy", "curr", "btu", "=kW"), "Energy"),
    (("fan", "fcu", "ef-efficiency"), "Fan"),
    (("=Instant_Power",), "Instant_Power"),
    (("open_percent", "occupancy"), "Occupancy"),
    (("feedback", "demand"), "Feedback"),
    (("=CO2",), "CO2"),
    (("power",), "Power"),
    (("cool", "_ct_"), "Cooling"),
    (("speed",), "Speed"),
    (("pump",), "Pump"),
    (("_tl",), "_TL"),
    (("_aflw",), "_AFLW"),
    (("_sp",), "_SP/_SPT"),
    (("cmd",), "Cmd"),
    (("_day",), "_DAY"),
    (("_av",), "_AV"),
    (("_bms",), "_BMS"),
    (("status",), "_Status"),
    (("rwt",), "_RWT"),
    (("_open",), "_OPEN"),
    (("wifi",), "Wifi"),
    (("operation",), "Operation"),
    (("pres",), "_PRES"),
    (("_efficiency",), "_EFFICIENCY"),
    (("_flow",), "_FLOW"),
    (("_delay",), "_DELAY"),
    (("_clg",), "_CLG"),
    (("bs050",), "BS050"),
    (("fdbk",), "_FDBK"),
]


@dataclass(frozen=True)
class UnitRule:
    """All given conditions must hold; ``binary`` rules keep only 0/1 values (else null)."""

    result: str
    nav_is: tuple[str, ...] = ()
    nav_has: tuple[str, ...] = ()
    equip_has: str | None = None
    value_is: str | None = None
    unit_is: tuple[str, ...] = ()
    unit_has: str | None = None
    type_has: str | None = None
    binary: bool = False


# Unit repairs found in real readings, first match wins.
UNIT_RULES: list[UnitRule] = [
    UnitRule("omit", nav_has=("ALRM",), binary=True),
    UnitRule("omit", nav_has=("Enable Cmd", "Run Cmd"), binary=True),
    UnitRule("omit", nav_has=("Outside Air Damper",), binary=True),
    UnitRule("gal/min", nav_is=("Hot Water Flow",), unit_is=("°C",)),
    UnitRule("gal/min", nav_is=("ESB_CHIL1_PCE01_CHWFLW", "ESB_CHIL2_PCE02_CHWFLW"), unit_is=("°C",)),
    UnitRule("omit", value_is="True"),
    UnitRule("%", nav_is=("Valve Feedback",), unit_is=("_",)),
    UnitRule("Pa", nav_is=("Exhaust Air Duct Static Pressure",), unit_is=("°C", "ft/min")),
    UnitRule("%", nav_has=("Speed",), unit_is=("°C",)),
    UnitRule("°C", nav_has=("JCL-NAE43/FCB-01.FEC-50.BLDG",), unit_is=("Pa",)),
    UnitRule("%", nav_is=("Heating Valve Cmd",), unit_is=("_", "A")),
    UnitRule("%", nav_has=("Discharge Air Damper",), unit_is=("_",)),
    UnitRule("omit", nav_has=("Flow Alarm",), unit_is=("%", "_", "L/s")),
    UnitRule("L/s", nav_is=("Exhaust Air Flow",), unit_is=("°C",)),
    UnitRule("°C", nav_has=("Water Temp",), unit_is=("%",)),
    UnitRule("°C", nav_has=("ESB_TMX",), equip_has="Thermanex Header", unit_is=("%",)),
    UnitRule("°C", nav_has=("Outside Air Temp",), equip_has="Thermanex Header", unit_is=("%",)),
    UnitRule("°C", nav_has=("JCL-NAE29/BACnet-IP.FOL-MHP4.Analog Values.AV-1002",), unit_is=("_",)),
    UnitRule("omit", nav_has=("ISOD",), equip_has="LEF-4 EF-4", unit_is=("_", "°C")),
    UnitRule("kWh", unit_has="_", type_has="kWh"),
    UnitRule("omit", unit_has="_"),
]


def first_match(cases: list[tuple[Column, Column]], default: Column) -> Column:
    head, *rest = cases
    return reduce(lambda acc, c: acc.when(*c), rest, F.when(*head)).otherwise(default)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def equip_label(equip: Column | str = "equipRef") -> Column:
    """Group of an equipment name; a null counts as the text ``nan`` and matches nothing."""
    e = F.coalesce(F.col(equip) if isinstance(equip, str) else equip, F.lit("nan"))
    return first_match(
        [(_any([e.contains(s) for s in subs]), F.lit(group)) for subs, group in EQUIP_RULES], F.lit(NO_RULE)
    )


def nav_label(nav: Column | str = "navName") -> Column:
    """Group of a point name; a null counts as the text ``nan`` and matches nothing."""
    n = F.coalesce(F.col(nav) if isinstance(nav, str) else nav, F.lit("nan"))
    low = F.lower(n)

    def has(entry: str) -> Column:
        if entry.startswith("="):
            return n.contains(entry[1:])
        wanted, _, excluded = entry.partition("-")
        hit = low.contains(wanted)
        return hit & ~low.contains(excluded) if excluded else hit

    return first_match(
        [(_any([has(s) for s in subs]), F.lit(group)) for subs, group in NAV_RULES], F.lit(NO_RULE)
    )


def fix_unit(
    nav: str = "navName", equip: str = "equipRef", value: str = "value", unit: str = "unit", typeref: str = "typeRef"
) -> Column:
    """The right unit of a reading by the ordered repair rules."""
    n, e, t = (F.coalesce(F.col(c), F.lit("")) for c in (nav, equip, typeref))
    u = F.coalesce(F.col(unit), F.lit(""))
    # A value that is no number counts as 0 or 1, so only other numbers leave the rule empty.
    is_binary = ~is_number(value) | F.coalesce(numeric_value(value).isin(0.0, 1.0), F.lit(False))

    def condition(r: UnitRule) -> Column:
        parts = []
        if r.nav_is:
            parts.append(n.isin(*r.nav_is))
        if r.nav_has:
            parts.append(_any([n.contains(s) for s in r.nav_has]))
        if r.equip_has:
            parts.append(e.contains(r.equip_has))
        if r.value_is:
            parts.append(F.coalesce(F.col(value) == r.value_is, F.lit(False)))
        if r.unit_is:
            parts.append(u.isin(*r.unit_is))
        if r.unit_has:
            parts.append(u.contains(r.unit_has))
        if r.type_has:
            parts.append(t.contains(r.type_has))
        return reduce(lambda a, b: a & b, parts)

    def result(r: UnitRule) -> Column:
        return F.when(is_binary, r.result) if r.binary else F.lit(r.result)

    return first_match([(condition(r), result(r)) for r in UNIT_RULES], F.col(unit))


def several_units(df: DataFrame, key: str = "uniqueId") -> DataFrame:
    """Sensors that occur with more than one unit, no unit being one, as one partial aggregate."""
    u = F.coalesce(F.col("unit"), F.lit("\u0000"))
    spans = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(u).alias("lo"), F.max(u).alias("hi"))
    return spans.filter("lo <> hi").select(key)


def problem_readings(df: DataFrame, key: str = "uniqueId") -> DataFrame:
    """Readings of sensors that occur with more than one unit."""
    return df.join(several_units(df, key), key, "left_semi")


def correct_units(df: DataFrame, key: str = "uniqueId") -> DataFrame:
    """Repair units, but only of sensors that occur with more than one unit.

    The sensor list is small next to the readings, so the join back moves it and not the
    readings when it is below Spark's broadcast size, and is a skew-splittable left join
    otherwise.
    """
    several = several_units(df, key).withColumn("_several", F.lit(True))
    return (
        df.join(several, key, "left")
        .withColumn("unit", F.when(F.col("_several"), fix_unit()).otherwise(F.col("unit")))
        .select(*df.columns)
    )

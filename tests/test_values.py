import datetime

import pytest
from pyspark.sql import functions as F

from sensorloom.functions import flags, ids, rules, values
from sensorloom.sources import readings as R

CASES = [
    ("1", "num"), ("1.0", "num"), (" 3 ", "num"), ("1e5", "num"), ("NaN", "num"), ("-inf", "num"), ("1d", "str"),
    ("1_000", "num"), ("1__0", "str"), ("True", "bool"), ("true", "str"), ("False", "bool"), ("", "str"), ("rain", "str"),
    (".5", "num"), ("5.", "num"), (None, "str"), ("0", "num"),
]


def test_value_type_and_number(spark):
    df = spark.createDataFrame([(v,) for v, _ in CASES], "value string")
    got = df.select("value", values.value_type().alias("t"), values.numeric_value().alias("x")).collect()
    assert [(g["value"], g["t"]) for g in got] == CASES
    by = {g["value"]: g["x"] for g in got}
    assert by["1_000"] == 1000.0 and by[" 3 "] == 3.0 and by["1d"] is None and by["5."] == 5.0
    assert by["NaN"] != by["NaN"] and by["-inf"] == float("-inf")


# (nav, equip, value, unit, type) -> unit, one row per rule and the rule that leaves nothing.
UNITS = [
    (("X ALRM", "", "1", "_", ""), "omit"), (("X ALRM", "", "7", "_", ""), None), (("X ALRM", "", "on", "_", ""), "omit"),
    (("Run Cmd", "", "0.0", "°C", ""), "omit"), (("Outside Air Damper", "", "True", "%", ""), "omit"),
    (("Hot Water Flow", "", "3", "°C", ""), "gal/min"), (("ESB_CHIL1_PCE01_CHWFLW", "", "3", "°C", ""), "gal/min"),
    (("Any", "", "True", "kW", ""), "omit"), (("Valve Feedback", "", "3", "_", ""), "%"),
    (("Exhaust Air Duct Static Pressure", "", "3", "ft/min", ""), "Pa"), (("Fan Speed", "", "3", "°C", ""), "%"),
    (("a JCL-NAE43/FCB-01.FEC-50.BLDG b", "", "3", "Pa", ""), "°C"), (("Heating Valve Cmd", "", "3", "A", ""), "%"),
    (("Discharge Air Damper 2", "", "3", "_", ""), "%"), (("Flow Alarm", "", "3", "L/s", ""), "omit"),
    (("Exhaust Air Flow", "", "3", "°C", ""), "L/s"), (("Hot Water Temp", "", "3", "%", ""), "°C"),
    (("ESB_TMX 1", "Thermanex Header", "3", "%", ""), "°C"), (("Outside Air Temp", "Thermanex Header", "3", "%", ""), "°C"),
    (("JCL-NAE29/BACnet-IP.FOL-MHP4.Analog Values.AV-1002", "", "3", "_", ""), "°C"),
    (("ISOD", "LEF-4 EF-4", "3", "_", ""), "omit"), (("N", "", "3", "a_b", "x kWh"), "kWh"), (("N", "", "3", "_", ""), "omit"),
    (("N", "", "3", "kW", ""), "kW"),
]


def test_fix_unit_rules(spark):
    df = spark.createDataFrame([(i, *k) for i, (k, _) in enumerate(UNITS)], "i int, navName string, equipRef string, value string, unit string, typeRef string")
    got = {r["i"]: r["u"] for r in df.select("i", rules.fix_unit().alias("u")).collect()}
    assert [got[i] for i in range(len(UNITS))] == [u for _, u in UNITS]


def test_every_label_rule_fires_or_is_shadowed(spark):
    dead_equip, dead_nav = {7}, {10, 14}
    rows = [("e", i, subs[0]) for i, (subs, _) in enumerate(rules.EQUIP_RULES)]
    rows += [("n", i, subs[0].lstrip("=").partition("-")[0]) for i, (subs, _) in enumerate(rules.NAV_RULES)]
    df = spark.createDataFrame(rows, "k string, i int, name string")
    for r in df.select("k", "i", rules.equip_label("name").alias("e"), rules.nav_label("name").alias("n")).collect():
        if r["k"] == "e":
            assert (r["e"] == rules.EQUIP_RULES[r["i"]][1]) == (r["i"] not in dead_equip)
        elif r["i"] not in dead_nav and r["i"] not in {31, 32}:
            assert r["n"] == rules.NAV_RULES[r["i"]][1], r
    none = spark.createDataFrame([(None,), ("efficiency",)], "name string").select(rules.equip_label("name").alias("e"), rules.nav_label("name").alias("n"))
    assert [tuple(x) for x in none.collect()] == [(rules.NO_RULE, rules.NO_RULE), (rules.NO_RULE, rules.NO_RULE)]


def test_ids(spark):
    cols = "equipRef string, groupRef string, navName string, siteRef string, typeRef string"
    df = spark.createDataFrame([("AHU", "Site A Air", "Temp", "Site A", "T1"), (None, "G", "N", "Site A", None)], cols)
    got = df.select(ids.unique_id().alias("u"), ids.unique_id_flux().alias("f"), ids.unique_id("Other").alias("o")).collect()
    assert got[0]["u"] == got[0]["f"] == "AHU Air Temp T1"
    assert got[0]["o"] == "AHU Site A Air Temp Site A T1"
    assert got[1]["u"] == " G N "


def test_correct_units_only_touches_sensors_with_several_units(spark):
    df = spark.createDataFrame(
        [("a", "Fan Speed", "e", "1", "°C", "t"), ("a", "Fan Speed", "e", "1", "%", "t"), ("b", "Fan Speed", "e", "1", "°C", "t"),
         ("c", "Fan Speed", "e", "1", "°C", "t"), ("c", "Fan Speed", "e", "1", None, "t")],
        "uniqueId string, navName string, equipRef string, value string, unit string, typeRef string")
    got = sorted((r["uniqueId"], r["unit"] or "-") for r in rules.correct_units(df).collect())
    assert got == [("a", "%"), ("a", "%"), ("b", "°C"), ("c", "%"), ("c", "-")]


def test_checkmark_to_int_and_gas(spark):
    df = spark.createDataFrame([("✓", "x", "?"), ("", "y", "1"), (None, "z", None)], "m string, t string, isGas string")
    got = flags.checkmark_to_int(df).withColumn("isGas", flags.is_gas_clean()).collect()
    assert [tuple(g) for g in got] == [(1, "x", "no_gas"), (0, "y", "yes_gas"), (0, "z", "yes_gas")]


def test_days_are_checked_and_missing_days_have_no_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        R.date_spine(spark, "16-03-2020", "2020-03-17")
    assert [r[0] for r in R.date_spine(spark, "2020-02-28", "2020-03-01").collect()] == ["2020-02-28", "2020-02-29", "2020-03-01"]
    (tmp_path / "2020-03-16.csv").write_text(",groupRef,typeRef,unit,value\n2020-03-16 02:20:00+00:00,weatherRef,Sun,omit,False\n")
    (tmp_path / "2020-03-18.csv").write_text(",groupRef,typeRef,unit,value\n2020-03-18 07:00:00+00:00,weatherRef,Rain,mm,\n")
    df = R.scan_weather_by_day(spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("day", "datetime", "typeRef", "value").collect())
    assert got[0] == ("2020-03-16", datetime.datetime(2020, 3, 16, 2, 20), "Sun", "False")
    assert got[1][0] == "2020-03-18" and got[1][3] is None
    assert R.scan_weather_by_day(spark, str(tmp_path), start="2020-03-17").count() == 1
    assert sorted(r[0] for r in R.dates_from_files(spark, str(tmp_path)).collect()) == ["2020-03-16", "2020-03-18"]


def test_scan_range_has_open_ends(spark):
    t = datetime.datetime
    rows = [("s", t(2020, 1, 1), "kWh"), ("s", t(2020, 1, 1, 0, 0, 1), "kWh"), ("s", t(2020, 1, 2, 23, 59, 59), "kWh"), ("s", t(2020, 1, 2, 5), "_")]
    df = spark.createDataFrame(rows, "siteRef string, datetime timestamp_ntz, unit string").withColumns(
        {"navName": F.lit("n"), "typeRef": F.lit(None).cast("string"), "groupRef": F.lit("g")})
    assert R.scan_ec(df, "s", "2020-01-01", "2020-01-02").count() == 1
    assert R.scan_nc(df, "s", "2020-01-01", "2020-01-02").count() == 1

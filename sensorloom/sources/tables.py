"""Adapter: the driver's tables as sensor data.

``events`` become readings (one sensor per user and event type) and weather readings. The same definitions as SQL text are the first steps of every oracle query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Point names per event type, picked by user.
NAVS: dict[str, list[str]] = {
    "purchase": ["Energy Meter", "AHU1_SF_VFD_PWR(kWh)", "Main kW Demand", "BTU Meter"],
    "click": ["Gas Energy", "Hot Water Flow", "Steam BTU", "Domestic Water"],
    "view": ["Supply Temp", "Water Temp", "Fan Speed", "Exhaust Air Flow", "Outside Air Temp", "Hot Water Flow"],
    "error": ["Run Cmd", "Fan Status", "SF ALRM", "Outside Air Damper", "Enable Cmd"],
    "signup": [
        "Valve Feedback",
        "Heating Valve Cmd",
        "Flow Alarm",
        "Discharge Air Damper",
        "Occupancy",
        "ISOD LEF",
        "CO2 Level",
    ],
}
EQUIPS = ["Cooling CT", "AHU", "Heating", "LEED", "Zone", "VAV", "Thermanex Header", "LEF-4 EF-4"]
GROUPS = {"click": "Utilities", "view": "HVAC", "error": "Status", "signup": "Plant"}
STATES = ["low", "mid", "high"]
LABELS = [
    "00_HEATING_SPACE_AND_WATER",
    "01_SPACE_COOLING",
    "02_HEATING_COOLING_COMBINED",
    "03_LIGHTING_NORMAL",
    "04_LIGHTING_EMERGENCY",
    "05_OTHER",
]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: list[str], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (by % len(names) + 1).cast("int"))


def _by_type(cases: dict[str, Column], default: Column | None = None) -> Column:
    out = None
    for kind, value in cases.items():
        hit = F.col("event_type") == kind
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if default is None else out.otherwise(default)


def sensor_columns() -> list[Column]:
    user = F.col("user_id")
    site = F.concat(F.lit("Site "), (user % 5).cast("string"))
    return [
        F.coalesce(_by_type({k: F.lit(v) for k, v in GROUPS.items()}), F.concat(site, F.lit(" Power"))).alias(
            "groupRef"
        ),
        F.concat(_pick(EQUIPS, user), F.lit("-"), user.cast("string")).alias("equipRef"),
        _by_type({k: _pick(v, user) for k, v in NAVS.items()}).alias("navName"),
        site.alias("siteRef"),
        F.when(
            (user % 7 == 0) & (F.col("event_type") == "signup"), F.concat(F.lit("P"), user.cast("string"), F.lit(" kWh"))
        )
        .otherwise(F.concat(F.lit("P"), user.cast("string")))
        .alias("typeRef"),
    ]


def readings_of(events: DataFrame) -> DataFrame:
    """Readings from a frame with the columns of ``events``, batch or streaming."""
    user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    odd = event % 2 == 1
    unit = (
        F.when(kind == "purchase", "kWh")
        .when(kind == "click", "m³")
        .when((kind == "view") & (user % 4 == 1) & odd, "%")
        .when(kind == "view", "°C")
        .when((kind == "signup") & (user % 4 == 3) & odd, "%")
        .otherwise("_")
    )
    value = (
        F.when((kind == "purchase") & (event % 29 == 0), "offline")
        .when((kind == "view") & (event % 11 == 0), "fault")
        .when(kind.isin("purchase", "click", "view"), F.col("value").cast("string"))
        .when((kind == "error") & (event % 3 == 0), "True")
        .when(kind == "error", "False")
        .otherwise(_pick(STATES, event))
    )
    return events.select(
        event.alias("seq"), F.col("ts").alias("datetime"), *sensor_columns(), unit.alias("unit"), value.alias("value")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of(load(spark, sf_dir, "events"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col("ts").alias("datetime"),
        F.lit("weatherRef").alias("groupRef"),
        F.concat(F.lit("Outdoor "), "event_type").alias("typeRef"),
        F.lit("°C").alias("unit"),
        F.col("value").cast("string").alias("value"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata points with references that carry id tokens; one row per sensor and active day."""
    ref = F.lit("@p:demo:r:1a2b ")
    tagged = load(spark, sf_dir, "events").select(
        *sensor_columns(), "event_type", "user_id", F.to_date("ts").cast("string").alias("lastSynced")
    )
    mark = lambda cond: F.when(cond, "✓").otherwise("")
    kind, user = F.col("event_type"), F.col("user_id")
    return tagged.select(
        F.concat(ref, "equipRef").alias("equipRef"),
        F.concat(ref, "groupRef").alias("groupRef"),
        "navName",
        F.concat(ref, "siteRef").alias("siteRef"),
        F.col("typeRef").alias("bmsName"),
        F.when(user % 10 == 3, F.lit(None)).otherwise(F.col("lastSynced")).alias("lastSynced"),
        F.when(kind == "error", "Bool").otherwise("Number").alias("kind"),
        mark(kind.isin("purchase", "click") & (user % 3 != 1)).alias("energy"),
        mark((kind == "purchase") & (user % 2 == 0)).alias("power"),
        mark(kind != "purchase").alias("sensor"),
        F.when(kind == "purchase", "kWh").when(kind == "click", "m³").otherwise("_").alias("unit"),
        mark(kind == "click").alias("water"),
    ).distinct()


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand labels for two thirds of the energy meters."""
    user = F.col("user_id")
    return (
        load(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("purchase", "click") & (user % 3 != 0))
        .select(*sensor_columns(), "user_id", "event_type")
        .distinct()
        .select(
            "groupRef",
            "equipRef",
            "navName",
            "siteRef",
            "typeRef",
            F.when(F.col("event_type") == "purchase", "kWh").otherwise("m³").alias("unit"),
            _pick(["?", "0", "1"], user).alias("isGas"),
            _pick(LABELS, F.floor(user / 3)).alias("endUseLabel"),
        )
    )


def end_use_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished labels of every energy meter, keyed by the dashboard's id."""
    from sensorloom.functions.ids import unique_id_flux

    user = F.col("user_id")
    return (
        load(spark, sf_dir, "events")
        .filter(F.col("event_type").isin("purchase", "click"))
        .select(*sensor_columns(), "user_id")
        .distinct()
        .select(unique_id_flux().alias("uniqueID"), _pick(LABELS, F.floor(user / 3)).alias("endUseLabel"))
        .distinct()
    )


def _sql_list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _sql_pick(names: list[str], by: str) -> str:
    return f"({_sql_list(names)})[CAST(1 + ({by}) % {len(names)} AS INTEGER)]"


_SITE = "'Site ' || CAST(user_id % 5 AS VARCHAR)"
_NAV = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN {_sql_pick(v, 'user_id')}" for k, v in NAVS.items()) + " END"
_GROUP = "CASE " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in GROUPS.items())
_SENSOR_SQL = f"""{_GROUP} ELSE {_SITE} || ' Power' END AS "groupRef",
  {_sql_pick(EQUIPS, 'user_id')} || '-' || CAST(user_id AS VARCHAR) AS "equipRef",
  {_NAV} AS "navName", {_SITE} AS "siteRef",
  'P' || CAST(user_id AS VARCHAR) || CASE WHEN user_id % 7 = 0 AND event_type = 'signup' THEN ' kWh' ELSE '' END AS "typeRef\""""

READINGS_CTE = f"""readings AS (SELECT event_id AS seq, ts AS datetime, {_SENSOR_SQL},
  CASE WHEN event_type = 'purchase' THEN 'kWh' WHEN event_type = 'click' THEN 'm³'
       WHEN event_type = 'view' AND user_id % 4 = 1 AND event_id % 2 = 1 THEN '%'
       WHEN event_type = 'view' THEN '°C'
       WHEN event_type = 'signup' AND user_id % 4 = 3 AND event_id % 2 = 1 THEN '%' ELSE '_' END AS unit,
  CASE WHEN event_type = 'purchase' AND event_id % 29 = 0 THEN 'offline'
       WHEN event_type = 'view' AND event_id % 11 = 0 THEN 'fault'
       WHEN event_type IN ('purchase', 'click', 'view') THEN CAST(value AS VARCHAR)
       WHEN event_type = 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'True' ELSE 'False' END
       ELSE {_sql_pick(STATES, 'event_id')} END AS value
  FROM events)"""

WEATHER_CTE = """weather AS (SELECT ts AS datetime, 'weatherRef' AS "groupRef", 'Outdoor ' || event_type AS "typeRef",
  '°C' AS unit, CAST(value AS VARCHAR) AS value FROM events)"""

POINTS_CTE = f"""points AS (SELECT DISTINCT '@p:demo:r:1a2b ' || "equipRef" AS "equipRef",
  '@p:demo:r:1a2b ' || "groupRef" AS "groupRef", "navName", '@p:demo:r:1a2b ' || "siteRef" AS "siteRef",
  "typeRef" AS "bmsName", CASE WHEN user_id % 10 = 3 THEN NULL ELSE day END AS "lastSynced",
  CASE WHEN event_type = 'error' THEN 'Bool' ELSE 'Number' END AS kind,
  CASE WHEN event_type IN ('purchase', 'click') AND user_id % 3 <> 1 THEN '✓' ELSE '' END AS energy,
  CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN '✓' ELSE '' END AS power,
  CASE WHEN event_type <> 'purchase' THEN '✓' ELSE '' END AS sensor,
  CASE WHEN event_type = 'purchase' THEN 'kWh' WHEN event_type = 'click' THEN 'm³' ELSE '_' END AS unit,
  CASE WHEN event_type = 'click' THEN '✓' ELSE '' END AS water
  FROM (SELECT {_SENSOR_SQL}, event_type, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events))"""

TRAINING_CTE = f"""training AS (SELECT DISTINCT {_SENSOR_SQL},
  CASE WHEN event_type = 'purchase' THEN 'kWh' ELSE 'm³' END AS unit,
  {_sql_pick(['?', '0', '1'], 'user_id')} AS "isGas",
  {_sql_pick(LABELS, 'user_id // 3')} AS "endUseLabel"
  FROM events WHERE event_type IN ('purchase', 'click') AND user_id % 3 <> 0)"""

ENDUSE_CTE = f"""enduse AS (SELECT DISTINCT
  replace("equipRef" || ' ' || "groupRef" || ' ' || "navName" || ' ' || "typeRef", ' ' || "siteRef" || ' ', ' ') AS "uniqueID",
  {_sql_pick(LABELS, 'user_id // 3')} AS "endUseLabel"
  FROM (SELECT {_SENSOR_SQL}, user_id FROM events WHERE event_type IN ('purchase', 'click')))"""

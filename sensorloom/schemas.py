"""Names and schemas of the facts and dimensions."""

from __future__ import annotations

from pyspark.sql import types as T

# Six tags identify a sensor.
SENSOR_TAGS = ["groupRef", "equipRef", "navName", "siteRef", "typeRef", "unit"]

READING_COLUMNS = ["datetime", *SENSOR_TAGS, "value"]

READING_SCHEMA = T.StructType(
    [T.StructField("datetime", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in [*SENSOR_TAGS, "value"]]
)

WEATHER_SCHEMA = T.StructType(
    [T.StructField("datetime", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in ["groupRef", "typeRef", "unit", "value"]]
)

STATS = ["mean", "std", "max", "min"]

# Units of energy meters, label texts of the end-use categories.
ENERGY_UNITS = ["kWh", "m³"]

END_USE_LABELS = [
    "00_HEATING_SPACE_AND_WATER",
    "01_SPACE_COOLING",
    "02_HEATING_COOLING_COMBINED",
    "03_LIGHTING_NORMAL",
    "04_LIGHTING_EMERGENCY",
    "05_OTHER",
]
UNKNOWN_LABEL = "99_UNKNOWN"
UNKNOWN_CODE = 99

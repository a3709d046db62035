"""Named queries: scans, projections, rules, set operations, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import flags, ids, rules, values
from sensorloom.operators import dedupe, energy
from sensorloom.plans.registry import query, r, rounded, rs, with_sql
from sensorloom.plans.sqltext import (
    DATE,
    EC,
    FLUX_ID,
    HOUR,
    IS_EC,
    IS_NUM,
    KIND,
    NUM,
    PLAIN,
    TAGS,
    TYPED,
    UNIQUE_ID,
    equip_case,
    nav_case,
    unit_case,
)
from sensorloom.schemas import READING_COLUMNS, SENSOR_TAGS
from sensorloom.scratch import cut_lineage, scratch_path
from sensorloom.sources import labels as L
from sensorloom.sources import metadata as M
from sensorloom.sources import readings as R
from sensorloom.sources import tables as T

_RCOLS = f"datetime, {TAGS}, value"


# --- scans and sinks -------------------------------------------------------------------


@query("scan_readings_by_day", with_sql("readings", select=f"SELECT {_RCOLS}, {DATE} AS day FROM readings"))
def _(spark, sf):
    path = scratch_path(spark, "days")
    R.write_readings_by_day(T.readings(spark, sf).select(*READING_COLUMNS), path, "csv")
    return R.scan_readings_by_day(spark, path)


@query(
    "scan_weather_by_day",
    with_sql("weather", select=f'SELECT datetime, "groupRef", "typeRef", unit, value, {DATE} AS day FROM weather'),
)
def _(spark, sf):
    path = scratch_path(spark, "weather")
    R.write_readings_by_day(T.weather(spark, sf), path, "csv")
    return R.scan_weather_by_day(spark, path)


@query(
    "union_weather",
    with_sql(
        "readings",
        "weather",
        select=f"""SELECT {_RCOLS} FROM readings UNION ALL
SELECT datetime, "groupRef", 'empty', 'empty', 'empty', "typeRef", unit, value FROM weather""",
    ),
)
def _(spark, sf):
    return R.union_weather(T.readings(spark, sf).select(*READING_COLUMNS), T.weather(spark, sf))


@query("scan_ec", with_sql("readings", select=f"SELECT seq, {_RCOLS} FROM readings WHERE {IS_EC}"))
def _(spark, sf):
    return R.scan_ec(T.readings(spark, sf))


@query(
    "scan_nc",
    with_sql(
        "readings",
        "weather",
        f"""everything AS (SELECT {_RCOLS} FROM readings UNION ALL
SELECT datetime, "groupRef", 'empty', 'empty', 'empty', "typeRef", unit, value FROM weather)""",
        select=f"SELECT {_RCOLS} FROM everything WHERE NOT {IS_EC} OR \"groupRef\" = 'weatherRef'",
    ),
)
def _(spark, sf):
    return R.scan_nc(R.union_weather(T.readings(spark, sf).select(*READING_COLUMNS), T.weather(spark, sf)))


@query("scan_numeric_range", with_sql("readings", select=f"SELECT seq, {_RCOLS} FROM readings WHERE {PLAIN}"))
def _(spark, sf):
    return R.scan_numeric_range(T.readings(spark, sf))


@query(
    "date_spine",
    """SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM (SELECT unnest(generate_series(
    date_trunc('day', min(ts)), date_trunc('day', max(ts)), INTERVAL 1 DAY)) AS d FROM events)""",
)
def _(spark, sf):
    return R.date_spine_of(T.readings(spark, sf))


@query("dates_from_files", with_sql("readings", select=f"SELECT DISTINCT {DATE} AS day FROM readings"))
def _(spark, sf):
    path = scratch_path(spark, "days")
    R.write_readings_by_day(T.readings(spark, sf).select(*READING_COLUMNS), path, "csv")
    return R.dates_from_files(spark, path)


@query("sort_dates", with_sql("readings", select=f"SELECT DISTINCT {DATE} AS day FROM readings ORDER BY day"))
def _(spark, sf):
    return values.split_datetime(T.readings(spark, sf)).select(F.col("date").alias("day")).distinct().orderBy("day")


_POINT_COLS = '"equipRef", "groupRef", "navName", "siteRef", "bmsName", "lastSynced", kind, energy, power, sensor, unit, water'


@query(
    "scan_metadata_strings",
    with_sql(
        "points",
        # An empty text is written as "" and read back as null.
        select="SELECT \"equipRef\", \"groupRef\", \"navName\", \"siteRef\", \"bmsName\", \"lastSynced\", kind,"
        " nullif(energy, '') AS energy, nullif(power, '') AS power, nullif(sensor, '') AS sensor, unit,"
        " nullif(water, '') AS water FROM points",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "points")
    T.points(spark, sf).write.option("header", True).csv(path)
    return M.scan_metadata_strings(spark, path)


@query(
    "scan_labels",
    with_sql(
        "training",
        select="SELECT \"groupRef\", \"equipRef\", \"navName\", \"typeRef\", unit, \"isGas\", \"endUseLabel\", 'Site' AS \"siteRef\" FROM training",
    ),
)
def _(spark, sf):
    path = scratch_path(spark, "labels")
    T.training_labels(spark, sf).drop("siteRef").write.option("header", True).csv(path)
    return M.scan_labels(spark, path, "Site")


@query("checkpoint_write", with_sql("readings", TYPED, select="SELECT seq, value, kind FROM typed"))
def _(spark, sf):
    df = T.readings(spark, sf).select("seq", "value", values.value_type().alias("kind"))
    return cut_lineage(df, "step")


@query("checkpoint_read", with_sql("readings", TYPED, select="SELECT kind, count(*) AS n FROM typed GROUP BY 1"))
def _(spark, sf):
    stored = cut_lineage(T.readings(spark, sf).select("seq", values.value_type().alias("kind")), "step")
    return stored.groupBy("kind").agg(F.count("*").alias("n"))


@query("labels_write", with_sql("enduse", select='SELECT "uniqueID", "endUseLabel" FROM enduse'))
def _(spark, sf):
    path = scratch_path(spark, "enduse")
    L.labels_write(T.end_use_labels(spark, sf), path)
    return spark.read.option("header", True).csv(path)


@query(
    "labels_upsert",
    with_sql(
        "enduse",
        select="""SELECT "uniqueID", CASE WHEN "endUseLabel" LIKE '00%' THEN '05_OTHER' ELSE "endUseLabel" END AS "endUseLabel",
TIMESTAMP '2020-01-01 00:00:00' AS time FROM enduse""",
    ),
)
def _(spark, sf):
    all_labels = T.end_use_labels(spark, sf)
    updates = all_labels.filter(F.col("endUseLabel").startswith("00")).withColumn("endUseLabel", F.lit("05_OTHER"))
    return L.labels_upsert(all_labels, updates)


@query(
    "labels_store",
    with_sql(
        "enduse",
        select="""SELECT "uniqueID", CASE WHEN "endUseLabel" LIKE '00%' THEN '05_OTHER' ELSE "endUseLabel" END AS "endUseLabel",
TIMESTAMP '2020-01-01 00:00:00' AS time FROM enduse""",
    ),
)
def _(spark, sf):
    store = scratch_path(spark, "labels")
    all_labels = T.end_use_labels(spark, sf)
    changed = all_labels.filter(F.col("endUseLabel").startswith("00")).withColumn("endUseLabel", F.lit("05_OTHER"))
    for update in (all_labels, changed, changed):
        L.labels_store(update, store)
    return L.stored_labels(spark, store)


@query(
    "labels_unique_guard",
    with_sql("points", "ids AS (SELECT \"equipRef\" AS \"uniqueID\" FROM points)",
             select='SELECT "uniqueID", count(*) AS count FROM ids GROUP BY 1 HAVING count(*) > 1'),
)
def _(spark, sf):
    return L.duplicated_ids(T.points(spark, sf).select(F.col("equipRef").alias("uniqueId")))


@query(
    "typed_readings",
    with_sql(
        "readings",
        TYPED,
        select="""SELECT seq, x AS val_num, CASE WHEN kind = 'str' THEN value END AS val_str,
CASE WHEN kind = 'bool' THEN value = 'True' END AS val_bool FROM typed""",
    ),
)
def _(spark, sf):
    return values.typed_readings(T.readings(spark, sf)).select("seq", "val_num", "val_str", "val_bool")


# --- projections and filters -----------------------------------------------------------


@query("split_datetime", with_sql("readings", TYPED, select="SELECT seq, date, month, hour FROM typed"))
def _(spark, sf):
    return values.split_datetime(T.readings(spark, sf)).select("seq", "date", "month", "hour")


@query(
    "to_local_time",
    # The test readings lie in January, eight hours behind UTC.
    with_sql("readings", select="SELECT seq, datetime - INTERVAL 8 HOUR AS local_time FROM readings"),
)
def _(spark, sf):
    return T.readings(spark, sf).select("seq", values.to_local_time("datetime").alias("local_time"))


@query("value_type", with_sql("readings", select=f"SELECT seq, value, {KIND} AS dtype FROM readings"))
def _(spark, sf):
    return T.readings(spark, sf).select("seq", "value", values.value_type().alias("dtype"))


@query(
    "separate_cat_and_cont",
    with_sql(
        "readings",
        TYPED,
        select="SELECT CASE WHEN kind = 'num' THEN 'cont' ELSE 'cat' END AS part, kind AS dtype, count(*) AS n FROM typed GROUP BY ALL",
    ),
)
def _(spark, sf):
    cat, cont = values.separate_cat_and_cont(T.readings(spark, sf))
    both = cat.withColumn("part", F.lit("cat")).unionByName(cont.withColumn("part", F.lit("cont")))
    return both.groupBy("part", "dtype").agg(F.count("*").alias("n"))


@query("numeric_cast_filter", with_sql("readings", TYPED, select="SELECT seq, x AS value FROM typed WHERE kind = 'num'"))
def _(spark, sf):
    return values.numeric_cast_filter(T.readings(spark, sf)).select("seq", "value")


@query("ec_unit_filter", with_sql("readings", select="SELECT seq, unit FROM readings WHERE unit IN ('kWh', 'm³')"))
def _(spark, sf):
    return T.readings(spark, sf).filter(F.col("unit").isin("kWh", "m³")).select("seq", "unit")


@query("unique_id", with_sql("readings", select=f'SELECT seq, {UNIQUE_ID} AS "uniqueId" FROM readings'))
def _(spark, sf):
    return T.readings(spark, sf).select("seq", ids.unique_id().alias("uniqueId"))


_REST = "regexp_extract({c}, '[^ ]* (.*)', 1)"
_META_ID = (
    "replace(" + _REST.format(c='"equipRef"') + " || ' ' || " + _REST.format(c='"groupRef"') + " || ' ' || \"navName\" || ' ' || "
    + _REST.format(c='"siteRef"') + " || ' ' || \"bmsName\", " + _REST.format(c='"siteRef"') + " || ' ', '')"
)


@query("unique_id_metadata", with_sql("points", select=f'SELECT "lastSynced", {_META_ID} AS "uniqueId" FROM points'))
def _(spark, sf):
    return T.points(spark, sf).select("lastSynced", ids.unique_id_metadata().alias("uniqueId"))


@query("unique_id_flux", with_sql("readings", select=f'SELECT seq, {FLUX_ID} AS "uniqueID" FROM readings'))
def _(spark, sf):
    return T.readings(spark, sf).select("seq", ids.unique_id_flux().alias("uniqueID"))


@query(
    "select_rename_reorder",
    with_sql(
        "training",
        select=f'SELECT {UNIQUE_ID} AS "uniqueId", "isGas" AS gas, "equipRef", "endUseLabel" AS label FROM training',
    ),
)
def _(spark, sf):
    return (
        T.training_labels(spark, sf)
        .withColumn("uniqueId", ids.unique_id())
        .withColumnsRenamed({"isGas": "gas", "endUseLabel": "label"})
        .drop("groupRef", "navName", "siteRef", "typeRef", "unit")
        .select("uniqueId", "gas", "equipRef", "label")
    )


_ALL_METERS = f"""meters AS (SELECT DISTINCT {UNIQUE_ID} AS "uniqueId" FROM readings WHERE unit IN ('kWh', 'm³')),
known AS (SELECT {UNIQUE_ID} AS "uniqueId", "endUseLabel" FROM training),
coded AS (SELECT m."uniqueId", coalesce(k."endUseLabel", '99_UNKNOWN') AS "endUseLabel" FROM meters m LEFT JOIN known k USING ("uniqueId"))"""


def _coded(spark, sf):
    meters = T.readings(spark, sf).filter(F.col("unit").isin("kWh", "m³")).select(ids.unique_id().alias("uniqueId")).distinct()
    known = T.training_labels(spark, sf).select(ids.unique_id().alias("uniqueId"), "endUseLabel")
    return meters.join(known, "uniqueId", "left").withColumn("endUseLabel", flags.label_or_unknown())


@query("null_fill", with_sql("readings", "training", _ALL_METERS, select="SELECT * FROM coded"))
def _(spark, sf):
    return _coded(spark, sf)


@query(
    "label_code",
    with_sql("readings", "training", _ALL_METERS,
             select='SELECT "uniqueId", CAST(substr("endUseLabel", 1, 2) AS INTEGER) AS code FROM coded'),
)
def _(spark, sf):
    return _coded(spark, sf).select("uniqueId", flags.label_code().alias("code"))


@query(
    "label_decode",
    with_sql("readings", "training", _ALL_METERS, select='SELECT "uniqueId", "endUseLabel" FROM coded'),
)
def _(spark, sf):
    coded = _coded(spark, sf).withColumn("code", flags.label_code())
    names = coded.select("code", "endUseLabel").distinct()
    return coded.select("uniqueId", "code").join(names, "code").select("uniqueId", "endUseLabel")


@query(
    "train_predict_split",
    with_sql(
        "readings",
        "training",
        _ALL_METERS,
        select="""SELECT CASE WHEN "endUseLabel" = '99_UNKNOWN' THEN 'predict' ELSE 'train' END AS part, count(*) AS n FROM coded GROUP BY 1""",
    ),
)
def _(spark, sf):
    train, predict = flags.train_predict_split(_coded(spark, sf).withColumn("code", flags.label_code()))
    both = train.withColumn("part", F.lit("train")).unionByName(predict.withColumn("part", F.lit("predict")))
    return both.groupBy("part").agg(F.count("*").alias("n"))


# --- one site and a range of days, from readings stored by day -----------------------------

_SITE, _START, _END = "Site 2", "2024-01-08", "2024-01-14"
_IN_DAYS = f"\"siteRef\" = '{_SITE}' AND datetime > TIMESTAMP '{_START} 00:00:00' AND datetime < TIMESTAMP '{_END} 23:59:59'"
_IN_TIMES = f"\"siteRef\" = '{_SITE}' AND datetime >= TIMESTAMP '{_START}' AND datetime < TIMESTAMP '{_END}'"


def stored_range(spark, sf):
    """Readings of the days of the range; the others' folders are pruned."""
    path = scratch_path(spark, "by-day")
    R.write_readings_by_day(T.readings(spark, sf), path)
    return R.read_stored_days(spark, path, _START, _END).drop("date")


@query("scan_ec_range", with_sql("readings", select=f"SELECT seq, {_RCOLS} FROM readings WHERE {IS_EC} AND {_IN_DAYS}"))
def _(spark, sf):
    return R.scan_ec(stored_range(spark, sf), _SITE, _START, _END).select("seq", *READING_COLUMNS)


@query("scan_nc_range", with_sql("readings", select=f"SELECT seq, {_RCOLS} FROM readings WHERE NOT {IS_EC} AND {_IN_DAYS}"))
def _(spark, sf):
    return R.scan_nc(stored_range(spark, sf), _SITE, _START, _END).select("seq", *READING_COLUMNS)


@query("scan_numeric_range_days", with_sql("readings", select=f"SELECT seq, {_RCOLS} FROM readings WHERE {PLAIN} AND {_IN_TIMES}"))
def _(spark, sf):
    return R.scan_numeric_range(stored_range(spark, sf), _SITE, _START, _END).select("seq", *READING_COLUMNS)


@query("site_list_since", with_sql("readings", select=f"SELECT DISTINCT \"siteRef\" FROM readings WHERE datetime >= TIMESTAMP '{_START}'"))
def _(spark, sf):
    path = scratch_path(spark, "by-day")
    R.write_readings_by_day(T.readings(spark, sf), path)
    return R.site_list(R.read_stored_days(spark, path, _START), _START)


@query("site_list", with_sql("readings", select='SELECT DISTINCT "siteRef" FROM readings'))
def _(spark, sf):
    return R.site_list(T.readings(spark, sf))


_FLAG_SQL = ", ".join(f"CASE WHEN {c} = '✓' THEN 'yes_{c}' ELSE 'no_{c}' END AS {c}" for c in flags.FLAG_COLUMNS)


@query("checkmark_flags", with_sql("points", select=f'SELECT "equipRef", "navName", "lastSynced", {_FLAG_SQL} FROM points'))
def _(spark, sf):
    return flags.checkmark_flags(T.points(spark, sf)).select("equipRef", "navName", "lastSynced", *flags.FLAG_COLUMNS)


@query(
    "checkmark_to_int",
    with_sql(
        "points",
        select="SELECT * REPLACE ("
        + ", ".join(f"CASE WHEN {c} = '✓' THEN 1 ELSE 0 END AS {c}" for c in flags.FLAG_COLUMNS)
        + ") FROM points",
    ),
)
def _(spark, sf):
    return flags.checkmark_to_int(T.points(spark, sf))


@query("unit_omit", with_sql("points", select="SELECT \"equipRef\", \"navName\", \"lastSynced\", CASE WHEN unit = '_' THEN 'omit' ELSE unit END AS unit FROM points"))
def _(spark, sf):
    return T.points(spark, sf).select("equipRef", "navName", "lastSynced", flags.unit_omit().alias("unit"))


@query("is_gas_clean", with_sql("training", select="SELECT \"equipRef\", \"navName\", CASE WHEN \"isGas\" IN ('?', '0') THEN 'no_gas' ELSE 'yes_gas' END AS \"isGas\" FROM training"))
def _(spark, sf):
    return T.training_labels(spark, sf).select("equipRef", "navName", flags.is_gas_clean().alias("isGas"))


# --- rule tables ------------------------------------------------------------------------


@query("fix_unit", with_sql("readings", select=f"SELECT seq, {unit_case()} AS unit FROM readings"))
def _(spark, sf):
    return T.readings(spark, sf).select("seq", rules.fix_unit().alias("unit"))


_SEVERAL = f"""keyed AS (SELECT *, {UNIQUE_ID} AS "uniqueId" FROM readings),
several AS (SELECT "uniqueId" FROM keyed GROUP BY 1 HAVING count(DISTINCT coalesce(unit, chr(1))) > 1)"""


@query(
    "correct_units",
    with_sql(
        "readings",
        _SEVERAL,
        select=f"""SELECT seq, CASE WHEN "uniqueId" IN (SELECT * FROM several) THEN {unit_case()} ELSE unit END AS unit FROM keyed""",
    ),
)
def _(spark, sf):
    keyed = T.readings(spark, sf).withColumn("uniqueId", ids.unique_id())
    return rules.correct_units(keyed).select("seq", "unit")


@query(
    "semi_problem_sensors",
    with_sql("readings", _SEVERAL, select='SELECT seq FROM keyed WHERE "uniqueId" IN (SELECT * FROM several)'),
)
def _(spark, sf):
    keyed = T.readings(spark, sf).withColumn("uniqueId", ids.unique_id())
    return rules.problem_readings(keyed).select("seq")


@query(
    "equip_label",
    with_sql("readings", select=f'SELECT DISTINCT "equipRef", {equip_case()} AS label FROM readings'),
)
def _(spark, sf):
    return T.readings(spark, sf).select("equipRef", rules.equip_label().alias("label")).distinct()


@query("nav_label", with_sql("readings", select=f'SELECT "navName", {nav_case()} AS label, count(*) AS n FROM readings GROUP BY ALL'))
def _(spark, sf):
    return T.readings(spark, sf).groupBy("navName", rules.nav_label().alias("label")).agg(F.count("*").alias("n"))


@query(
    "one_hot_fixed",
    with_sql(
        "points",
        f"""flagged AS (SELECT "navName" AS nav, "equipRef" AS equip, "lastSynced", {_FLAG_SQL},
          {equip_case()} AS "equipRef", {nav_case()} AS "navName" FROM points)""",
        select='SELECT nav, equip, "lastSynced", '
        + ", ".join(
            f"CASE WHEN \"{src}\" = '{cat}' THEN 1 ELSE 0 END AS \"{name}\"" for name, src, cat in flags.SELECTED_ONE_HOT
        )
        + " FROM flagged",
    ),
)
def _(spark, sf):
    df = flags.checkmark_flags(T.points(spark, sf)).select(
        F.col("navName").alias("nav"),
        F.col("equipRef").alias("equip"),
        "lastSynced",
        "energy",
        "sensor",
        rules.equip_label().alias("equipRef"),
        rules.nav_label().alias("navName"),
    )
    return flags.one_hot_fixed(df).select("nav", "equip", "lastSynced", *[n for n, _, _ in flags.SELECTED_ONE_HOT])


# --- keep-one, duplicates, set operations -----------------------------------------------


@query(
    "latest_per_key",
    with_sql(
        "points",
        f"""ranked AS (SELECT {_META_ID} AS "uniqueId", "lastSynced", kind, row_number() OVER (PARTITION BY {_META_ID}
          ORDER BY "lastSynced" DESC NULLS FIRST, kind DESC) AS rn FROM points)""",
        select='SELECT "uniqueId", "lastSynced", kind FROM ranked WHERE rn = 1',
    ),
)
def _(spark, sf):
    df = T.points(spark, sf).select(ids.unique_id_metadata().alias("uniqueId"), "lastSynced", "kind")
    return dedupe.latest_per_key(df, ["uniqueId"], "lastSynced")


@query(
    "first_per_key",
    with_sql(
        "readings",
        select=f"SELECT {TAGS}, seq, value FROM readings QUALIFY row_number() OVER (PARTITION BY {TAGS} ORDER BY datetime, seq) = 1",
    ),
)
def _(spark, sf):
    df = T.readings(spark, sf).select(*SENSOR_TAGS, "datetime", "seq", "value")
    return dedupe.first_per_key(df, SENSOR_TAGS, ["datetime", "seq"]).drop("datetime")


@query(
    "flag_duplicates",
    with_sql("points", select='SELECT "equipRef", "navName", "lastSynced", count(*) OVER (PARTITION BY "equipRef", "lastSynced") > 1 AS duplicated FROM points'),
)
def _(spark, sf):
    df = T.points(spark, sf).select("equipRef", "navName", "lastSynced")
    return dedupe.flag_duplicates(df, ["equipRef", "lastSynced"])


@query("distinct_rows", with_sql("points", select="SELECT DISTINCT \"equipRef\", kind, unit FROM points"))
def _(spark, sf):
    return dedupe.distinct_rows(T.points(spark, sf).select("equipRef", "kind", "unit"))


@query("distinct_sensors", with_sql("readings", TYPED, EC, select='SELECT DISTINCT "uniqueId" FROM ec'))
def _(spark, sf):
    return R.scan_ec(T.readings(spark, sf)).select(ids.unique_id().alias("uniqueId")).distinct()


@query(
    "union_labels",
    with_sql(
        "training",
        "enduse",
        select=f"""SELECT {UNIQUE_ID} AS "uniqueId", "endUseLabel" FROM training UNION ALL SELECT "uniqueID", "endUseLabel" FROM enduse""",
    ),
)
def _(spark, sf):
    a = T.training_labels(spark, sf).select(ids.unique_id().alias("uniqueId"), "endUseLabel")
    return a.unionByName(T.end_use_labels(spark, sf).withColumnRenamed("uniqueID", "uniqueId"))


@query(
    "union_fixed_units",
    with_sql(
        "readings",
        _SEVERAL,
        select=f"""SELECT seq, {unit_case()} AS unit FROM keyed WHERE "uniqueId" IN (SELECT * FROM several)
UNION ALL SELECT seq, unit FROM keyed WHERE "uniqueId" NOT IN (SELECT * FROM several)""",
    ),
)
def _(spark, sf):
    keyed = T.readings(spark, sf).withColumn("uniqueId", ids.unique_id())
    return rules.correct_units(keyed).select("seq", "unit")


# --- metadata field study ----------------------------------------------------------------


def _buildings(spark, sf):
    """Tables of different columns in the place of building exports; ``part`` has a column it never fills."""
    text = lambda c: F.col(c).cast("string")
    return {
        "supplier": T.load(spark, sf, "supplier").select(F.col("s_name").alias("name"), text("s_nationkey").alias("nation"), F.format_string("%.2f", "s_acctbal").alias("balance")),
        "customer": T.load(spark, sf, "customer").select(F.col("c_name").alias("name"), text("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")),
        "part": T.load(spark, sf, "part").select(F.col("p_name").alias("name"), text("p_size").alias("size"), F.lit(None).cast("string").alias("segment")),
        "nation": T.load(spark, sf, "nation").select(F.col("n_name").alias("name"), text("n_nationkey").alias("nation")),
    }


def _exports(spark, sf):
    """One folder of CSV exports per building, each with its own header."""
    folder = scratch_path(spark, "exports")
    for name, df in _buildings(spark, sf).items():
        df.write.option("header", True).csv(f"{folder}/{name}")
    return folder


@query(
    "scan_many_union",
    """SELECT 'supplier' AS building, s_name AS name, s_nationkey::VARCHAR AS nation, printf('%.2f', s_acctbal) AS balance, NULL::VARCHAR AS segment, NULL::VARCHAR AS size FROM supplier
UNION ALL SELECT 'customer', c_name, c_nationkey::VARCHAR, NULL, c_mktsegment, NULL FROM customer
UNION ALL SELECT 'part', p_name, NULL, NULL, NULL, p_size::VARCHAR FROM part
UNION ALL SELECT 'nation', n_name, n_nationkey::VARCHAR, NULL, NULL, NULL FROM nation""",
)
def _(spark, sf):
    return M.scan_many(spark, _exports(spark, sf))


_HEADERS = """heads AS (SELECT * FROM (VALUES ('supplier', ['name', 'nation', 'balance']), ('customer', ['name', 'nation', 'segment']),
  ('part', ['name', 'size', 'segment']), ('nation', ['name', 'nation'])) AS t(building, fields)),
occ AS (SELECT field, count(*) AS count FROM (SELECT building, unnest(list_append(fields, 'TOTAL_BUILDINGS')) AS field FROM heads
  WHERE building <> 'part' OR (SELECT count(*) FROM part) > 0) GROUP BY 1)"""


@query("column_occurrence", with_sql(_HEADERS, select="SELECT field, count FROM occ"))
def _(spark, sf):
    return M.column_occurrence(spark, M.headers(spark, _exports(spark, sf)))


_COMMON = """SELECT field, count FROM occ WHERE field <> 'TOTAL_BUILDINGS'
AND count >= floor(0.75 * (SELECT count FROM occ WHERE field = 'TOTAL_BUILDINGS'))"""


@query("common_fields", with_sql(_HEADERS, select=_COMMON))
def _(spark, sf):
    return M.common_fields(M.column_occurrence(spark, M.headers(spark, _exports(spark, sf))), share=0.75)


@query("common_fields_pivot", with_sql(_HEADERS, select=_COMMON.replace("0.75", "0.5") + " AND field IN ('name', 'size', 'segment')"))
def _(spark, sf):
    heads = M.headers(spark, _exports(spark, sf))
    return M.common_fields(M.column_occurrence(spark, heads), share=0.5, pivot_fields=heads["part"])


_USE = """buildings AS (SELECT 'supplier' AS b, s_name AS name, s_nationkey AS nation, s_acctbal AS balance, NULL AS segment, NULL AS size FROM supplier
UNION ALL SELECT 'customer', c_name, c_nationkey, NULL, c_mktsegment, NULL FROM customer
UNION ALL SELECT 'part', p_name, NULL, NULL, NULL, p_size FROM part
UNION ALL SELECT 'nation', n_name, n_nationkey, NULL, NULL, NULL FROM nation)"""


@query(
    "column_use",
    with_sql(_USE, select=" UNION ALL ".join(
        f"SELECT '{c}' AS field, count(DISTINCT b) AS count FROM buildings WHERE {c} IS NOT NULL" for c in ("name", "nation", "balance", "segment", "size")
    ) + " UNION ALL SELECT 'TOTAL_BUILDINGS', count(DISTINCT b) FROM buildings"),
)
def _(spark, sf):
    return M.column_use(M.scan_many(spark, _exports(spark, sf)), "building")


@query(
    "columns_intersect",
    """SELECT s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier UNION ALL SELECT c_name, c_nationkey::VARCHAR FROM customer
UNION ALL SELECT p_name, NULL FROM part UNION ALL SELECT n_name, n_nationkey::VARCHAR FROM nation""",
)
def _(spark, sf):
    return M.combine_common(_buildings(spark, sf), ["name", "nation"])


# --- energy ---------------------------------------------------------------------------------

_METERS = f'meters AS (SELECT "siteRef", {FLUX_ID} AS "uniqueID", datetime, CAST(value AS DOUBLE) AS v FROM readings WHERE {PLAIN})'
_DELTAS = 'deltas AS (SELECT "siteRef", "uniqueID", max(v) - min(v) AS delta FROM meters GROUP BY 1, 2)'


@query(
    "energy_by_end_use",
    with_sql(
        "readings",
        "enduse",
        _METERS,
        _DELTAS,
        select=f"""SELECT "siteRef", "endUseLabel" AS end_use_category, {rs("sum(delta)", 4)} AS energy, count(*) AS meters
FROM deltas JOIN enduse USING ("uniqueID") GROUP BY 1, 2""",
    ),
)
def energy_by_end_use(spark, sf):
    out = energy.energy_by_end_use(T.readings(spark, sf), T.end_use_labels(spark, sf))
    return rounded(out, ["energy"], 4)


_RANGED = _METERS.replace(f"WHERE {PLAIN}", f"WHERE {PLAIN} AND {_IN_TIMES}")


@query(
    "energy_by_end_use_range",
    with_sql(
        "readings",
        "enduse",
        _RANGED,
        _DELTAS,
        select=f"""SELECT "siteRef", "endUseLabel" AS end_use_category, {rs("sum(delta)", 4)} AS energy, count(*) AS meters
FROM deltas JOIN enduse USING ("uniqueID") GROUP BY 1, 2""",
    ),
)
def _(spark, sf):
    """The dashboard's query: always one site and a range of times."""
    labels = T.end_use_labels(spark, sf)
    out = energy.energy_by_end_use(stored_range(spark, sf), labels, site=_SITE, start=_START, end=_END)
    return rounded(out, ["energy"], 4)


@query("meter_delta", with_sql("readings", _METERS, _DELTAS, select=f'SELECT "siteRef", "uniqueID", {rs("delta")} AS delta FROM deltas'))
def _(spark, sf):
    return rounded(energy.meter_delta(energy.meter_readings(T.readings(spark, sf))), ["delta"])


@query(
    "join_min_max",
    with_sql("readings", _METERS, select='SELECT "siteRef", "uniqueID", min(v) AS min_value, max(v) AS max_value FROM meters GROUP BY 1, 2'),
)
def _(spark, sf):
    return energy.min_max_table(energy.meter_readings(T.readings(spark, sf)))


@query(
    "meter_delta_first_last",
    with_sql(
        "readings",
        _METERS,
        select=f'SELECT "siteRef", "uniqueID", {rs("arg_max(v, datetime) - arg_min(v, datetime)")} AS delta FROM meters GROUP BY 1, 2',
    ),
)
def _(spark, sf):
    return rounded(energy.meter_delta_first_last(energy.meter_readings(T.readings(spark, sf))), ["delta"])


@query(
    "join_enduse",
    with_sql(
        "readings",
        "enduse",
        _METERS,
        _DELTAS,
        select=f'SELECT "siteRef", "uniqueID", {rs("delta")} AS delta, "endUseLabel" AS end_use_category FROM deltas JOIN enduse USING ("uniqueID")',
    ),
)
def _(spark, sf):
    deltas = energy.meter_delta(energy.meter_readings(T.readings(spark, sf)))
    return rounded(energy.join_enduse(deltas, T.end_use_labels(spark, sf)), ["delta"])


@query(
    "semi_enduse",
    with_sql(
        "readings",
        "enduse",
        _METERS,
        select='SELECT "siteRef", "uniqueID", datetime, v AS value FROM meters WHERE "uniqueID" IN (SELECT "uniqueID" FROM enduse)',
    ),
)
def _(spark, sf):
    return energy.semi_enduse(energy.meter_readings(T.readings(spark, sf)), T.end_use_labels(spark, sf))


_ROLL = "avg(x)", "min(x)", "max(x)", "count(*)"


@query(
    "rollup_hourly",
    with_sql(
        "readings",
        TYPED,
        select=f"""SELECT {TAGS}, date, CAST(hour AS INTEGER) AS hour, {rs("avg(x)")} AS mean, min(x) AS min, max(x) AS max, count(*) AS count
FROM typed WHERE x IS NOT NULL GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return rounded(energy.rollup_hourly(T.readings(spark, sf), SENSOR_TAGS), ["mean"])


@query(
    "rollup_daily",
    with_sql(
        "readings",
        TYPED,
        select=f"""SELECT {TAGS}, date, {rs("avg(x)")} AS mean, min(x) AS min, max(x) AS max, count(*) AS count
FROM typed WHERE x IS NOT NULL GROUP BY ALL""",
    ),
)
def _(spark, sf):
    return rounded(energy.rollup_daily(T.readings(spark, sf), SENSOR_TAGS), ["mean"])


@query(
    "label_distribution",
    with_sql("enduse", select=f'SELECT "endUseLabel", count(*) AS sensors, {rs("count(*) / sum(count(*)) OVER ()")} AS share FROM enduse GROUP BY 1'),
)
def _(spark, sf):
    return rounded(energy.label_distribution(T.end_use_labels(spark, sf)), ["share"])

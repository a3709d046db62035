"""Named queries: aggregates, folds, cluster hours, joins, encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorloom.functions import flags, ids, rules, values
from sensorloom.operators import aggregate as A
from sensorloom.operators import clusterhours as C
from sensorloom.operators import encode as E
from sensorloom.plans.registry import query, r, rounded, rs, with_sql
from sensorloom.plans.sqltext import (
    EC,
    HOUR,
    KIND,
    NC,
    NUM,
    TAGS,
    TYPED,
    UNIQUE_ID,
    agg_all_sql,
    changes_sql,
    equip_case,
    nav_case,
    stats_sql,
)
from sensorloom.schemas import SENSOR_TAGS, STATS
from sensorloom.scratch import cut_lineage
from sensorloom.sources import metadata as M
from sensorloom.sources import readings as R
from sensorloom.sources import tables as T


def typed(spark, sf):
    return values.split_datetime(T.readings(spark, sf))


def nc(spark, sf):
    return R.scan_nc(typed(spark, sf))


def ec(spark, sf):
    return R.scan_ec(typed(spark, sf)).withColumn("uniqueId", ids.unique_id())


def show(group: str, source: str, stats=STATS, count: str = "count") -> str:
    cols = ", ".join(f"{rs(s)} AS {s}" for s in stats)
    return f"SELECT {group}, {cols}, {count} FROM {source}"


# --- aggregates ---------------------------------------------------------------------------


@query(
    "agg_numeric",
    with_sql("readings", TYPED, f"g AS (SELECT {TAGS}, {stats_sql('x', 'count(x)')} FROM typed WHERE kind = 'num' GROUP BY {TAGS})",
             select=show(TAGS, "g")),
)
def _(spark, sf):
    return rounded(A.agg_numeric(typed(spark, sf), SENSOR_TAGS), STATS)


@query(
    "agg_numeric_how",
    with_sql(
        "readings",
        TYPED,
        select=f"""SELECT "siteRef", unit, hour, {rs("sum(x)", 4)} AS sum, {rs("coalesce(var_samp(x), 0)")} AS var,
count(DISTINCT x) AS nunique, arg_min(x, datetime) AS first, arg_max(x, datetime) AS last, {rs("avg(x)", 8)} AS mean, count(x) AS count
FROM typed WHERE kind = 'num' GROUP BY ALL""",
    ),
)
def _(spark, sf):
    out = A.agg_numeric(typed(spark, sf), ["siteRef", "unit", "hour"], ["sum", "var", "nunique", "first", "last", "mean"])
    return rounded(rounded(rounded(out, ["mean"], 8), ["var"]), ["sum"], 4)


@query(
    "state_changes",
    with_sql("readings", TYPED, changes_sql("ch", "typed", TAGS), select=f"SELECT {TAGS}, kind, change_hour, changes, n AS count FROM ch"),
)
def _(spark, sf):
    return A.state_changes(typed(spark, sf), SENSOR_TAGS, ["bool", "str"])


def _changes_agg(kind: str) -> str:
    return with_sql(
        "readings",
        TYPED,
        changes_sql("ch", "typed", TAGS, f"kind = '{kind}'"),
        f"g AS (SELECT {TAGS}, {stats_sql('changes', 'CAST(sum(n) AS BIGINT)')} FROM ch GROUP BY {TAGS})",
        select=show(TAGS, "g"),
    )


@query("agg_bool", _changes_agg("bool"))
def _(spark, sf):
    return rounded(A.agg_bool(typed(spark, sf), SENSOR_TAGS), STATS)


@query("agg_categorical", _changes_agg("str"))
def _(spark, sf):
    return rounded(A.agg_categorical(typed(spark, sf), SENSOR_TAGS), STATS)


@query(
    "union_all_types",
    with_sql("readings", TYPED, agg_all_sql("g", "typed", TAGS), select=show(TAGS, "g_parts")),
)
def _(spark, sf):
    return rounded(A.union_all_types(typed(spark, sf), SENSOR_TAGS).drop("kind"), STATS)


_ALL = with_sql("readings", TYPED, agg_all_sql("g", "typed", TAGS), select=show(TAGS, "g"))


@query("agg_all_long", _ALL)
def agg_all_long(spark, sf):
    return rounded(A.agg_all(typed(spark, sf), SENSOR_TAGS), STATS)


@query(
    "combine_mixed",
    with_sql("readings", TYPED, agg_all_sql("g", "typed", '"siteRef", "navName"'), select=show('"siteRef", "navName"', "g")),
)
def _(spark, sf):
    keys = ["siteRef", "navName"]
    return rounded(A.combine_mixed(A.union_all_types(typed(spark, sf), keys).drop("kind"), keys), STATS)


_TYPES = ["P", "Q"]


def _pivot_sql(source: str, rest: str, last: str, vals, stats=STATS, total=True) -> str:
    cols = ", ".join(
        f"{rs(f'coalesce(max(CASE WHEN {last} = {v!r} THEN {s} END), 0)')} AS \"{s}_{v}\"" for v in vals for s in stats
    )
    count = ", CAST(sum(count) AS BIGINT) AS count" if total else ""
    return f"SELECT {rest}, {cols}{count} FROM {source} GROUP BY {rest}"


_UNITS = ["kWh", "m³", "°C", "%", "_"]


@query(
    "agg_all_pivot",
    with_sql("readings", TYPED, agg_all_sql("g", "typed", '"siteRef", hour, unit'),
             select=_pivot_sql("g", '"siteRef", hour', "unit", _UNITS)),
)
def _(spark, sf):
    keys = ["siteRef", "hour", "unit"]
    out = A.pivot_last(A.agg_all(typed(spark, sf), keys), keys, _UNITS)
    return rounded(out, [f"{s}_{u}" for u in _UNITS for s in STATS])


_HALVES = f"""halves AS (SELECT *, CASE WHEN date < '2024-01-16' THEN 1 ELSE 2 END AS half FROM typed),
{agg_all_sql("p", "halves", TAGS + ", half")}"""
_FOLDED = f"""folded AS (SELECT {TAGS}, {", ".join(f"sum({s} * count) / sum(count) AS {s}" for s in STATS)},
  CAST(sum(count) AS BIGINT) AS count FROM p GROUP BY {TAGS})"""


def _halves(spark, sf):
    df = typed(spark, sf)
    early = F.col("date") < "2024-01-16"
    return [A.agg_all(part, SENSOR_TAGS) for part in (df.filter(early), df.filter(~early))]


@query("append_agg", with_sql("readings", TYPED, _HALVES, _FOLDED, select=show(TAGS, "folded")))
def _(spark, sf):
    return rounded(A.append_agg(*_halves(spark, sf), SENSOR_TAGS), STATS)


@query("join_full_fold", with_sql("readings", TYPED, _HALVES, _FOLDED, select=show(TAGS, "folded")))
def _(spark, sf):
    return rounded(A.join_full_fold(*_halves(spark, sf), SENSOR_TAGS), STATS)


_ONE_SHOT = with_sql(
    "readings", TYPED, f"g AS (SELECT {TAGS}, {stats_sql('x', 'count(x)')} FROM typed WHERE kind = 'num' GROUP BY {TAGS})",
    select=show(TAGS, "g"),
)


@query("append_agg_exact", _ONE_SHOT)
def _(spark, sf):
    df = typed(spark, sf)
    early = F.col("date") < "2024-01-16"
    parts = [A.numeric_partials(part, SENSOR_TAGS) for part in (df.filter(early), df.filter(~early))]
    return rounded(A.append_agg_exact(parts[0].unionByName(parts[1]), SENSOR_TAGS), STATS)


_DAILY = f"""{agg_all_sql("p", "typed", TAGS + ", date")}"""


@query("daily_fold", with_sql("readings", TYPED, _DAILY, _FOLDED, select=show(TAGS, "folded")))
def daily_fold(spark, sf):
    return rounded(A.daily_fold(typed(spark, sf), SENSOR_TAGS), STATS)


@query("daily_fold_exact", _ONE_SHOT)
def _(spark, sf):
    return rounded(A.daily_fold(typed(spark, sf), SENSOR_TAGS, exact=True), STATS)


_NC_STATS = f"""{agg_all_sql("p", "nc", TAGS + ", date")}, {_FOLDED},
days AS (SELECT count(DISTINCT date) AS days FROM nc),
nc_stats AS (SELECT {TAGS}, mean, std, max, min, count / (days + 1) AS update_rate FROM folded, days)"""


def nc_stats(spark, sf):
    """Daily-folded statistics and update rate of every sensor that is no energy meter."""
    df = nc(spark, sf)
    days = A.days_of(df).scalar()
    return A.update_rate_nc(A.daily_fold(df, SENSOR_TAGS), days)


@query("update_rate_nc", with_sql("readings", TYPED, NC, _NC_STATS, select=f"SELECT {TAGS}, {rs('update_rate')} AS update_rate FROM nc_stats"))
def _(spark, sf):
    return rounded(nc_stats(spark, sf).select(*SENSOR_TAGS, "update_rate"), ["update_rate"])


_EC_STATS = f"""ec_stats AS (SELECT "uniqueId", unit, {stats_sql('x', 'count(x)')} FROM ec WHERE kind = 'num' GROUP BY 1, 2)"""


@query("ec_sensor_stats", with_sql("readings", TYPED, EC, _EC_STATS, select=show('"uniqueId", unit', "ec_stats")))
def _(spark, sf):
    return rounded(A.ec_sensor_stats(ec(spark, sf)), STATS)


@query(
    "update_rate_ec",
    with_sql("readings", TYPED, EC, _EC_STATS, "days AS (SELECT count(DISTINCT date) AS days FROM ec)",
             select=f"""SELECT "uniqueId", unit, {rs('count / ((days + 1) * 24)')} AS update_rate FROM ec_stats, days"""),
)
def _(spark, sf):
    df = ec(spark, sf)
    out = A.update_rate_ec(A.ec_sensor_stats(df), A.days_of(df).scalar())
    return rounded(out.select("uniqueId", "unit", "update_rate"), ["update_rate"])


@query(
    "ec_hourly_mean",
    with_sql("readings", TYPED, EC,
             select=f"""SELECT "uniqueId", date, hour, unit, {rs('avg(x)')} AS "EC_mean_value", count(x) AS count FROM ec WHERE kind = 'num' GROUP BY ALL"""),
)
def _(spark, sf):
    return rounded(A.ec_hourly_mean(ec(spark, sf)), ["EC_mean_value"])


# --- cluster hours ------------------------------------------------------------------------

# A stand-in assignment: one cluster per length of the point name.
_CLUSTERS = list(range(4))
_ASSIGN = f"""assignment AS (SELECT DISTINCT {TAGS}, CAST(length("navName") % 4 AS INTEGER) AS cluster FROM nc),
placed AS (SELECT nc.*, cluster FROM nc JOIN assignment USING ({TAGS}))"""


def assignment(spark, sf):
    return nc(spark, sf).select(*SENSOR_TAGS, (F.length("navName") % 4).alias("cluster")).distinct()


def placed(spark, sf):
    return C.join_readings_cluster(nc(spark, sf), assignment(spark, sf))


def hours_and_clusters(spark, sf):
    return C.sensor_hours(nc(spark, sf)), cut_lineage(assignment(spark, sf), "assignment")


@query("join_readings_cluster", with_sql("readings", TYPED, NC, _ASSIGN, select="SELECT seq, cluster FROM placed"))
def _(spark, sf):
    return placed(spark, sf).select("seq", "cluster")


@query("cluster_assignment", with_sql("readings", TYPED, NC, _ASSIGN, select=f"SELECT {TAGS}, cluster FROM assignment"))
def _(spark, sf):
    return assignment(spark, sf)


_SENSOR_CH = f"""{changes_sql("s_ch", "placed", "hour, date, cluster, " + TAGS)},
g_parts AS (SELECT hour, date, cluster, {stats_sql('x', 'count(x)')} FROM placed WHERE kind = 'num' GROUP BY hour, date, cluster
  UNION ALL SELECT hour, date, cluster, {stats_sql('changes', 'CAST(sum(n) AS BIGINT)')} FROM (
    SELECT hour, date, cluster, kind, change_hour, sum(changes) AS changes, sum(n) AS n FROM s_ch GROUP BY ALL)
  GROUP BY hour, date, cluster, kind),
g AS (SELECT hour, date, cluster, sum(mean * count) / sum(count) AS mean, sum(std * count) / sum(count) AS std,
  CAST(max(max) AS DOUBLE) AS max, CAST(min(min) AS DOUBLE) AS min, CAST(sum(count) AS BIGINT) AS count
  FROM g_parts GROUP BY hour, date, cluster)"""


@query(
    "cluster_hourly_wide",
    with_sql("readings", TYPED, NC, _ASSIGN, _SENSOR_CH, select=_pivot_sql("g", "hour, date", "cluster", _CLUSTERS, total=False)),
)
def _(spark, sf):
    out = C.cluster_hourly_wide(C.cluster_hourly_long(*hours_and_clusters(spark, sf)), _CLUSTERS)
    return rounded(out, [f"{s}_{c}" for c in _CLUSTERS for s in STATS])


@query(
    "join_agg_parts",
    with_sql("readings", TYPED, NC, _ASSIGN, agg_all_sql("g", "placed", "hour, date, cluster"), select=show("hour, date, cluster", "g")),
)
def _(spark, sf):
    return rounded(C.cluster_hourly_sequence(placed(spark, sf)), STATS)


_RATES = """counts AS (SELECT hour, date, cluster, count(value) AS updates FROM placed GROUP BY ALL),
sizes AS (SELECT cluster, count(*) AS sensors FROM assignment GROUP BY 1),
rates AS (SELECT hour, date, cluster, updates / sensors AS urate FROM counts JOIN sizes USING (cluster))"""


@query("cluster_update_counts", with_sql("readings", TYPED, NC, _ASSIGN, _RATES, select="SELECT * FROM counts"))
def _(spark, sf):
    return C.cluster_update_counts(*hours_and_clusters(spark, sf))


@query("sensors_per_cluster", with_sql("readings", TYPED, NC, _ASSIGN, _RATES, select="SELECT * FROM sizes"))
def _(spark, sf):
    return C.sensors_per_cluster(assignment(spark, sf))


def rates_wide(hours, clusters):
    counts = C.cluster_update_counts(hours, clusters)
    return C.cluster_update_rate_wide(C.cluster_update_rate(counts, C.sensors_per_cluster(clusters)), _CLUSTERS)


_RATES_WIDE = "SELECT hour, date, " + ", ".join(
    f"{rs(f'coalesce(max(CASE WHEN cluster = {c} THEN urate END), 0)')} AS urate_{c}" for c in _CLUSTERS
) + " FROM rates GROUP BY hour, date"


@query("cluster_update_rate_wide", with_sql("readings", TYPED, NC, _ASSIGN, _RATES, select=_RATES_WIDE))
def _(spark, sf):
    return rounded(rates_wide(*hours_and_clusters(spark, sf)), [f"urate_{c}" for c in _CLUSTERS])


@query(
    "join_update_rates",
    with_sql(
        "readings", TYPED, NC, _ASSIGN, _SENSOR_CH, _RATES,
        f"""wide AS ({_pivot_sql("g", "hour, date", "cluster", _CLUSTERS, total=False)}), rw AS ({_RATES_WIDE})""",
        select="SELECT wide.*, " + ", ".join(f"coalesce(urate_{c}, 0.0) AS urate_{c}" for c in _CLUSTERS) + " FROM wide LEFT JOIN rw USING (hour, date)",
    ),
)
def _(spark, sf):
    hours, clusters = hours_and_clusters(spark, sf)
    wide = C.cluster_hourly_wide(C.cluster_hourly_long(hours, clusters), _CLUSTERS)
    return rounded(C.join_update_rates(wide, rates_wide(hours, clusters)), C.feature_columns(_CLUSTERS))


# --- joins of step tables -------------------------------------------------------------------

_META = f"""md AS (SELECT replace(regexp_extract("equipRef", '[^ ]* (.*)', 1) || ' ' || regexp_extract("groupRef", '[^ ]* (.*)', 1)
  || ' ' || "navName" || ' ' || regexp_extract("siteRef", '[^ ]* (.*)', 1) || ' ' || "bmsName",
  regexp_extract("siteRef", '[^ ]* (.*)', 1) || ' ', '') AS "uniqueId", * EXCLUDE (unit), unit AS md_unit_raw FROM points),
meta AS (SELECT DISTINCT "uniqueId", kind AS kind_md, {", ".join(f"CASE WHEN {c} = '✓' THEN 'yes_{c}' ELSE 'no_{c}' END AS {c}" for c in flags.FLAG_COLUMNS)},
  CASE WHEN md_unit_raw = '_' THEN 'omit' ELSE md_unit_raw END AS md_unit FROM md)"""


@query(
    "join_metadata",
    with_sql("readings", "points", TYPED, EC, _EC_STATS, _META,
             select=f"""SELECT "uniqueId", unit AS ec_unit, {rs('mean')} AS mean, kind_md AS kind, energy, power, sensor, water, md_unit
FROM ec_stats LEFT JOIN meta USING ("uniqueId")"""),
)
def _(spark, sf):
    stats = A.ec_sensor_stats(ec(spark, sf)).withColumnRenamed("unit", "ec_unit").select("uniqueId", "ec_unit", "mean")
    meta = M.point_metadata(T.points(spark, sf)).withColumnRenamed("unit", "md_unit")
    return rounded(stats.join(meta, "uniqueId", "left"), ["mean"])


_LABELLED = f"""lab AS (SELECT DISTINCT {UNIQUE_ID} AS "uniqueId", "isGas", "endUseLabel" FROM training)"""


@query(
    "join_labels",
    with_sql("readings", "training", TYPED, EC, _EC_STATS, _LABELLED,
             select=f"""SELECT "uniqueId", unit, {rs('mean')} AS mean, "isGas", "endUseLabel" FROM ec_stats LEFT JOIN lab USING ("uniqueId")"""),
)
def _(spark, sf):
    stats = A.ec_sensor_stats(ec(spark, sf)).select("uniqueId", "unit", "mean")
    labels = T.training_labels(spark, sf).select(ids.unique_id().alias("uniqueId"), "isGas", "endUseLabel").distinct()
    return rounded(stats.join(labels, "uniqueId", "left"), ["mean"])


# --- encoders -----------------------------------------------------------------------------------


def _minmax(c: str, source: str) -> str:
    return (
        f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.0 ELSE ({c} - min({c}) OVER ()) / "
        f"(max({c}) OVER () - min({c}) OVER ()) END"
    )


_SCALED = [*STATS, "update_rate"]


@query(
    "min_max_scale",
    with_sql("readings", TYPED, NC, _NC_STATS,
             select=f"SELECT {TAGS}, " + ", ".join(f"{rs(_minmax(c, 'nc_stats'))} AS {c}" for c in _SCALED) + " FROM nc_stats"),
)
def _(spark, sf):
    # Bounds and rows both read the statistics, so they are computed once and stored.
    return rounded(E.min_max_scale(cut_lineage(nc_stats(spark, sf), "stats"), _SCALED), _SCALED)


@query(
    "standard_scale",
    with_sql(
        """train AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0)""",
        select=f"""SELECT o_orderkey, {rs('(o_totalprice - (SELECT avg(o_totalprice) FROM train)) / (SELECT stddev_pop(o_totalprice) FROM train)')} AS o_totalprice FROM orders""",
    ),
)
def _(spark, sf):
    df = T.load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(E.standard_scale(df.filter("o_orderkey % 5 <> 0"), df, ["o_totalprice"]), ["o_totalprice"])


_CODES = """codes AS (SELECT {c}, row_number() OVER (ORDER BY min(datetime), min(seq)) - 1 AS code FROM {t} GROUP BY {c})"""


@query("first_appearance_code", with_sql("readings", _CODES.format(c='"equipRef"', t="readings"), select='SELECT "equipRef", code FROM codes'))
def _(spark, sf):
    return E.first_appearance_code(T.readings(spark, sf), "equipRef")


@query(
    "one_hot",
    with_sql("readings", _CODES.format(c='"siteRef"', t="readings"),
             select="SELECT seq, " + ", ".join(f"CAST(code = {i} AS INTEGER) AS \"siteRef_{i}\"" for i in range(5)) + ' FROM readings JOIN codes USING ("siteRef")'),
)
def _(spark, sf):
    out = E.one_hot(T.readings(spark, sf), "siteRef")
    return out.select("seq", *[c for c in out.columns if c.startswith("siteRef_")])


@query(
    "one_hot_sparse",
    with_sql(
        "readings",
        """firsts AS (SELECT "equipRef" AS e, row_number() OVER (ORDER BY min(struct_pack(t := datetime, s := seq))) - 1 AS code, count(*) OVER () AS width
  FROM readings GROUP BY 1)""",
        select='SELECT seq, code, width FROM readings JOIN firsts ON "equipRef" = e',
    ),
)
def _(spark, sf):
    return E.one_hot_sparse(T.readings(spark, sf), "equipRef").select("seq", "code", "width")


@query(
    "encode_units",
    with_sql("readings", _CODES.format(c="unit", t="readings"),
             select="SELECT seq, unit, " + ", ".join(f"CAST(code = {i} AS INTEGER) AS unit_{i}" for i in range(5)) + " FROM readings JOIN codes USING (unit)"),
)
def _(spark, sf):
    out = E.encode_units(T.readings(spark, sf))
    return out.select("seq", "unit", *[c for c in out.columns if c.startswith("unit_")])


@query(
    "encode_units_sparse",
    with_sql("readings", _CODES.format(c="unit", t="readings"), "width AS (SELECT count(*) AS unit_width FROM codes)",
             select="SELECT seq, unit, code AS unit_code, unit_width FROM readings JOIN codes USING (unit), width"),
)
def _(spark, sf):
    return E.encode_units_sparse(T.readings(spark, sf)).select("seq", "unit", "unit_code", "unit_width")


@query(
    "encode_and_scale_values_sparse",
    with_sql(
        "readings", TYPED, "other AS (SELECT * FROM typed WHERE kind <> 'num')", _CODES.format(c="value", t="other"),
        "width AS (SELECT count(*) AS cv_width FROM codes)",
        select=f"SELECT seq, {rs('coalesce((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 0)')} AS sc_0, "
        "code AS cv_code, cv_width FROM typed LEFT JOIN codes USING (value), width",
    ),
)
def _(spark, sf):
    out = E.encode_and_scale_values_sparse(T.readings(spark, sf))
    return rounded(out.select("seq", "sc_0", "cv_code", "cv_width"), ["sc_0"])


@query(
    "encode_and_scale_values",
    with_sql(
        "readings", TYPED, "other AS (SELECT * FROM typed WHERE kind <> 'num')", _CODES.format(c="value", t="other"),
        select=f"SELECT seq, {rs('coalesce((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 0)')} AS sc_0, "
        + ", ".join(f"CASE WHEN code = {i} THEN 1 ELSE 0 END AS cv_{i}" for i in range(7))
        + " FROM typed LEFT JOIN codes USING (value)",
    ),
)
def _(spark, sf):
    out = E.encode_and_scale_values(T.readings(spark, sf))
    return rounded(out.select("seq", "sc_0", *[c for c in out.columns if c.startswith("cv_")]), ["sc_0"])


@query("label_encode", with_sql("enduse", select='SELECT "uniqueID", CAST(dense_rank() OVER (ORDER BY "endUseLabel") - 1 AS INTEGER) AS label_index FROM enduse'))
def _(spark, sf):
    return E.label_encode(T.end_use_labels(spark, sf), "endUseLabel").select("uniqueID", "label_index")


_HASH = "(('0x' || substr(md5(CAST({k} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT / 4294967296.0)"


@query(
    "train_test_split",
    f"SELECT vec_id, CASE WHEN {_HASH.format(k='vec_id', seed=1)} < 0.33 THEN 'test' ELSE 'train' END AS part FROM embeddings",
)
def _(spark, sf):
    train, test = E.train_test_split(T.load(spark, sf, "embeddings").select("vec_id"), "vec_id", 0.33, seed=1)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "stratified_kfold",
    f"""SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY floor({_HASH.format(k='vec_id', seed=0)} * 256), vec_id) - 1) % 2 AS INTEGER) AS fold
FROM embeddings""",
)
def _(spark, sf):
    return E.stratified_folds(T.load(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id", 2)


@query(
    "sort_by_time",
    with_sql("readings", select=f"SELECT seq, lag(seq) OVER (PARTITION BY {TAGS} ORDER BY datetime, seq) AS previous FROM readings"),
)
def _(spark, sf):
    return A.previous_value(T.readings(spark, sf), SENSOR_TAGS, "seq").select("seq", "previous")


@query(
    "agg_numeric_median",
    with_sql("readings", TYPED, select=f"""SELECT "siteRef", unit, {rs("median(x)")} AS median, count(x) AS count FROM typed WHERE kind = 'num' GROUP BY ALL"""),
)
def _(spark, sf):
    return rounded(A.agg_numeric(typed(spark, sf), ["siteRef", "unit"], "median"), ["median"])

"""Named queries: regression, feature selection, classification, streaming."""

from __future__ import annotations

import datetime

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sensorloom.functions import flags, ids, rules
from sensorloom.operators import aggregate as A
from sensorloom.operators import classify as K
from sensorloom.operators import encode as E
from sensorloom.operators import metrics as Q
from sensorloom.operators import regress as G
from sensorloom.operators import select as S
from sensorloom.plans import label_unknown as LU
from sensorloom.plans.aggregate_queries import _EC_STATS, _HASH, _LABELLED, _META, ec, typed
from sensorloom.plans.registry import query, r, rounded, rs, with_sql
from sensorloom.plans.sqltext import EC, NC, TAGS, TYPED, UNIQUE_ID, equip_case, nav_case, stats_sql
from sensorloom.schemas import SENSOR_TAGS, STATS
from sensorloom.scratch import cut_lineage, scratch_path
from sensorloom.sources import metadata as M
from sensorloom.sources import readings as R
from sensorloom.sources import tables as T
from sensorloom.streaming import rollup as SR

# --- regression on hourly statistics of all other sensors ---------------------------------

_HOURS = f"""hf AS (SELECT date, hour, round(avg(x), 6) AS f1, round(max(x), 6) AS f2 FROM nc WHERE kind = 'num' GROUP BY 1, 2),
eh AS (SELECT "uniqueId", date, hour, avg(x) AS y FROM ec WHERE kind = 'num' GROUP BY "uniqueId", date, hour, unit),
xy AS (SELECT "uniqueId", date, hour, y, f1, f2 FROM eh JOIN hf USING (date, hour))"""
_REG = ("readings", TYPED, EC, NC, _HOURS)


def regression_parts(spark, sf, columns=("f1", "f2")):
    """Hours of the meters, and the features of each hour."""
    nc = R.scan_nc(typed(spark, sf))
    stats = A.agg_numeric(nc, ["date", "hour"], ["mean", "max"])
    features = stats.select("date", "hour", F.round("mean", 6).alias("f1"), F.round("max", 6).alias("f2"))
    hours = cut_lineage(G.hour_features(features, list(columns)), "hours")
    return G.meter_hours(A.ec_hourly_mean(ec(spark, sf))), hours


def hour_rows(spark, sf):
    meters, hours = regression_parts(spark, sf)
    return meters.join(hours, ["date", "hour"])


def models(spark, sf):
    return G.ridge_fit(*regression_parts(spark, sf))


@query("join_ec_nc", with_sql(*_REG, select=f'SELECT "uniqueId", date, hour, {rs("y")} AS y, {rs("f1")} AS f1, {rs("f2")} AS f2 FROM xy'))
def _(spark, sf):
    nc = A.agg_numeric(R.scan_nc(typed(spark, sf)), ["date", "hour"], ["mean", "max"])
    features = nc.select("date", "hour", F.round("mean", 6).alias("f1"), F.round("max", 6).alias("f2"))
    rows = G.join_ec_nc(A.ec_hourly_mean(ec(spark, sf)), features, ["f1", "f2"])
    return rows.select("uniqueId", "date", "hour", r("y").alias("y"), r(F.col("x")[0]).alias("f1"), r(F.col("x")[1]).alias("f2"))


_ALPHA_LIST = "[" + ", ".join(repr(a) for a in G.ALPHAS) + "]"


_CHOSEN = f"""c AS (SELECT "uniqueId", y - avg(y) OVER w AS yc, f1 - avg(f1) OVER w AS x1, f2 - avg(f2) OVER w AS x2, count(*) OVER w AS n
  FROM xy WINDOW w AS (PARTITION BY "uniqueId")),
turn AS (SELECT "uniqueId" AS m, 0.5 * atan2(2 * sum(x1 * x2), sum(x1 * x1) - sum(x2 * x2)) AS t FROM c GROUP BY 1),
zr AS (SELECT c.*, x1 * cos(t) + x2 * sin(t) AS z1, x2 * cos(t) - x1 * sin(t) AS z2 FROM c JOIN turn ON c."uniqueId" = turn.m),
s AS (SELECT *, sum(z1 * z1) OVER w AS l1, sum(z2 * z2) OVER w AS l2, sum(z1 * yc) OVER w AS q1, sum(z2 * yc) OVER w AS q2
  FROM zr WINDOW w AS (PARTITION BY "uniqueId")),
al AS (SELECT unnest({_ALPHA_LIST})::DOUBLE AS alpha),
u AS (SELECT "uniqueId", alpha, yc - z1 * q1 / (l1 + alpha) - z2 * q2 / (l2 + alpha) AS e,
  1 - (1.0 / n + z1 * z1 / (l1 + alpha) + z2 * z2 / (l2 + alpha)) AS free FROM s, al),
e AS (SELECT "uniqueId", alpha, avg(CASE WHEN free > {G.LEAST_FREE} THEN pow(e / free, 2) ELSE 'Infinity'::DOUBLE END) AS loo FROM u GROUP BY 1, 2),
chosen AS (SELECT "uniqueId", min(alpha) AS alpha FROM (SELECT *, min(loo) OVER (PARTITION BY "uniqueId") AS best FROM e)
  WHERE loo <= best * (1 + {G.LOO_TIE}) + 1e-15 GROUP BY 1)"""


@query("ridge_alpha_loo", with_sql(*_REG, _CHOSEN, select='SELECT "uniqueId", alpha FROM chosen'))
def _(spark, sf):
    return models(spark, sf).select("uniqueId", "alpha")


_SOLVED = f"""{_CHOSEN},
m AS (SELECT "uniqueId", avg(y) AS my, avg(f1) AS m1, avg(f2) AS m2, count(*) AS hours FROM xy GROUP BY 1),
g AS (SELECT "uniqueId", any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2, any_value(hours) AS hours,
  sum((f1 - m1) * (f1 - m1)) AS q1, sum((f2 - m2) * (f2 - m2)) AS q2,
  sum((f1 - m1) * (f2 - m2)) AS q12, sum((f1 - m1) * (y - my)) AS p1, sum((f2 - m2) * (y - my)) AS p2
  FROM xy JOIN m USING ("uniqueId") GROUP BY 1),
n AS (SELECT *, CASE WHEN q1 = 0 THEN 1 ELSE sqrt(q1) END AS l1, CASE WHEN q2 = 0 THEN 1 ELSE sqrt(q2) END AS l2 FROM g),
z AS (SELECT *, q1 / (l1 * l1) + alpha AS a11, q2 / (l2 * l2) + alpha AS a22, q12 / (l1 * l2) AS a12, p1 / l1 AS b1, p2 / l2 AS b2
  FROM n JOIN chosen USING ("uniqueId")),
models AS (SELECT *, (a22 * b1 - a12 * b2) / (a11 * a22 - a12 * a12) / l1 AS c1, (a11 * b2 - a12 * b1) / (a11 * a22 - a12 * a12) / l2 AS c2 FROM z)"""


@query(
    "ridge_fit",
    with_sql(*_REG, _SOLVED,
             select=f"""SELECT "uniqueId", {rs('c1')} AS c1, {rs('c2')} AS c2, {rs('my - c1 * m1 - c2 * m2', 5)} AS intercept, hours FROM models"""),
)
def ridge_fit(spark, sf):
    m = models(spark, sf)
    return m.select(
        "uniqueId", r(F.col("coefficients")[0]).alias("c1"), r(F.col("coefficients")[1]).alias("c2"), r("intercept", 5).alias("intercept"), "hours"
    )


_MSE = """mse AS (SELECT "uniqueId", avg(pow(y - (my - c1 * m1 - c2 * m2 + c1 * f1 + c2 * f2), 2)) AS mse FROM xy JOIN models USING ("uniqueId") GROUP BY 1)"""


@query("ridge_mse", with_sql(*_REG, _SOLVED, _MSE, select=f'SELECT "uniqueId", {rs("mse", 4)} AS mse FROM mse'))
def _(spark, sf):
    return rounded(G.ridge_mse(hour_rows(spark, sf), models(spark, sf)), ["mse"], 4)


@query("avg_mse", with_sql(*_REG, _SOLVED, _MSE, select=f"SELECT {rs('avg(mse)', 4)} AS avg_mse FROM mse"))
def _(spark, sf):
    return rounded(G.avg_mse(models(spark, sf)), ["avg_mse"], 4)


@query(
    "coefficient_features",
    with_sql(*_REG, _SOLVED,
             select=f"""SELECT "uniqueId", 0 AS feature, {rs('c1')} AS value FROM models UNION ALL SELECT "uniqueId", 1, {rs('c2')} FROM models"""),
)
def _(spark, sf):
    return rounded(G.coefficient_features(models(spark, sf)), ["value"])


@query(
    "join_coefficients",
    with_sql(*_REG, _EC_STATS, _SOLVED,
             select=f"""SELECT "uniqueId", {rs('mean')} AS mean, {rs('c1')} AS c1, {rs('c2')} AS c2 FROM ec_stats FULL JOIN models USING ("uniqueId")"""),
)
def _(spark, sf):
    stats = A.ec_sensor_stats(ec(spark, sf)).select("uniqueId", "mean")
    both = G.join_coefficients(stats, models(spark, sf))
    return both.select("uniqueId", r("mean").alias("mean"), r(F.col("coefficients")[0]).alias("c1"), r(F.col("coefficients")[1]).alias("c2"))


# --- features of the labelled meters -------------------------------------------------------

_FRAME = f"""lab2 AS (SELECT DISTINCT {UNIQUE_ID} AS "uniqueId", CASE WHEN "isGas" IN ('?', '0') THEN 'no_gas' ELSE 'yes_gas' END AS gas,
  {equip_case()} AS equip, {nav_case()} AS nav, "endUseLabel" FROM training),
frame AS (SELECT s.*, m.energy, m.power, m.sensor, m.water, l.gas, l.equip, l.nav, l."endUseLabel"
  FROM ec_stats s LEFT JOIN meta m USING ("uniqueId") LEFT JOIN lab2 l USING ("uniqueId"))"""
_FRAME_STEPS = ("readings", "points", "training", TYPED, EC, _EC_STATS, _META, _FRAME)
_CATS = ["energy", "power", "sensor", "water", "gas", "equip", "nav"]


def meter_frame(spark, sf):
    stats = A.ec_sensor_stats(ec(spark, sf))
    meta = M.point_metadata(T.points(spark, sf)).drop("unit")
    labels = (
        T.training_labels(spark, sf)
        .select(
            ids.unique_id().alias("uniqueId"),
            flags.is_gas_clean().alias("gas"),
            rules.equip_label().alias("equip"),
            rules.nav_label().alias("nav"),
            "endUseLabel",
        )
        .distinct()
    )
    return stats.join(meta, "uniqueId", "left").join(labels, "uniqueId", "left")


@query(
    "feature_frame",
    with_sql(*_FRAME_STEPS, select=f"""SELECT "uniqueId", unit, {", ".join(_CATS)}, "endUseLabel" FROM frame WHERE "endUseLabel" IS NOT NULL AND unit IN ('kWh', 'm³')"""),
)
def _(spark, sf):
    return S.feature_frame(meter_frame(spark, sf)).select("uniqueId", "unit", *_CATS, "endUseLabel")


_MI = f"""study AS (SELECT * FROM frame WHERE "endUseLabel" IS NOT NULL AND unit IN ('kWh', 'm³')),
long AS ({" UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, \"endUseLabel\" AS y FROM study" for c in _CATS)}),
cells AS (SELECT field, value, y, count(*) AS n11 FROM long GROUP BY ALL),
cat AS (SELECT field, value, sum(n11) AS n1 FROM cells GROUP BY ALL),
cls AS (SELECT "endUseLabel" AS y, count(*) AS nc FROM study GROUP BY 1), tot AS (SELECT count(*) AS n FROM study),
grid AS (SELECT cat.field, cat.value, n1, nc, n, coalesce(n11, 0) AS n11 FROM cat CROSS JOIN cls CROSS JOIN tot
  LEFT JOIN cells ON cells.field = cat.field AND cells.value = cat.value AND cells.y = cls.y),
mi AS (SELECT field, value, sum(CASE WHEN n11 > 0 THEN n11 / n * ln(n11 * n / (n1 * nc)) ELSE 0 END
  + CASE WHEN nc - n11 > 0 THEN (nc - n11) / n * ln((nc - n11) * n / ((n - n1) * nc)) ELSE 0 END) AS score FROM grid GROUP BY ALL)"""


def mutual_information(spark, sf):
    frame = cut_lineage(S.feature_frame(meter_frame(spark, sf)), "frame")
    return S.mutual_information(frame, _CATS, "endUseLabel")


@query("mutual_information", with_sql(*_FRAME_STEPS, _MI, select=f"SELECT field, value, {rs('score')} AS score FROM mi"))
def _(spark, sf):
    return rounded(mutual_information(spark, sf), ["score"])


@query(
    "select_k_best",
    with_sql(*_FRAME_STEPS, _MI, select=f"SELECT field, value, {rs('score')} AS score FROM mi ORDER BY round(score, 6) DESC, field, value LIMIT 6"),
)
def _(spark, sf):
    return S.select_k_best(rounded(mutual_information(spark, sf), ["score"]), 6)


@query(
    "selected_feature_names",
    with_sql(*_FRAME_STEPS, _MI, select=f"SELECT field || '_' || value AS feature, {rs('score')} AS score FROM mi ORDER BY round(score, 6) DESC, field, value LIMIT 6"),
)
def _(spark, sf):
    return S.selected_feature_names(S.select_k_best(rounded(mutual_information(spark, sf), ["score"]), 6))


_NUMS = ["mean", "std", "max", "min"]


@query(
    "anova_f",
    with_sql(
        *_FRAME_STEPS,
        f"""long AS ({" UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS x, \"endUseLabel\" AS y FROM frame WHERE \"endUseLabel\" IS NOT NULL" for c in _NUMS)}),
pc AS (SELECT field, y, count(*) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS v FROM long GROUP BY ALL),
mu AS (SELECT field, sum(n * m) / sum(n) AS mu FROM pc GROUP BY 1)""",
        select=f"""SELECT field, {rs('(sum(n * (m - mu) * (m - mu)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*)))')} AS score
FROM pc JOIN mu USING (field) GROUP BY 1""",
    ),
)
def _(spark, sf):
    return rounded(S.anova_f(S.feature_frame(meter_frame(spark, sf), unit=None), _NUMS, "endUseLabel"), ["score"])


def study(spark, sf):
    """The labelled meters with all numeric columns and a 0/1 column for each category they have."""
    frame = cut_lineage(S.feature_frame(meter_frame(spark, sf)).na.fill("none", _CATS), "study")
    # Flags and rule groups: a fixed, short list of values each.
    found = {c: [v for v in E.categories(frame, c) if v is not None] for c in _CATS}
    hot = {f"{c}={v}": (F.col(c) == v).cast("int") for c, values in found.items() for v in values}
    named = {f"f{i}": column for i, column in enumerate(hot.values())}
    return frame.withColumns(named), list(named), list(hot)


@query("rfecv_linear")
def _(spark, sf):
    """Elimination over all one-hot columns by a linear SVM that converges."""
    frame, columns, _ = study(spark, sf)
    return S.rfecv_linear(frame, columns, "endUseLabel", "uniqueId")


@query("rfecv_forest")
def _(spark, sf):
    """Elimination over all numeric columns by a forest of 100 trees."""
    frame = S.feature_frame(meter_frame(spark, sf), unit=None)
    return S.rfecv(frame, _NUMS, "endUseLabel", "uniqueId", S.forest())


@query("cv_score_table")
def _(spark, sf):
    frame = S.feature_frame(meter_frame(spark, sf), unit=None)
    return S.rfecv(frame, _NUMS, "endUseLabel", "uniqueId", S.forest()).select("num_features", "score")


@query("select_best_count")
def _(spark, sf):
    """As many categories as the elimination found best, chosen by mutual information."""
    frame, columns, _ = study(spark, sf)
    k = S.best_count(S.rfecv_linear(frame, columns, "endUseLabel", "uniqueId"))
    return S.select_k_best(rounded(S.mutual_information(frame, _CATS, "endUseLabel"), ["score"]), k)


# --- classifiers on the embedding table ---------------------------------------------------------


def vectors(spark, sf):
    df = T.load(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("label").cast("double").alias("label"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
    )
    return E.train_test_split(df, "id", 0.2)


_SPLIT = f"""v AS (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(label AS DOUBLE) AS label, CAST(embedding AS DOUBLE[]) AS x,
  {_HASH.format(k='vec_id', seed=0)} < 0.2 AS is_test FROM embeddings),
train AS (SELECT * FROM v WHERE NOT is_test), test AS (SELECT * FROM v WHERE is_test)"""
_KNN = """d AS (SELECT t.id, t.label, r.label AS vote, row_number() OVER (PARTITION BY t.id ORDER BY list_distance(t.x, r.x), r.id) AS rn FROM test t, train r),
votes AS (SELECT id, label, vote, count(*) AS n FROM d WHERE rn <= 5 GROUP BY ALL),
pred AS (SELECT id, any_value(label) AS label, arg_max(vote, n * 1000 - vote) AS prediction,
  coalesce(sum(CASE WHEN vote = label THEN n END), 0) / 5 AS p_true FROM votes GROUP BY id)"""


@query("clf_knn", with_sql(_SPLIT, _KNN, select=f"SELECT id, label, prediction, {rs('p_true')} AS p_true FROM pred"))
def clf_knn(spark, sf):
    return rounded(K.clf_knn(*vectors(spark, sf)), ["p_true"])


_NB = """f AS (SELECT id, label, is_test, unnest(range(1, 65)) AS j, unnest(x) AS v FROM v),
st AS (SELECT label, j, avg(v) AS m, var_pop(v) + 1e-9 * (SELECT max(s) FROM (SELECT var_pop(v) AS s FROM f WHERE NOT is_test GROUP BY j)) AS s
  FROM f WHERE NOT is_test GROUP BY ALL),
pr AS (SELECT label, count(*) / sum(count(*)) OVER () AS p FROM train GROUP BY 1),
ll AS (SELECT f.id, f.label, st.label AS k, ln(any_value(pr.p)) - 0.5 * sum(ln(2 * pi() * s) + (v - m) * (v - m) / s) AS ll
  FROM f JOIN st USING (j) JOIN pr ON pr.label = st.label WHERE f.is_test GROUP BY ALL),
top AS (SELECT *, max(ll) OVER (PARTITION BY id) AS best FROM ll),
pred AS (SELECT id, label, min(CASE WHEN ll = best THEN k END) AS prediction, max(CASE WHEN k = label THEN exp(ll - best) END) / sum(exp(ll - best)) AS p_true
  FROM top GROUP BY id, label)"""


@query("clf_gaussian_nb", with_sql(_SPLIT, _NB, select=f"SELECT id, label, prediction, {rs('p_true')} AS p_true FROM pred"))
def _(spark, sf):
    return rounded(K.clf_gaussian_nb(*vectors(spark, sf)), ["p_true"])


@query(
    "confusion_matrix",
    with_sql(_SPLIT, _KNN,
             select="SELECT label AS actual, " + ", ".join(f'count(*) FILTER (prediction = {c}) AS "pred_{c}"' for c in range(10)) + " FROM pred GROUP BY 1"),
)
def _(spark, sf):
    return Q.confusion_matrix(K.clf_knn(*vectors(spark, sf)), list(range(10)))


_METRICS = f"""k AS (SELECT label AS c FROM pred UNION SELECT prediction FROM pred),
pk AS (SELECT c, (SELECT count(*) FROM pred WHERE label = c) AS sup, (SELECT count(*) FROM pred WHERE prediction = c) AS nam,
  (SELECT count(*) FROM pred WHERE prediction = c AND label = c) AS tp FROM k),
pf AS (SELECT *, CASE WHEN nam = 0 THEN 0 ELSE tp / nam END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS rc FROM pk)"""


@query(
    "classification_metrics",
    with_sql(_SPLIT, _KNN, _METRICS,
             select=f"""SELECT {rs('sum(tp) / sum(sup)')} AS accuracy, {rs('sum(p * sup) / sum(sup)')} AS precision, {rs('sum(rc * sup) / sum(sup)')} AS recall,
{rs('sum(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END * sup) / sum(sup)')} AS f1_score FROM pf"""),
)
def _(spark, sf):
    return rounded(Q.classification_metrics(K.clf_knn(*vectors(spark, sf))), Q.HIGHER_IS_BETTER)


@query("log_loss", with_sql(_SPLIT, _NB, select=f"SELECT {rs('-avg(ln(greatest(least(p_true, 1 - 1e-15), 1e-15)))')} AS logloss FROM pred"))
def _(spark, sf):
    return rounded(Q.log_loss(K.clf_gaussian_nb(*vectors(spark, sf))), ["logloss"])


def _meters_split(spark, sf):
    """Labelled meters as vectors: statistics scaled by the training part, and all categories."""
    frame, columns, _ = study(spark, sf)
    rows = frame.withColumn("code", flags.label_code()).withColumns({c: F.col(c).cast("double") for c in _NUMS})
    train, test = (cut_lineage(part, "split") for part in E.train_test_split(rows, "uniqueId", 0.2))
    scaled = (E.standard_scale(train, part, _NUMS) for part in (train, test))
    return tuple(cut_lineage(K.assemble(part, "uniqueId", [*_NUMS, *columns], "code"), "split") for part in scaled)


@query("clf_bagging")
def _(spark, sf):
    return K.clf_bagging(*vectors(spark, sf))


@query("clf_decision_tree")
def _(spark, sf):
    return K.clf_decision_tree(*vectors(spark, sf))


@query("clf_random_forest")
def _(spark, sf):
    return K.clf_random_forest(*vectors(spark, sf))


@query("clf_extra_trees")
def _(spark, sf):
    return K.clf_extra_trees(*vectors(spark, sf))


@query("clf_logistic")
def _(spark, sf):
    return K.clf_logistic(*vectors(spark, sf))


@query("clf_kernel_svm")
def _(spark, sf):
    return K.clf_kernel_svm(*vectors(spark, sf))


@query("clf_adaboost")
def _(spark, sf):
    return K.clf_adaboost(*_meters_split(spark, sf))


@query("clf_gbt")
def _(spark, sf):
    return K.clf_gbt(*_meters_split(spark, sf))


@query("model_comparison")
def model_comparison(spark, sf):
    return K.model_comparison(*_meters_split(spark, sf))


def _two_results(spark, sf):
    split = vectors(spark, sf)
    out = None
    for name, fit in (("neighbours", K.clf_knn), ("gaussian_nb", K.clf_gaussian_nb)):
        pred = cut_lineage(fit(*split), "pred")
        row = Q.classification_metrics(pred).withColumns({"logloss": Q.log_loss(pred).scalar(), "model": F.lit(name)})
        out = row if out is None else out.unionByName(row)
    return cut_lineage(out, "results")


def _named(cte: str, tag: str) -> str:
    """The prediction steps of one model under names of their own."""
    return cte.replace("pred AS", f"pred_{tag} AS")


def _result_row(tag: str, model: str) -> str:
    p = f"pred_{tag}"
    return f"""k_{tag} AS (SELECT label AS c FROM {p} UNION SELECT prediction FROM {p}),
pf_{tag} AS (SELECT *, CASE WHEN nam = 0 THEN 0 ELSE tp / nam END AS p, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END AS rc FROM (
  SELECT c, (SELECT count(*) FROM {p} WHERE label = c) AS sup, (SELECT count(*) FROM {p} WHERE prediction = c) AS nam,
  (SELECT count(*) FROM {p} WHERE prediction = c AND label = c) AS tp FROM k_{tag})),
row_{tag} AS (SELECT '{model}' AS model, sum(tp) / sum(sup) AS accuracy, sum(p * sup) / sum(sup) AS precision, sum(rc * sup) / sum(sup) AS recall,
  sum(CASE WHEN p + rc = 0 THEN 0 ELSE 2 * p * rc / (p + rc) END * sup) / sum(sup) AS f1_score,
  (SELECT -avg(ln(greatest(least(p_true, 1 - 1e-15), 1e-15))) FROM {p}) AS logloss FROM pf_{tag})"""


_RESULTS = (
    _SPLIT,
    _named(_KNN, "knn"),
    _named(_NB, "nb"),
    _result_row("knn", "neighbours"),
    _result_row("nb", "gaussian_nb"),
    "results AS (SELECT * FROM row_knn UNION ALL SELECT * FROM row_nb)",
)
_WINS = " + ".join(
    [f"CASE WHEN round({m}, 9) = round((SELECT max({m}) FROM results), 9) THEN 1 ELSE 0 END" for m in Q.HIGHER_IS_BETTER]
    + ["CASE WHEN round(logloss, 9) = round((SELECT min(logloss) FROM results), 9) THEN 1 ELSE 0 END"]
)


@query("top_metric", with_sql(*_RESULTS, select=f"SELECT model, {_WINS} AS num_best FROM results"))
def _(spark, sf):
    return Q.top_metric(rounded(_two_results(spark, sf), [*Q.HIGHER_IS_BETTER, "logloss"], 9)).select("model", "num_best")


@query(
    "best_by_metric",
    with_sql(*_RESULTS,
             select=" UNION ALL ".join(
                 [f"SELECT '{m}' AS metric, (SELECT model FROM results ORDER BY {m} DESC, model DESC LIMIT 1) AS model" for m in Q.HIGHER_IS_BETTER]
                 + ["SELECT 'logloss', (SELECT model FROM results ORDER BY logloss, model LIMIT 1)"])),
)
def _(spark, sf):
    return Q.best_by_metric(_two_results(spark, sf))


def _predicted(spark, sf):
    """Labels of all meters from the frame of the job: statistics, flags and rule groups."""
    frame = meter_frame(spark, sf).na.fill("none", _CATS)
    found = {c: [v for v in E.categories(frame, c) if v is not None] for c in _CATS}
    hot = {f"h{i}": (F.col(c) == v).cast("int") for i, (c, v) in enumerate((c, v) for c in _CATS for v in found[c])}
    scaled = E.min_max_scale(cut_lineage(frame.withColumns(hot), "frame"), _NUMS)
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in [*_NUMS, *hot]])
    code = F.coalesce(flags.label_code(), F.lit(99))
    rows = scaled.select("uniqueId", code.alias("code"), flags.label_or_unknown().alias("endUseLabel"), array_to_vector(x).alias("features"))
    return LU.predict_unknown(cut_lineage(rows, "frame"))


@query("predict_unknown")
def _(spark, sf):
    return _predicted(spark, sf)


def _kept_labels(out, training):
    """Given labels that came out as they went in, and how many meters have any label."""
    given = training.select(ids.unique_id().alias("uniqueId"), "endUseLabel").filter(flags.label_code().isNotNull()).distinct()
    known = given.groupBy("uniqueId").agg(F.min("endUseLabel").alias("endUseLabel"), F.count("*").alias("n")).filter("n = 1").drop("n")
    return out.join(known.withColumnRenamed("endUseLabel", "given"), "uniqueId").select(
        "uniqueId", "given", (F.col("given") == F.col("endUseLabel")).alias("kept")
    )


_GIVEN = f"""given AS (SELECT DISTINCT {UNIQUE_ID} AS "uniqueId", "endUseLabel" FROM training WHERE "endUseLabel" SIMILAR TO '0[0-5]_.*'),
single AS (SELECT "uniqueId", min("endUseLabel") AS given FROM given GROUP BY 1 HAVING count(*) = 1),
meters AS (SELECT DISTINCT "uniqueId" FROM ec)"""
_KEPT = 'SELECT "uniqueId", given, true AS kept FROM single WHERE "uniqueId" IN (SELECT "uniqueId" FROM meters)'


@query("predict_unknown_given", with_sql("readings", "training", TYPED, EC, _GIVEN, select=_KEPT))
def _(spark, sf):
    """Meters with a label keep it; checked row by row."""
    return _kept_labels(_predicted(spark, sf), T.training_labels(spark, sf))


@query("label_unknown")
def label_unknown(spark, sf):
    return LU.label_unknown(T.readings(spark, sf), T.points(spark, sf), T.training_labels(spark, sf))


@query(
    "label_unknown_meters",
    with_sql(
        "readings", "training", TYPED, EC, _GIVEN,
        select="""SELECT DISTINCT m."uniqueId", true AS labelled, CASE WHEN s.given IS NOT NULL THEN true END AS kept
FROM (SELECT "uniqueId" FROM ec WHERE kind = 'num') m LEFT JOIN single s ON m."uniqueId" = s."uniqueId\"""",
    ),
)
def _(spark, sf):
    """Every energy meter with numbers gets one label of a known kind, and a given one stays."""
    out = cut_lineage(label_unknown(spark, sf), "labels")
    kept = _kept_labels(out, T.training_labels(spark, sf)).select("uniqueId", "kept")
    labelled = out.groupBy("uniqueId").agg(F.min(flags.label_code().isNotNull()).alias("labelled"))
    return labelled.join(kept, "uniqueId", "left")


# --- streaming ---------------------------------------------------------------------------------


def reading_stream(spark, sf):
    schema = T.load(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return T.readings_of(events)


@query(
    "stream_rollup_hourly",
    with_sql(
        "readings",
        TYPED,
        select=f"""SELECT date_trunc('hour', datetime) AS hour_start, {TAGS}, {rs('avg(x)')} AS mean, min(x) AS min, max(x) AS max, count(*) AS count
FROM typed WHERE x IS NOT NULL GROUP BY ALL""",
    ),
)
def _(spark, sf):
    base = scratch_path(spark, "rollup")
    stream = reading_stream(spark, sf)

    def run() -> None:
        SR.stream_rollup_hourly(stream, SENSOR_TAGS, f"{base}/out", f"{base}/check", clock=f"{base}/clock").awaitTermination()

    run()
    last = T.readings(spark, sf).agg(F.max("datetime")).first()[0]
    SR.close_hours(spark, stream.schema, f"{base}/clock", str(last + datetime.timedelta(hours=2)))
    run()
    return rounded(spark.read.parquet(f"{base}/out"), ["mean"])


@query(
    "stream_fold",
    with_sql("readings", TYPED, select=f"""SELECT {TAGS}, {rs('avg(x)')} AS mean, {rs('coalesce(stddev_samp(x), 0)')} AS std, max(x) AS max, min(x) AS min, count(x) AS count
FROM typed WHERE kind = 'num' GROUP BY ALL"""),
)
def _(spark, sf):
    base = scratch_path(spark, "fold")
    SR.stream_fold(reading_stream(spark, sf), SENSOR_TAGS, f"{base}/state", f"{base}/check").awaitTermination()
    return rounded(SR.folded(spark, f"{base}/state", SENSOR_TAGS), ["mean", "std"])

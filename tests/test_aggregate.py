import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sensorloom.functions.values import split_datetime
from sensorloom.operators import aggregate as A
from sensorloom.operators import dedupe as D
from sensorloom.operators import encode as E
from sensorloom.operators import energy

T = datetime.datetime
COLS = "seq long, datetime timestamp_ntz, k string, value string"


def frame(spark, rows):
    return split_datetime(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLS))


def test_bool_changes_over_two_hours(spark):
    df = frame(spark, [(T(2020, 1, 1, 0, 10), "a", "True"), (T(2020, 1, 1, 0, 40), "a", "False"),
                       (T(2020, 1, 1, 1, 5), "a", "False"), (T(2020, 1, 1, 1, 6), "a", "True"), (T(2020, 1, 1, 1), None, "True")])
    row = A.agg_bool(df, ["k"]).collect()
    assert len(row) == 1
    assert (row[0]["mean"], row[0]["max"], row[0]["min"], row[0]["count"]) == (1.0, 1.0, 1.0, 4)


def test_changes_equal_a_plain_loop_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(T(2020, 1, 1) + datetime.timedelta(seconds=rng.randrange(0, 9000)), "hot", rng.choice(["x", "y", None])) for _ in range(2000)]
    df = frame(spark, rows)
    got = {(r["change_hour"]): (r["changes"], r["count"]) for r in A.state_changes(df, ["k"], ["str"]).collect()}
    want: dict = {}
    last = "none yet"
    for t, _, v in [r for _, r in sorted(enumerate(rows), key=lambda e: (e[1][0], e[0]))]:
        c, n = want.get(str(t.hour), (0, 0))
        want[str(t.hour)] = (c + (last != "none yet" and v != last), n + 1)
        last = v
    assert got == want


def test_mixed_sensor_is_one_row(spark):
    df = frame(spark, [(T(2020, 1, 1), "a", "2"), (T(2020, 1, 1, 1), "a", "4"), (T(2020, 1, 1, 2), "a", "rain"), (T(2020, 1, 1, 3), "b", "NaN")])
    rows = {r["k"]: r for r in A.agg_all(df, ["k"]).collect()}
    assert rows["a"]["count"] == 3 and rows["a"]["max"] == 4.0 and rows["a"]["min"] == 0.0
    assert rows["a"]["mean"] == pytest.approx((3.0 * 2 + 0.0) / 3)
    assert rows["b"]["count"] == 0 and rows["b"]["mean"] == 0.0


def test_unknown_aggregate_is_refused(spark):
    with pytest.raises(ValueError):
        A.agg_numeric(frame(spark, [(T(2020, 1, 1), "a", "2")]), ["k"], "wrong")


def test_folds(spark):
    cols = "k string, mean double, std double, max double, min double, count long"
    one = spark.createDataFrame([("a", 1.0, 0.0, 4.0, 0.0, 2), ("b", 5.0, 1.0, 6.0, 4.0, 2)], cols)
    two = spark.createDataFrame([("a", 4.0, 1.0, 9.0, 3.0, 1), ("c", 0.0, 0.0, 0.0, 0.0, 0)], cols)
    want = {"a": (2.0, 17 / 3, 3), "b": (5.0, 6.0, 2), "c": (0.0, 0.0, 0)}
    for fold in (A.append_agg, A.join_full_fold):
        got = {r["k"]: (r["mean"], r["max"], r["count"]) for r in fold(one, two, ["k"]).collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_exact_fold_is_accurate_for_large_counters(spark):
    xs = [1e9 + i * 0.5 for i in range(40)]
    df = frame(spark, [(T(2020, 1, 1 + i % 5, i % 24), "a", repr(x)) for i, x in enumerate(xs)])
    got = A.daily_fold(df, ["k"], exact=True).first()
    assert got["std"] == pytest.approx(statistics.stdev(xs), rel=1e-9)
    assert (got["max"], got["min"], got["count"]) == (max(xs), min(xs), 40)


def test_pivot_keeps_absent_groups_as_zero(spark):
    agg = spark.createDataFrame([("h", 1, 2.0, 3), ("h", 2, 5.0, 1), ("g", 1, 1.0, 1)], "h string, c int, mean double, count long")
    got = {r["h"]: (r["mean_1"], r["mean_2"], r["mean_3"], r["count"]) for r in A.pivot_last(agg, ["h", "c"], [1, 2, 3]).collect()}
    assert got == {"h": (2.0, 5.0, 0.0, 4), "g": (1.0, 0.0, 0.0, 1)}


def test_latest_per_key_lets_null_win(spark):
    df = spark.createDataFrame([("a", "2020", "x"), ("a", None, "y"), ("b", "1", "p"), ("b", "2", "q")], "k string, at string, v string")
    assert sorted(r["v"] for r in D.latest_per_key(df, ["k"], "at").collect()) == ["q", "y"]


def test_flag_duplicates_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5)], "k string, i int")
    assert {r["i"] for r in D.flag_duplicates(df, ["k"]).filter("duplicated").collect()} == {1, 2, 3, 4}


def test_min_max_scale_constant_and_null(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0)], "a double, b double")
    assert sorted(map(tuple, E.min_max_scale(df, ["a", "b"]).collect()), key=str) == sorted([(0.0, 0.0), (1.0, 0.0), (None, 0.0)], key=str)


def test_codes_and_folds(spark):
    df = spark.createDataFrame([(i, T(2020, 1, 1, i % 3, i % 7), "abc"[i % 3] if i % 4 else "d") for i in range(200)], "seq long, datetime timestamp_ntz, v string")
    codes = {r["v"]: r["code"] for r in E.first_appearance_code(df, "v").collect()}
    firsts = {}
    for r in sorted(df.collect(), key=lambda r: (r["datetime"], r["seq"])):
        firsts.setdefault(r["v"], len(firsts))
    assert codes == firsts
    folds = E.stratified_folds(df, "v", "seq", 3)
    for r in folds.groupBy("v").agg(*[F.sum((F.col("fold") == f).cast("int")).alias(f"f{f}") for f in range(3)]).collect():
        assert max(r[1:]) - min(r[1:]) <= 1
    assert folds.count() == 200
    train, test = E.train_test_split(df, "seq", 0.3)
    assert train.count() + test.count() == 200
    again = E.train_test_split(df.repartition(7), "seq", 0.3)[1]
    assert {r["seq"] for r in test.collect()} == {r["seq"] for r in again.collect()}


def test_median_and_previous_value(spark):
    rng = random.Random(4)
    rows = [(T(2020, 1, 1) + datetime.timedelta(seconds=7 * i), rng.choice("abb"), repr(rng.choice([1.0, 2.0, rng.random() ** 9, 1e6 * rng.random()]))) for i in range(3001)]
    df = frame(spark, rows)
    want = {k: statistics.median(float(v) for _, g, v in rows if g == k) for k in "ab"}
    assert {r["k"]: r["median"] for r in A.agg_median(df, ["k"]).collect()} == pytest.approx(want, rel=1e-12)
    last, expected = {}, {}
    for i, (_, k, _) in enumerate(rows):
        expected[i] = last.get(k)
        last[k] = i
    assert {r["seq"]: r["previous"] for r in A.previous_value(df, ["k"], "seq").collect()} == expected


def test_sparse_value_codes_have_no_limit(spark):
    texts = spark.range(E.MAX_CATEGORIES + 5).select("id", F.concat(F.lit("s"), "id").alias("value"))
    more = spark.createDataFrame([(20_000, "2"), (20_001, "4"), (20_002, None), (20_003, "s7")], "id long, value string")
    df = texts.unionByName(more).withColumns({"datetime": F.timestamp_seconds("id"), "seq": F.col("id")})
    got = {r["id"]: r for r in E.encode_and_scale_values_sparse(df).collect()}
    assert len(got) == E.MAX_CATEGORIES + 9
    assert {r["cv_width"] for r in got.values()} == {E.MAX_CATEGORIES + 6}  # a null is a category
    assert all(got[i]["cv_code"] == i and got[i]["sc_0"] == 0.0 for i in range(0, E.MAX_CATEGORIES + 5, 97))
    assert [(got[i]["cv_code"], got[i]["sc_0"]) for i in range(20_000, 20_004)] == [
        (None, 0.0), (None, 1.0), (E.MAX_CATEGORIES + 5, 0.0), (7, 0.0)
    ]


@pytest.mark.parametrize("zone", ["timestamp", "timestamp_ntz"])
def test_first_and_last_in_one_pass(spark, zone):
    rng = random.Random(3)
    odd = [0.0, -0.0, -1.5, 1e300, -1e300, 5e-324, -5e-324, float("inf"), None]
    times = ["0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2020-03-29 02:30:00.000001", "2020-03-29 03:30:00", "9999-12-31 23:00:00"]
    rows = [(f"m{rng.randrange(40)}", rng.choice(times), rng.choice(odd)) for _ in range(400)]
    rows += [("none", None, 1.0), ("same", times[2], 4.0), ("same", times[2], -4.0)]
    df = spark.createDataFrame(rows, "uniqueID string, t string, value double")
    df = df.select(F.lit("s").alias("siteRef"), "uniqueID", F.col("t").cast(zone).alias("datetime"), "value")
    got = energy.meter_delta_first_last(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Join" not in plan and plan.count("Exchange") == 1

    want = {}
    for m in {r[0] for r in rows} - {"none"}:
        mine = [r for r in rows if r[0] == m]
        first, last = min(r[1] for r in mine), max(r[1] for r in mine)
        lo = [r[2] for r in mine if r[1] == first and r[2] is not None]
        hi = [r[2] for r in mine if r[1] == last and r[2] is not None]
        want[m] = max(hi) - min(lo) if lo and hi else None
    for r in got.collect():
        w = want.pop(r["uniqueID"])
        assert r["delta"] == w or (w != w and r["delta"] != r["delta"])
    assert not want

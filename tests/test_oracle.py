"""Every query with a SQL twin agrees with it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_fold_over_many_batches_is_compacted_and_replay_safe(spark, tmp_path):
    from sensorloom.operators.aggregate import append_agg_exact, numeric_partials
    from sensorloom.sources import tables as T
    from sensorloom.streaming import rollup

    events = T.load(spark, SF, "events")
    for i in range(7):
        events.filter(f"event_id % 7 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rollup.stream_fold(T.readings_of(stream), ["siteRef"], f"{tmp_path}/state", f"{tmp_path}/check", compact_after=3).awaitTermination()
    assert 1 < len(rollup._batches(spark, f"{tmp_path}/state")) <= 4
    readings = T.readings(spark, SF)
    # A replay of the last batch overwrites its folder.
    last = readings.filter("seq % 7 = 100").limit(0)
    numeric_partials(last, ["siteRef"]).write.mode("overwrite").parquet(f"{tmp_path}/state/batches-99-99")
    got = {r.siteRef: r for r in rollup.folded(spark, f"{tmp_path}/state", ["siteRef"]).collect()}
    want = append_agg_exact(numeric_partials(readings, ["siteRef"]), ["siteRef"]).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[r.siteRef]["count"] == r["count"] and got[r.siteRef]["std"] == pytest.approx(r["std"])


def test_ranges_prune_day_folders(spark, tmp_path):
    from sensorloom.operators.energy import energy_by_end_use
    from sensorloom.sources import readings as R
    from sensorloom.sources import tables as T

    R.write_readings_by_day(T.readings(spark, SF), f"{tmp_path}/days")
    days = R.read_stored_days(spark, f"{tmp_path}/days", "2024-01-08", "2024-01-14")
    assert len(days.inputFiles()) > 0
    plan = energy_by_end_use(days, T.end_use_labels(spark, SF), site="Site 2", start="2024-01-08", end="2024-01-14")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in text and "siteRef" in text.split("PushedFilters")[1][:200]


def test_exports_with_other_headers(spark, tmp_path):
    from sensorloom.sources import metadata as M

    (tmp_path / "a.csv").write_text("name,unit\nx,kWh\n")
    (tmp_path / "b.csv").write_text("unit,name,extra\nm,y,\n")
    (tmp_path / "c.csv").write_text("name,unit\nz,\n")
    heads = M.headers(spark, str(tmp_path))
    assert heads == {"a": ["name", "unit"], "b": ["unit", "name", "extra"], "c": ["name", "unit"]}
    rows = {(r.building, r.name, r.unit, r.extra) for r in M.scan_many(spark, str(tmp_path)).collect()}
    assert rows == {("a", "x", "kWh", None), ("b", "y", "m", None), ("c", "z", None, None)}
    counts = {r.field: r["count"] for r in M.column_occurrence(spark, heads).collect()}
    assert counts == {"name": 3, "unit": 3, "extra": 1, M.TOTAL_FIELD: 3}


def test_label_store_checks_and_replaces(spark, tmp_path):
    from sensorloom.sources import labels as L

    frame = lambda rows: spark.createDataFrame(rows, "uniqueID string, endUseLabel string")
    store = f"{tmp_path}/labels"
    L.labels_store(frame([("a", "1"), ("b", "2")]), store)
    L.labels_store(frame([("b", "3"), ("c", "4")]), store)
    with pytest.raises(ValueError):
        L.labels_store(frame([("c", "5"), ("c", "6")]), store)
    assert {(r.uniqueID, r.endUseLabel) for r in L.stored_labels(spark, store).collect()} == {("a", "1"), ("b", "3"), ("c", "4")}

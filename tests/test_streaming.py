"""Streamed hours: those that the watermark passed come out, the last ones after a closing call, each once."""

import datetime

from pyspark.sql import functions as F

from sensorloom.streaming import rollup as SR

SCHEMA = "datetime timestamp_ntz, sensor string, value string"


def test_closing_call_gives_out_the_last_hours(spark, tmp_path):
    start = datetime.datetime(2020, 1, 1)
    rows = [(start + datetime.timedelta(minutes=7 * i), f"s{i % 3}", "x" if i % 10 == 0 else str(i)) for i in range(60)]
    source, out, clock, check = (str(tmp_path / n) for n in ("in", "out", "clock", "check"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)

    def run():
        SR.stream_rollup_hourly(stream, ["sensor"], out, check, clock=clock).awaitTermination()
        return {(r.hour_start, r.sensor): r["count"] for r in spark.read.parquet(out).collect()}, spark.read.parquet(out).count()

    want = {}
    for t, sensor, value in rows:
        if value != "x":
            hour = t.replace(minute=0)
            want[hour, sensor] = want.get((hour, sensor), 0) + 1
    last = rows[-1][0] - datetime.timedelta(minutes=10)
    got, n = run()
    assert got == {k: v for k, v in want.items() if k[0] + datetime.timedelta(hours=1) <= last} and n == len(got) < len(want)
    SR.close_hours(spark, stream.schema, clock, str(rows[-1][0] + datetime.timedelta(hours=2)))
    got, n = run()
    assert got == want and n == len(want)
    got, n = run()
    assert got == want and n == len(want)

"""Windows over tables and streams."""

import datetime as dt

from pyspark.sql import functions as F

from skarn.streaming import windows


def events(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=m)
    rows = [(1, at(0), 1.0), (1, at(10), 2.0), (1, at(50), 3.0), (2, at(5), 4.0), (2, at(61), 5.0)]
    return spark.createDataFrame(rows, "u long, ts timestamp, v double")


def test_tumbling_and_sessions(spark):
    df = events(spark)
    got = windows.windowed(df, "ts", "1 hour", ["u"], [F.sum("v").alias("s")])
    assert sorted((r.u, r.s) for r in got.collect()) == [(1, 6.0), (2, 4.0), (2, 5.0)]
    got = windows.windowed(df, "ts", "1 hour", [], [F.count("*").alias("n")], slide="30 minutes")
    assert sum(r.n for r in got.collect()) == 10
    got = windows.sessions(df, "ts", "30 minutes", ["u"], [F.count("*").alias("n")])
    assert sorted((r.u, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1), (2, 1)]


def test_stream_continues_where_it_ended(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    df = events(spark)
    df.write.parquet(src)
    stream = windows.windowed(windows.file_stream(spark, src, df.schema), "ts", "1 hour", ["u"], [F.sum("v").alias("s")], late="0 seconds")
    windows.run_once(stream, out, mark)
    later = df.withColumn("ts", F.col("ts") + F.expr("INTERVAL 5 HOURS"))
    later.write.mode("append").parquet(src)
    windows.run_once(stream, out, mark)
    got = spark.read.parquet(out)
    assert {(r.u, r.s) for r in got.collect()} >= {(1, 6.0), (2, 4.0), (2, 5.0)}
    once = windows.deduplicated(windows.file_stream(spark, src, df.schema), "ts", ["u"], "1 day")
    windows.run_once(once, out + "2", mark + "2")
    assert spark.read.parquet(out + "2").count() == 2

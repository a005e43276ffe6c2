from pyspark.sql import functions as F

from tidemark.streaming import incremental


def test_restart_adds_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, 60 + i * 60) for i in range(50)], "k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = incremental.once(incremental.tail(spark, str(tmp_path / "in"), rows.schema), ["k"], "ts")
        incremental.available_now(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_runs_are_sealed_across_batches(spark, tmp_path):
    times = [0, 10, 20, 5000, 5010, 5020, 20000]
    for i, t in enumerate(times):
        spark.createDataFrame([(1, t)], "k long, s long").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    made = incremental.sealed_runs(incremental.tail(spark, str(tmp_path / "in"), schema, 3), "k", "ts", 1800, 3)
    incremental.available_now(made, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = [(r.run_from, r.run_to, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [(0.0, 20.0, 3)]


def test_windows_in_append_mode(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 100), ("a", 90000), ("b", 200), ("a", 500000)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = incremental.windows(incremental.tail(spark, str(tmp_path / "in"), rows.schema), "ts", ["k"], "1 day", late="1 hour")
    incremental.available_now(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {(r.k, r.window.start.day): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1): 2, ("b", 1): 1, ("a", 2): 1}


def test_upsert(spark):
    old = spark.createDataFrame([(1, 5, 9, "x", 1)], "k long, first long, last long, v string, o long")
    new = spark.createDataFrame([(1, 3, 7, "y", 2), (2, 1, 1, "z", 1)], old.schema)
    got = {tuple(r) for r in incremental.upsert(old, new, ["k"], ["first"], ["last", "o"], "o").collect()}
    assert got == {(1, 3, 9, "y", 2), (2, 1, 1, "z", 1)}

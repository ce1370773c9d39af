import numpy as np
from pyspark.sql import functions as F

from arrayloom.operators import ordered
from arrayloom.operators.learn import wal_sequence
from arrayloom.streaming import state


def test_wal_stream_equals_the_batch_fold(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(int(k), i, int(rng.integers(0, 3)), float(rng.random())) for i, k in enumerate(rng.integers(0, 3, 60))]
    schema = "key bigint, seq bigint, concept int, amplitude double"
    templates = [[int(x) for x in rng.integers(-2, 3, 16)] for _ in range(3)]
    want = wal_sequence(spark.createDataFrame(rows, schema), templates, key="key", order="seq", d=16, channels=2, decay=100)
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    out = state.wal_stream(stream, templates, key="key", order="seq", d=16, channels=2)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.seq: round(r.absorbed, 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.seq: round(r.absorbed, 9) for r in want.collect()}


def test_absorption_stream_equals_the_table(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, float(rng.random())) for i, k in enumerate(rng.integers(0, 3, 40))]
    schema = "key bigint, seq bigint, v double"
    want = ordered.absorption(spark.createDataFrame(rows, schema), "v", ["seq"], 4, "key")
    for part in range(2):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = state.absorption_stream(stream, "v", "seq", 4, "key")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    told = lambda df: {r.seq: (round(r.average, 9), round(r.minimum, 9), r.action) for r in df.collect()}
    assert told(spark.read.parquet(str(tmp_path / "out"))) == told(want) and len(told(want)) == 40


def test_sessions_end_after_a_gap(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:01",), ("2024-01-01 00:00:04",), ("2024-01-01 00:00:30",)], "t string").select(F.to_timestamp("t").alias("t"), F.lit(1).alias("k"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.sessions(stream, "t", "5 seconds", "0 seconds", "k").writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("sess").collect()) == [1, 2]


def test_windows_drop_what_is_too_late(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 00:00:01", 1.0), ("2024-01-01 00:00:09", 3.0), ("2024-01-01 00:00:11", 5.0)], "t string, v double").select(F.to_timestamp("t").alias("t"), "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.windowed(stream, "t", "v", "10 seconds", "0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("w").collect()) == [(1, 5.0), (2, 4.0)]

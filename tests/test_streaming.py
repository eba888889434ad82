from pyspark.sql import functions as F

from skeinlog.operators import kernels
from skeinlog.streaming import sessions


def test_stream_sessions_and_buckets(spark, tmp_path):
    rows = [("a", 0, 5), ("a", 60, 7), ("a", 7200, 1), ("b", 30, 2), ("z", 90_000, 0)]
    t = spark.createDataFrame(rows, "user string, s long, amount long").select("user", F.timestamp_seconds("s").alias("event_time"), "amount")
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    got = {}
    for name, df in (("s", sessions.stream_sessions(stream, ["user"])), ("b", sessions.stream_buckets(stream, ["user"], "amount", width="1 hour"))):
        q = df.writeStream.outputMode("append").format("memory").queryName(f"t_{name}").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
        got[name] = spark.table(f"t_{name}").collect()
    assert sorted((r.user, r.n) for r in got["s"] if r.user != "z") == [("a", 1), ("a", 2), ("b", 1)]
    assert sorted((r.user, r.total) for r in got["b"] if r.user != "z") == [("a", 1), ("a", 12), ("b", 2)]


def test_stream_and_batch_sessions_agree(spark, tmp_path):
    """Rows the gap apart belong together in both, those a microsecond more apart don't."""
    micros = [("c", x) for x in (0, 1_800_000_000, 3_600_000_001, 5_400_000_001, 9_000_000_000)] + [("d", x) for x in (5, 1_800_000_006)] + [("z", 10**12)]
    t = spark.createDataFrame(micros, "user string, us long").select("user", "us", F.timestamp_micros("us").alias("event_time"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = sessions.stream_sessions(stream, ["user"]).writeStream.outputMode("append").format("memory").queryName("t_agree").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    got = spark.table("t_agree").where("user <> 'z'").select("user", F.unix_micros("start").alias("a"), (F.unix_micros("end") - 1_800_000_000).alias("z"), "n")
    batch = kernels.gap_sessions(t.where("user <> 'z'"), ["user"], "us", ["us"], 1_800_000_000).groupBy("user", "sid").agg(F.min("us").alias("a"), F.max("us").alias("z"), F.count("*").alias("n")).drop("sid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))

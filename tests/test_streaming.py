from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.streaming import usage


def run(stream, name, mode, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_once_and_windows(spark, tmp_path):
    t = datetime(2026, 3, 1)
    rows = [("a", t, 1), ("a", t + timedelta(hours=1), 1), ("b", t + timedelta(hours=2), 2), ("c", t + timedelta(days=9), 4)]
    spark.createDataFrame(rows, "id string, at timestamp, total bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id string, at timestamp, total bigint").parquet(str(tmp_path / "in"))
    run(usage.once(stream, ["id"], "at"), "once", "append", tmp_path / "c1")
    assert sorted(r.id for r in spark.table("once").collect()) == ["a", "b", "c"]
    run(usage.windowed_counts(stream, "at", []), "windows", "append", tmp_path / "c2")
    assert [(r.requests, r.tokens) for r in spark.table("windows").filter(F.col("window_start") == t).collect()] == [(3, 4)]


def test_latest_snapshots(spark, tmp_path):
    t = datetime(2026, 3, 1)
    rows = [("p", 1, t, s, t, {"n": s}) for s in (1, 3, 2)]
    schema = "producer string, epoch int, window_start timestamp, sequence int, emitted_at timestamp, counters map<string,int>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    run(usage.latest_snapshots(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "latest", "complete", tmp_path / "c")
    assert [(r.sequence, r.counters) for r in spark.table("latest").collect()] == [(3, {"n": 3})]


def test_cusum_state_across_batches(spark, tmp_path):
    values = [10, 11, 9, 10, 12, 8, 10, 30, 40, 10, 10, 50]
    schema = "series string, index bigint, value double"
    (tmp_path / "in").mkdir()
    stream = usage.cusum(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    for k in range(0, len(values), 5):
        part = [("s", i, float(values[i])) for i in range(k, min(k + 5, len(values)))]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r["index"]: (r.statistic, r.alarm) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    past, score, want, last = [], 0.0, {}, None
    for i, v in enumerate(values):
        past, score, statistic, alarm = usage.step(past, score, last, i, float(v), 6, 1.0, 2.0, 4.0)
        last = i
        if statistic is not None:
            want[i] = (statistic, alarm)
    assert got == want and any(a for _, a in want.values())

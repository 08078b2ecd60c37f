import datetime

from pyspark.sql import functions as F
from test_features import START, event, frame
from test_library import raw

from riskloom.operators import links
from riskloom.streaming import jobs


def test_ingest_twice(spark, tmp_path):
    first = raw(spark, {"id": "1", "data": '{"recipient_count": 2}'}, {"id": "2", "type": "Bad"}, {"id": "1", "data": '{"recipient_count": 3}'})
    source = str(tmp_path / "in")
    first.coalesce(1).write.parquet(source)
    for _ in range(2):
        jobs.ingest(spark.readStream.schema(first.schema).parquet(source), str(tmp_path / "events"), str(tmp_path / "rejects"), str(tmp_path / "check")).awaitTermination()
    raw(spark, {"id": "1", "data": '{"recipient_count": 2}'}, {"id": "3"}).write.mode("append").parquet(source)
    jobs.ingest(spark.readStream.schema(first.schema).parquet(source), str(tmp_path / "events"), str(tmp_path / "rejects"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "events")).collect()) == ["1", "3"]
    assert sorted((r["id"], r["code"]) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()) == [("1", "conflict"), ("2", "bad_type")]


def test_ingest_tells_rows_apart_once_by_narrow_columns(spark, tmp_path, monkeypatch):
    seen = []
    real = jobs.classify
    monkeypatch.setattr(jobs, "classify", lambda events, log: seen.append(events.columns) or real(events, log))
    rows = raw(spark, {"id": "1", "data": '{"recipient_count": 2}'}, {"id": "1", "data": '{"recipient_count": 2}'}, {"id": "2"})
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    jobs.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "events"), str(tmp_path / "rejects"), str(tmp_path / "check")).awaitTermination()
    assert len(seen) == 1 and "data" not in seen[0] and len(seen[0]) < 10
    logged = spark.read.parquet(str(tmp_path / "events"))
    assert sorted(r["id"] for r in logged.collect()) == ["1", "2"] and "data" in logged.columns and "seq" not in logged.columns


def test_stateful_outcomes(spark, tmp_path):
    kind = "tenant string, producer string, id string, body_hash string, received_ns long, at timestamp"
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("t", "p", "1", "a", 1, at), ("t", "p", "1", "a", 2, at), ("t", "p", "1", "b", 3, at), ("t", "p", "2", "a", 1, at)], kind).write.parquet(str(tmp_path / "in"))
    stream = jobs.outcomes(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r["id"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("1", "accepted"), ("1", "conflict"), ("1", "duplicate"), ("2", "accepted")]


def test_timers(spark, tmp_path):
    kind = "tenant string, subject string, type string, at timestamp, at_ns long"
    base = START // 1_000_000_000
    rows = [("t", "s", "content.sent", base), ("t", "far", "content.sent", base + 3 * 86_400)]
    for k, (tenant, subject, name, at) in enumerate(rows):
        spark.createDataFrame([(tenant, subject, name, at)], "tenant string, subject string, type string, s long").select("tenant", "subject", "type", F.timestamp_seconds("s").alias("at"), (F.col("s") * 1_000_000_000).alias("at_ns")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.rescore_timers(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    due = sorted(r["due_ms"] // 1000 - base for r in spark.read.parquet(str(tmp_path / "out")).where("subject = 's'").collect())
    assert due == [-(-(base + 3600) // 300) * 300 - base, -(-(base + 86_400) // 300) * 300 - base]


def test_dirty_subjects(spark):
    rows = [event(START, "resource.created", subject="a", card_fingerprint_hash="c"), event(START, "resource.created", subject="b", card_fingerprint_hash="c"), event(START, "resource.created", subject="z", card_fingerprint_hash="q")]
    summary = links.link_summary(links.link_touches(frame(spark, rows)))
    batch = frame(spark, [event(START + 1, "label", subject="a", label="abusive")])
    assert {r["subject"] for r in jobs.dirty_subjects(batch, summary).collect()} == {"a", "b"}
    batch = frame(spark, [event(START + 1, "content.sent", subject="a")])
    assert {r["subject"] for r in jobs.dirty_subjects(batch, summary).collect()} == {"a"}


def test_velocity_and_dedup(spark, tmp_path):
    df = frame(spark, [event(START, "content.sent", id="1"), event(START, "content.sent", id="1")]).withColumn("at", F.timestamp_seconds(F.lit(START // 1_000_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.dedup(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    jobs.velocity(stream).writeStream.format("memory").queryName("velocity").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("velocity").agg(F.max("sends")).first()[0] == 2


def test_late_backfilled_and_future_rows(spark, tmp_path):
    kind = "tenant string, producer string, id string, subject string, type string, body_hash string, received_ns long, at timestamp, at_ns long"
    now = datetime.datetime.now(datetime.UTC).replace(microsecond=0)
    ages = {"1": 100, "future": -23, "late": 123, "ordinary": 99, "backfilled": 20_000}  # hours, in order of arrival
    for k, (name, hours) in enumerate([*ages.items(), ("1", 100)]):
        at = now - datetime.timedelta(hours=hours)
        row = ("t", "p", name, name, "content.sent", "a", k, at, int(at.timestamp()) * 1_000_000_000)
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(name, job, mode="append"):
        stream = job(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert query.awaitTermination(100)
        return spark.table(name).collect()

    assert sorted((r["id"], r["outcome"]) for r in run("outcomes_seen", jobs.outcomes)) == sorted([*((k, "accepted") for k in ages), ("1", "duplicate")])
    assert sorted(r["id"] for r in run("dedup_seen", jobs.dedup)) == sorted(ages)
    assert {r["subject"] for r in run("velocity_seen", jobs.velocity, "update")} == set(ages)


def test_outcomes_of_an_id_of_many_rows(spark, tmp_path):
    """An id's rows fill several Arrow batches, latest first: the earliest names the hash, wherever it lies."""
    rows = spark.range(25_000).select(F.lit("t").alias("tenant"), F.lit("").alias("producer"), F.lit("1").alias("id"), F.when(F.col("id") == 24_999, "a").otherwise("b").alias("body_hash"), (30_000 - F.col("id")).alias("received_ns"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.outcomes(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in got} == {"accepted": 1, "conflict": 24_999}

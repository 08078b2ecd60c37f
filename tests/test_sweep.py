"""The sweep against the history join, state with timers, and capped neighbours of a hub."""

import random
import time

import pytest
from conftest import canonical
from pyspark.sql import functions as F
from test_features import START, event, frame

from riskloom.operators import links, replay, sweep
from riskloom.operators.features import features
from riskloom.schema import DAY_NS, HOUR_NS, MINUTE_NS, column
from riskloom.streaming import stateful

SECOND = 1_000_000_000


def rows_of(df):
    return canonical([tuple(r) for r in df.collect()], df.columns)


def random_log(rng, subjects=4, n=60):
    """Events of all kinds in bursts and long gaps, with ties, on the edges of windows."""
    rows = []
    for s in range(subjects):
        at = START
        for k in range(n):
            at += rng.choice([0, 0, SECOND, MINUTE_NS, 9 * MINUTE_NS, 10 * MINUTE_NS, HOUR_NS, DAY_NS - 10 * MINUTE_NS, DAY_NS, 29 * DAY_NS, 30 * DAY_NS])
            own = {"subject": f"s{s}", "id": f"{s}-{rng.randrange(10**6):06}-{k}"}
            kind = rng.choice(["content.sent"] * 5 + ["resource.created"] * 3 + ["resource.deleted", "payment.attempt", "subscription.changed", "subject.created"])
            if kind == "content.sent":
                own |= {"recipient_count": rng.choice([None, 0.0, 2.5, 3.0, 40.0, 900.0]), "recipient_is_own_identity": rng.choice([None, True, False, False]), "recipient_domain": rng.choice([None, "", "a.org", "Gmail.com "]), "recipient_hash": rng.choice([None, "", "h1", "h2", "h3"]), "subject_line": rng.choice(["Your PayPal invoice", "Netflix premiere", "hello", None])}
            elif kind in ("resource.created", "resource.deleted"):
                own |= {"name": rng.choice(["Netflix sync", "PayPal x@y", "Amazon webhook", "plain", None])}
                if kind == "resource.created":
                    own |= {"kind": rng.choice(["key", "agent", " API Key", None])}
            elif kind == "payment.attempt":
                own |= {"outcome": rng.choice(["declined", "succeeded"]), "funding": rng.choice(["prepaid", "credit", None])}
            elif kind == "subscription.changed":
                own |= {"status": rng.choice(["active", "gone"]), "amount_minor": rng.choice([0.0, 5.0])}
            elif rng.random() < 0.3:
                own |= {"account_created_at": rng.choice(["2023-11-01T00:00:00Z", "2024-01-01T00:30:00Z", "bad", "2029-01-01T00:00:00Z"])}
            rows.append(event(at, kind, **own))
    return rows


def test_sweep_equals_the_history_join(spark):
    log = frame(spark, random_log(random.Random(3)))
    spine, numbered = replay.replay_points(log)
    spine, numbered = spine.cache(), numbered.cache()
    got = rows_of(sweep.features_by_sweep(spine, numbered))
    assert len(got) == spine.count() and got == rows_of(features(spine, numbered))
    for more in (0, 1):  # strictly before the instant, and with it
        points = log.select("tenant", "subject", F.concat("id", F.lit("p")).alias("point"), F.col("at_ns").alias("now_ns"), (F.col("at_ns") + more).alias("cutoff_ns"))
        assert rows_of(sweep.features_by_sweep(points, log)) == rows_of(features(points, log))
    assert sweep.unfit(points.withColumn("cutoff_ns", F.col("cutoff_ns") + 5)).count() == points.count()


def test_sweep_of_nothing(spark):
    log = frame(spark, [event(START, "content.sent", subject="a")])
    none = spark.createDataFrame([("t", "nobody", "p", START, START)], "tenant string, subject string, point string, now_ns long, cutoff_ns long")
    row = sweep.features_by_sweep(none, log).first()
    assert row["next_rescore_ns"] is None and row[column("core.resource_total")] == 0
    assert sweep.features_by_sweep(none.limit(0), log).count() == 0


def test_peaks_of_a_sweep():
    """Both peaks against a plain search, over every kind of gap."""
    rng = random.Random(8)
    for _ in range(60):
        sends, at, rows = sweep._Sends(), 0, []
        for _ in range(rng.randrange(1, 150)):
            at += rng.choice([0, 1, MINUTE_NS, 10 * MINUTE_NS - 1, 10 * MINUTE_NS, HOUR_NS, DAY_NS, 10 * DAY_NS])
            n = rng.randrange(1, 9)
            sends.add(at, n)
            rows.append((at, n))
            if rng.random() < 0.5:
                at += rng.choice([0, 1, MINUTE_NS, DAY_NS - 1, DAY_NS, 30 * DAY_NS - 1, 30 * DAY_NS])
                now = at

                def peak(low, high):
                    inside = [r for r in rows if low < r[0] <= high]
                    return max((sum(m for b, m in inside if a - sweep.TEN_NS < b <= a) for a, _ in inside), default=0)

                assert sends.peaks(now) == (peak(now - DAY_NS, now), peak(now - 30 * DAY_NS, now - DAY_NS))


# --- neighbours ---


def test_hub_is_capped_before_the_join(spark):
    n = 3000
    summary = spark.range(n).select(F.lit("t").alias("tenant"), F.lit("device_hash").alias("kind"), F.lit("hub").alias("hash"), F.format_string("s%05d", "id").alias("subject"), F.lit(0).cast("long").alias("first_ns"), (F.col("id") % 1000).alias("last_ns"))
    found = links.neighbours(summary.select("tenant", "subject"), summary, per_key=3, total=5)
    got = {r["subject"]: sorted(o["other"] for o in r["o"]) for r in found.groupBy("subject").agg(F.collect_list(F.struct("other", "truncated")).alias("o")).collect()}
    assert len(got) == n and found.where("truncated").count() == 3 * n
    best = ["s00999", "s01999", "s02999", "s00998"]
    assert got["s00000"] == sorted(best[:3]) and got["s00999"] == sorted(best[1:4])
    top = links.most_recent(summary, 5)
    assert top.count() == 1 and len(top.first()["others"]) == 5
    assert "WindowGroupLimit" in found._jdf.queryExecution().optimizedPlan().toString()


# --- state ---


def streamed(spark, path, parts, kind):
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(1.1)  # files are read in order of their time
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def finished(spark, path, stream):
    with stateful.with_state_store(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(100)
    return [tuple(r) for r in spark.read.parquet(f"{path}/out").collect()]


AHEAD = 4_000_000_000 * SECOND


def test_a_later_score_replaces_a_timer(spark, tmp_path):
    parts = [[("t", "a", 10, AHEAD), ("t", "b", 10, AHEAD), ("t", "c", 10, AHEAD)], [("t", "a", 20, 7 * SECOND), ("t", "b", 20, None), ("t", "c", 5, SECOND)], [("t", "d", 1, 1)]]
    stream = stateful.score_timers(streamed(spark, tmp_path, parts, "tenant string, subject string, scored_ns long, next_rescore_ns long"))
    assert sorted(finished(spark, tmp_path, stream)) == [("t", "a", 7000), ("t", "d", 1)]


def test_late_events_have_timers(spark, tmp_path):
    parts = [[("t", "s", "content.sent", AHEAD)], [("t", "s", "content.sent", 0), ("t", "s", "content.sent", 1), ("t", "s", "label", 5)]]
    stream = stateful.rescore_timers(streamed(spark, tmp_path, parts, "tenant string, subject string, type string, at_ns long"))
    assert sorted(r[2] for r in finished(spark, tmp_path, stream)) == [3_600_000, 3_900_000, 86_400_000, 86_700_000]


def test_ids_expire(spark, tmp_path):
    kind = "tenant string, producer string, id string, body_hash string, received_ns long"
    parts = [[("t", "p", "1", "a", 1), ("t", "p", "1", "b", 2)], [("t", "p", "1", "a", 3)]]
    for ttl, last in ((1, "accepted"), (3_600_000, "duplicate")):
        path = tmp_path / str(ttl)
        got = finished(spark, path, stateful.outcomes(streamed(spark, path, parts, kind), ttl))
        assert [r[4] for r in sorted(got, key=lambda r: r[3])] == ["accepted", "conflict", last]


def test_velocity_of_late_events(spark, tmp_path):
    kind = "tenant string, subject string, producer string, id string, type string, at_ns long, recipient_is_own_identity boolean, recipient_count double"
    row = lambda id_, at, name="content.sent", own=False, n=2.0: ("t", "s", "p", id_, name, at * MINUTE_NS, own, n)
    parts = [[row("1", 0), row("2", 30, "resource.created")], [row("3", 59, n=900.0), row("4", 20, own=True)], [row("5", 60)]]
    got = finished(spark, tmp_path, stateful.velocity(streamed(spark, tmp_path, parts, kind)))
    assert sorted((r[3], r[5], r[6]) for r in got) == [("1", 0, 2), ("2", 1, 2), ("3", 1, 302), ("4", 0, 2), ("5", 1, 302)]


def test_a_replay_holds_one_step_on_disk(spark, monkeypatch):
    """Of the steps' tables only the last stays, and nothing of what they shuffled; evidence in passes is the same, and so is
    the verdict of two equal rules."""
    import glob
    import os
    from dataclasses import replace

    from riskloom.plans import risk
    from riskloom.schema import NEW_ACCOUNT_RULE
    from riskloom.sources import shared

    rng = random.Random(4)
    rows = [r | {"email_hash": rng.choice("ab"), "device_hash": rng.choice(["d", None])} for r in random_log(rng, 5, 8)]
    rows += [event(START + 3 * DAY_NS, "subject.deleted", subject="s1", id="gone", mode="permanent"), event(START + DAY_NS, "label", subject="s2", id="told", label="abusive")]
    log = frame(spark, rows)
    shuffled = lambda: set(glob.glob(spark.sparkContext.getConf().get("spark.local.dir") + "/**/shuffle_*.data", recursive=True))
    shared._WRITTEN.clear()
    setting, before = spark.conf.get(shared._CLEANUP, None), shuffled()
    replayed = risk.risk_of_replay(log)
    assert not shuffled() - before and spark.conf.get(shared._CLEANUP, None) == setting
    assert [p.rsplit("/", 1)[1] for p in shared._WRITTEN if os.path.exists(p.removeprefix("file:"))] == ["replayed"]
    got = rows_of(replayed.drop("signals"))
    assert len(got) > len(rows) and replayed.where(f"{column('core.linked_deleted_n')} > 0 and {column('core.linked_labelled_abusive_n')} > 0").count()
    monkeypatch.setattr(risk, "EVIDENCE_POINTS", len(got) // 2)
    assert rows_of(risk.risk_of_replay(log).drop("signals")) == got
    assert rows_of(risk.risk_of_replay(log, [NEW_ACCOUNT_RULE, replace(NEW_ACCOUNT_RULE, name="other")]).drop("signals")) == got


# --- components batch by batch ---


def test_components_after_every_batch(spark, tmp_path):
    from riskloom.operators import graph

    rng = random.Random(6)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(20)][::-1] + [(7, 7), (None, 3), (200, 200)]
    rng.shuffle(edges)
    path, seen = str(tmp_path / "forest"), []
    for batch in range(4):
        part = edges[batch::4]
        seen += part
        for _ in range(2 if batch == 2 else 1):  # one batch is run twice
            graph.add_edges(spark.createDataFrame(part, "src long, dst long"), path, batch)
        got = sorted(map(tuple, graph.components_of(graph.read_forest(spark, path, node_type="long")).collect()))
        assert got == sorted(map(tuple, graph.connected_components(spark.createDataFrame(seen, "src long, dst long")).collect()))
    old = graph.components_of(graph.read_forest(spark, path, 1, "long"))
    assert sorted(map(tuple, old.collect())) == sorted(map(tuple, graph.connected_components(spark.createDataFrame(edges[0::4], "src long, dst long")).collect()))


def test_scratch_deletes_only_its_own(spark):
    import threading

    from riskloom.sources.shared import scratch, written

    kept = []
    with scratch(spark):
        mine = written(spark.range(3), "mine")
        other = threading.Thread(target=lambda: kept.append(written(spark.range(5), "other")))
        other.start()
        other.join()
        with scratch(spark):
            inner = written(spark.range(2), "inner")
        assert mine.count() == 3
    assert kept[0].count() == 5
    for gone in (mine, inner):
        with pytest.raises(Exception, match="FILE|PATH"):
            gone.count()


def test_ingest_by_state_needs_no_log(spark, tmp_path):
    from test_library import raw

    parts = [raw(spark, {"id": "1", "data": '{"recipient_count": 2}'}, {"id": "2", "type": "Bad"}), raw(spark, {"id": "1", "data": '{"recipient_count": 2}'}, {"id": "1", "data": '{"recipient_count": 3}'}, {"id": "3"})]
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in"))
        with stateful.with_state_store(spark):  # the second run has another log: ids are known from state
            query = stateful.ingest(source, str(tmp_path / f"events{k}"), str(tmp_path / f"rejects{k}"), str(tmp_path / "state"))
            assert query.awaitTermination(100)
    ids = lambda name, *c: sorted(tuple(r[x] for x in c) for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert ids("events0", "id") == [("1",)] and ids("events1", "id") == [("3",)]
    assert ids("rejects0", "id", "code") == [("2", "bad_type")] and ids("rejects1", "id", "code") == [("1", "conflict")]


@pytest.mark.parametrize(("ttl", "operator"), [(None, "stateStoreSave"), (3_600_000, "applyInPandasWithState")])
def test_ingest_by_state_tells_ids_by_an_aggregate(spark, tmp_path, ttl, operator):
    """An id's earliest row of its first batch names the hash, whatever comes later; without expiry no id is a call of Python."""
    from test_library import raw

    now = raw(spark, {}).first()["received_ns"]
    row = lambda id_, n, late=0, **more: {"id": id_, "data": f'{{"recipient_count": {n}}}', "received_ns": now + late, **more}
    parts = [
        [row("1", 3, 5), row("1", 2, 1), row("1", 2, 9), row("2", 1), row("2", 1), *[row("", 1)] * 4, row("5", 1, type="Bad")],
        [row("1", 3, 0), row("1", 2, 0), row("1", 3, 2), row("2", 1, -5), row("4", 7, 3), row("4", 6, 2), row("5", 2), row("", 1)],
    ]
    for part in parts:
        raw(spark, *part).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        with stateful.with_state_store(spark):
            query = stateful.ingest(spark.readStream.schema(raw(spark, {}).schema).parquet(str(tmp_path / "in")), str(tmp_path / "events"), str(tmp_path / "rejects"), str(tmp_path / "state"), ttl_ms=ttl)
            assert query.awaitTermination(200)
        assert operator in [o["operatorName"] for o in query.lastProgress["stateOperators"]]
    events, rejects = spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "rejects"))
    assert sorted((r["id"], r["recipient_count"], r["batch"]) for r in events.collect()) == [("1", 2.0, 0), ("2", 1.0, 0), ("4", 6.0, 1), ("5", 2.0, 1)]
    assert not {"first", "seen", "batch_at", "judged"} & set(events.columns)
    got = sorted((r["id"], r["code"], r["batch"]) for r in rejects.collect())
    assert got == sorted([("1", "conflict", 0), *[("", "bad_id", 0)] * 4, ("5", "bad_type", 0), *[("1", "conflict", 1)] * 2, ("4", "conflict", 1), ("", "bad_id", 1)])


def test_the_log_keeps_a_payments_outcome(spark, tmp_path):
    from test_library import raw

    from riskloom.operators.ingest import judge, prepare
    from riskloom.streaming import jobs

    rows = raw(spark, {"id": "1", "type": "payment.attempt", "data": '{"outcome": "declined"}'})
    assert [(r["outcome"], r["judged"]) for r in judge(prepare(rows).withColumn("seq", F.lit(1))).collect()] == [("declined", "accepted")]
    rows.write.parquet(str(tmp_path / "in"))
    jobs.ingest(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "events"), str(tmp_path / "rejects"), str(tmp_path / "state")).awaitTermination()
    assert [r["outcome"] for r in spark.read.parquet(str(tmp_path / "events")).collect()] == ["declined"]

"""What is cut into parts gives the same as the whole: neighbours, running sums, line numbers; and what must be refused."""

import random

import pytest
from pyspark.sql import functions as F
from test_features import START, event, frame

from riskloom.operators import links, metrics, replay, scoring
from riskloom.operators.features import features
from riskloom.operators.graph import connected_components
from riskloom.operators.ranges import running_sum
from riskloom.schema import DAY_NS, HOUR_NS, MINUTE_NS, Rule
from riskloom.sources import jsonl, shared


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_at_a_hub(spark, parts):
    """Every subject touches one key again and again, at instants that often tie."""
    rng = random.Random(parts)
    touches = [("t", "email_hash", rng.choice("hhhk"), f"s{rng.randrange(30):02d}", rng.randrange(60)) for _ in range(400)]
    points = [("t", f"s{k:02d}", str(k), at, at) for k in range(0, 30, 3) for at in (rng.randrange(70),)]
    frames = spark.createDataFrame(points, "tenant string, subject string, point string, now_ns long, cutoff_ns long"), spark.createDataFrame(touches, "tenant string, kind string, hash string, subject string, at_ns long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r["subject"], r["other"], r["truncated"]) for r in links.neighbours_as_of(*frames, kinds=("email_hash",), per_key=4, total=6).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for _, subject, _, _, cutoff in points:
        seen, cut = {}, False
        for key in sorted({h for _, _, h, s, at in touches if s == subject and at < cutoff}):
            last = {}
            for _, _, h, s, at in touches:
                if h == key and s != subject and at < cutoff:
                    last[s] = max(at, last.get(s, -1))
            ranked = sorted(last, key=lambda s: (-last[s], s))
            cut = cut or len(ranked) > 4
            for r, s in enumerate(ranked[:4]):
                seen.setdefault(s, (key, r))
        kept = sorted(seen, key=seen.get)
        want += [(subject, s, cut or len(kept) > 6) for s in kept[:6]]
    assert got == sorted(want)


def test_running_sum(spark):
    rows = [("ab"[k % 2], (k * 37) % 50, k) for k in range(200)]
    got = running_sum(spark.createDataFrame(rows, "g string, x int, v long"), ["g"], ["x", "v"], F.col("v"), "total").collect()
    for g in "ab":
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: (r["x"], r["v"])):
            total += r["v"]
            assert r["total"] == total
    assert len(got) == 200
    assert running_sum(spark.createDataFrame(rows, "g string, x int, v long"), [], ["v"], F.lit(1), "n").where("n <> v + 1").isEmpty()


def test_lines_are_numbered_in_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join("" if k % 10 == 0 else f"line {k}" for k in range(1, 3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonl.read_lines(spark, str(tmp_path / "a.jsonl"))
        assert rows.rdd.getNumPartitions() > 3
        assert sorted((r["line"], r["value"]) for r in rows.collect()) == [(k, f"line {k}") for k in range(1, 3000) if k % 10]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_components_of_a_hub(spark):
    edges = [(0, k) for k in range(1, 300)] + [(300 + k, 301 + k) for k in range(50)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 if k < 300 else 300 for k in range(351)}


def test_replay_order_and_timers(spark):
    """Ties go by (producer, id); a timer comes before the events of its instant and not after an event in between."""
    step = 5 * MINUTE_NS
    start = START // step * step
    rows = [
        event(start, "content.sent", id="b"),
        event(start, "resource.created", id="a"),
        event(start, "label", id="c", label="abusive"),
        event(start + HOUR_NS, "resource.created", id="d"),
        event(start + 2 * HOUR_NS + MINUTE_NS, "resource.created", id="e"),
    ]
    spine, events = replay.replay_points(frame(spark, rows))
    at = {r["point"]: (r["now_ns"] - start, r["cutoff_seq"]) for r in spine.collect()}
    assert {k: v for k, v in at.items() if not k.startswith("timer")} == {"/a": (0, 1), "/b": (0, 2), "/c": (0, 3), "/d": (HOUR_NS, 4), "/e": (2 * HOUR_NS + MINUTE_NS, 5)}
    timers = sorted(v for k, v in at.items() if k.startswith("timer"))
    late = lambda ns: -(-ns // step) * step
    ends = [(HOUR_NS, 3), (2 * HOUR_NS, 4), *[(late(x), 5) for x in (3 * HOUR_NS + MINUTE_NS, DAY_NS, DAY_NS + HOUR_NS, DAY_NS + 2 * HOUR_NS + MINUTE_NS)]]
    assert timers == sorted(ends)
    known = {r["point"]: r["core__resource_total"] for r in features(spine, events).collect()}
    assert (known["/a"], known["/b"], known["/d"], known[f"timer/{start + HOUR_NS}"]) == (1, 1, 2, 1)
    evidence = replay.replay_evidence(spine, events)
    assert evidence.count() == spine.count()
    with pytest.raises(ValueError, match="twice"):
        replay.replay_points(frame(spark, [rows[0], rows[0] | {"subject": "other"}]))


def test_scorers_refuse(spark):
    plain = scoring.Scorer("x", "1", lambda calls: calls, labels=("a", "b"), features=False, text=True)
    rule = Rule("r", scorer="x", inputs=(), text=("t",), labels=("b", "a"), benign_label="a")
    assert plain.refuses(rule, ["r"]) is None and plain.refuses(rule) == "uncalibrated"
    assert plain.refuses(Rule("r", inputs=(), labels=("a",))) == "labels"
    assert plain.refuses(Rule("r", labels=("a", "b"))) == "features"
    assert scoring.local_scorer().refuses(Rule("r", text=("t",))) == "text"
    with pytest.raises(ValueError, match="refuse"):
        scoring.check_scorers([Rule("r", scorer="x")], [plain])
    with pytest.raises(ValueError, match="names"):
        scoring.score_calls(spark.range(1), [plain, plain])


def test_gates_and_recordings_refuse(spark):
    found = spark.createDataFrame([("r", "s", "full", "recall", 0.5)], "rule string, scorer string, slice string, metric string, value double")
    floors = lambda *rows: spark.createDataFrame(list(rows), "rule string, scorer string, slice string, metric string, floor double")
    assert metrics.gate(found, floors(("r", "s", "full", "recall", 0.6))).count() == 1
    with pytest.raises(LookupError):
        metrics.gate(found, floors(("r", "s", "early", "recall", 0.6)))
    for bad in (("r", "s", "full", "recall", 1.5), ("r", "", "full", "recall", 0.5)):
        with pytest.raises(ValueError, match="floor"):
            metrics.gate(found, floors(bad))
    calls = spark.createDataFrame([("s", "1", "m", "p", "h")], "scorer string, version string, model string, prompt_version string, input_hash string")
    with pytest.raises(ValueError, match="another corpus"):
        metrics.replay_recorded(calls, calls.withColumns({"probs": F.create_map(F.lit("a"), F.lit(1.0)), "corpus_hash": F.lit("old")}), "new")


def test_scratch_is_deleted(spark):
    with shared.scratch(spark):
        kept = shared.written(spark.range(3), "three").count()
        path = shared._WRITTEN[-1]
    assert kept == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)

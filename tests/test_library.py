"""Text, ingest, links, scoring, metrics, sources and streaming on small hand-made tables."""

import hashlib
import hmac
import json
import math
import time

import pytest
from pyspark.sql import functions as F
from test_features import START, event, frame, spine

from riskloom.functions.scalar import family_keys, floor_div, hmac_sha256, parse_rfc3339, wilson
from riskloom.functions.text import canonical, looks_like_email, mask_emails, match_brands, skeleton, skeleton_of, tokenise, truncate_utf8
from riskloom.operators import ingest, links, metrics, replay, scoring, subjects
from riskloom.operators.graph import connected_components
from riskloom.plans.queries import QUERIES
from riskloom.schema import BRANDS, DAY_NS, LINK_KINDS, MINUTE_NS, NEW_ACCOUNT_RULE, CombineParams, Rule
from riskloom.sources import jsonl


# --- text ---


@pytest.mark.parametrize(("text", "want"), [("g00gle", "google"), ("paypa1", "paypal"), ("am4z0n", "amazon"), ("Order 12345", "order 12345"), ("ORDER #1", "order #1"), ("v1", "v1"), ("PayPaI", "paypal"), ("Café  au\tlait ", "cafe au lait"), ("раураl", "paypal"), ("$un @t", "sun at"), ("", "")])
def test_skeleton(spark, text, want):
    assert skeleton_of(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(skeleton(F.col("t"))).first()[0] == want


def test_brand_matching(spark):
    cases = {
        "PAYPAL INTEGRATION": ([], ["PayPal"]),
        "Join the Facebook fan club": (["Facebook"], []),
        "MyPayPalHelp": (["PayPal"], ["PayPal"]),
        "ups and downs": ([], []),
        "UPS parcel": (["UPS"], ["UPS"]),
        "ＵＰＳ parcel": (["UPS"], ["UPS"]),
        "Bank of America": (["Bank of America"], ["Bank of America"]),
        "tik tok": (["TikTok"], ["TikTok"]),
        "booking.com deal": (["Booking.com"], ["Booking.com"]),
    }
    got = {r["text"]: r for r in match_brands(spark.createDataFrame([(t,) for t in [*cases, None, ""]], "text string"), BRANDS).collect()}
    for text, (names, lines) in cases.items():
        assert (got[text]["name_brands"], got[text]["subject_brands"]) == (names, lines), text
    assert got["PAYPAL INTEGRATION"]["has_integration"]


def test_text_columns(spark):
    df = spark.createDataFrame([("write a.b@ex.org or ｃ＠ex.org",), ("é" * 40,), (None,)], "t string")
    masked, cut, _ = (r[0] for r in df.select(mask_emails(F.col("t"))).collect())
    assert masked == "write @ or @"
    assert [r[0] for r in df.select(truncate_utf8(F.col("t"), 33)).collect()][1] == "é" * 16
    assert df.limit(1).select(tokenise(skeleton(F.lit("Fi-Sh, is"))), canonical(F.lit("a​i"))).first()[:] == (["fl", "sh", "ls"], "al")


def test_scalars(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00.000000001Z",), ("2024-01-01T01:00:00+01:00",), ("2024-01-01",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_rfc3339(F.col("t"))).collect()]
    assert [None if g is None else (g["at_ns"], g["utc"]) for g in got] == [(1704067200000000001, True), (1704067200000000000, False), None, None]
    want = hmac.new(b"k" * 70, "é".encode(), hashlib.sha256).hexdigest()
    assert df.limit(1).select(hmac_sha256(b"k" * 70, F.lit("é"))).first()[0] == want
    low, high = df.limit(1).select(wilson(F.lit(58), F.lit(71))).first()[0]
    assert (round(low, 4), round(high, 4)) == (0.7115, 0.8898)
    rows = spark.createDataFrame([("burst", "x"), ("churn_card", "acct_gen_churn_card_1_3"), ("churn_card", "acct_gen_churn_card_1_2")], "c string, s string")
    assert [r[0] for r in rows.select(family_keys(F.col("c"), F.col("s"))).collect()] == [["burst"], ["churn_incarnation_ge3"], []]


# --- ingest ---


def raw(spark, *rows):
    base = {"tenant": "t", "producer": "p", "id": "1", "subject": "s", "type": "content.sent", "at": "2024-01-01T00:00:00Z", "data": "{}", "received_ns": 1704067200000000000, "backfill": False} | dict.fromkeys(LINK_KINDS, "")
    kind = ", ".join(f"{c} {'long' if c == 'received_ns' else 'boolean' if c == 'backfill' else 'string'}" for c in base)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], kind)


@pytest.mark.parametrize(
    ("row", "code"),
    [
        ({}, None),
        ({"id": ""}, "bad_id"),
        ({"id": "x" * 65, "subject": ""}, "bad_id"),
        ({"subject": None}, "bad_subject"),
        ({"type": "Bad"}, "bad_type"),
        ({"at": "2024-01-01T00:00:00+01:00"}, "bad_timestamp"),
        ({"at": "2024-01-03T00:00:00Z"}, "bad_timestamp"),
        ({"at": "2024-01-03T00:00:00Z", "backfill": True}, None),
        ({"ua_hash": "abc"}, "bad_links"),
        ({"asn": "AS 1"}, "bad_links"),
        ({"data": '{"recipient_count": 2}'}, None),
        ({"data": '{"recipient_count": 1.5}'}, "redaction_failed"),
        ({"data": '{"recipient_count": "2"}'}, "redaction_failed"),
        ({"data": '{"recipient_domain": null}'}, "redaction_failed"),
        ({"data": '{"recipient_hash": "abcdefgh", "recipient_count": 2}'}, "redaction_failed"),
        ({"data": '{"recipient_hash": "short"}'}, "redaction_failed"),
        ({"data": '{"subject_line": "mail a@b.org now"}'}, None),
        ({"data": '{"first_link_host": "a@b.org"}'}, "redaction_failed"),
        ({"data": '{"unlisted": {"deep": ["a@b.org"]}}'}, "redaction_failed"),
        ({"data": '{"subject_line": "tab\\u0009here"}'}, "redaction_failed"),
        ({"data": '{"subject_line": "back\\\\nslash"}'}, None),
        ({"type": "subject.deleted", "data": '{"mode": "maybe"}'}, "redaction_failed"),
        ({"type": "custom.kind", "data": json.dumps({"x": "y" * 9000})}, "too_large"),
        ({"data": "not json"}, "redaction_failed"),
    ],
)
def test_reject_codes(spark, row, code):
    assert ingest.prepare(raw(spark, row)).first()["reject_code"] == code


def test_redaction_keeps_listed_fields(spark):
    got = ingest.prepare(raw(spark, {"data": '{"subject_line": "I mail a@b.org", "unlisted": 1, "recipient_is_own_identity": true}'})).first()
    assert (got["subject_line"], got["subject_line_skeleton"], got["recipient_is_own_identity"]) == ("I mail @", "l mail a", True)
    assert "unlisted" not in got["data"] and got["redaction_version"] == 2


def test_idempotency(spark):
    rows = spark.createDataFrame([("t", "p", "1", "a", 1, 0), ("t", "p", "1", "a", 2, 0), ("t", "p", "1", "b", 3, 0), ("t", "p", "2", "x", 1, 0)], "tenant string, producer string, id string, body_hash string, received_ns long, seq int")
    got = sorted((r["id"], r["received_ns"], r["outcome"]) for r in ingest.classify(rows).collect())
    assert got == [("1", 1, "accepted"), ("1", 2, "duplicate"), ("1", 3, "conflict"), ("2", 1, "accepted")]
    old = spark.createDataFrame([("t", "p", "2", "y")], "tenant string, producer string, id string, body_hash string")
    assert {r["outcome"] for r in ingest.classify(rows.where("id = '2'"), old).collect()} == {"conflict"}


def test_labels_and_keys(spark):
    labels = spark.createDataFrame([("t", "s", "abusive", "operator", "me", "", "", "r"), ("t", "s", "odd", "operator", "me", "", "", "r"), ("t", "x", "abusive", "operator", "me", "", "", "r"), ("t", "s", "abusive", "guess", "me", "", "", None), ("t", "s", "benign", "outcome", "", "", "", None)], "tenant string, subject string, label string, source string, actor string, note string, evidence string, rule string")
    rules = spark.createDataFrame([("r", ["benign", "abusive"])], "rule string, labels array<string>")
    known = spark.createDataFrame([("t", "s")], "tenant string, subject string")
    codes = sorted(str(r["reject_code"]) for r in ingest.check_labels(labels, rules, known).collect())
    assert codes == ["None", "bad_label", "bad_source", "missing_actor", "unknown_subject"]
    rows = spark.createDataFrame([({"velocity": 1.0, "core.x": 2.0},)], "features map<string,double>")
    assert ingest.rename_features(rows, {"velocity": "core.velocity"}).first()["features"] == {"core.velocity": 1.0, "core.x": 2.0}
    with pytest.raises(ValueError, match="flat"):
        ingest.rename_features(rows, {"other": "core.o"})


# --- links ---


def linked(at, subject, card, event_type="resource.created", **data):
    return event(at, event_type, subject=subject, card_fingerprint_hash=card, **data)


def test_neighbours_are_as_of_and_capped(spark):
    rows = [linked(START, "me", "c")] + [linked(START + k, f"n{k}", "c") for k in range(1, 6)] + [linked(START + 100, "late", "c")]
    rows += [event(START + 50, "subject.deleted", subject="n1", mode="permanent"), event(START + 60, "label", subject="n2", label="abusive"), event(START + 60, "label", subject="n3", label="benign")]
    ev, at = frame(spark, rows), spine(spark, [("me", START + 99)])
    touches = links.link_touches(ev)
    got = links.neighbours_as_of(at, touches).collect()
    assert {r["other"] for r in got} == {"n1", "n2", "n3", "n4", "n5"} and not any(r["truncated"] for r in got)
    got = links.neighbours_as_of(at, touches, per_key=2).collect()
    assert {r["other"] for r in got} == {"n5", "n4"} and all(r["truncated"] for r in got)
    got = links.neighbours_as_of(at, touches, total=3).collect()
    assert {r["other"] for r in got} == {"n5", "n4", "n3"} and all(r["truncated"] for r in got)
    e = links.evidence_as_of(at, ev).first()
    assert (e["deleted_n"], e["labelled_n"], e["fingerprint_shared"], e["truncated"]) == (1, 1, True, False)
    e = links.evidence_as_of(spine(spark, [("me", START + 49)]), ev).first()
    assert (e["deleted_n"], e["labelled_n"]) == (0, 0)
    found = links.neighbours(ev.where("subject = 'me'").select("tenant", "subject").distinct(), links.link_summary(touches))
    assert links.current_outcomes(found, ev).first()[2:] == (1, 1)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(edges.limit(0)).count() == 0
    rows = [linked(START, "b", "c1"), linked(START, "x", "c1"), linked(START, "x", "c2"), linked(START, "a", "c2"), linked(START, "z", "c9")]
    labelled = spark.createDataFrame([("b",), ("a",), ("z",), ("alone",)], "subject string")
    got = {r["subject"]: r["cluster"] for r in links.link_clusters(links.link_touches(frame(spark, rows)), labelled).collect()}
    assert got == {"a": "a", "b": "a", "z": "z", "alone": "alone"}


# --- scoring ---


def outcome(rule, status="scored", risk=0.5, mode="advise", text_only=False):
    return ("t", "s", rule, mode, status, risk if status == "scored" else None, False, None, text_only)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([outcome("a", risk=0.85)], (0.85, "high", False)),
        ([outcome("a", risk=0.1), outcome("t", risk=0.9, text_only=True)], (0.399999, "low", False)),
        ([outcome("a", risk=0.4), outcome("t", risk=0.9, text_only=True)], (0.9, "high", False)),
        ([outcome("a", "unscored")], (0.0, "unknown", True)),
        ([outcome("a", risk=0.5), outcome("b", "unscored")], (0.5, "medium", True)),
        ([outcome("a", risk=0.9, mode="shadow")], (0.0, "unknown", False)),
    ],
)
def test_combine(spark, rows, want):
    df = spark.createDataFrame(rows, "tenant string, subject string, rule string, mode string, status string, risk double, flagged boolean, error_code string, text_only boolean")
    got = scoring.combine(df).first()
    assert (round(got["score"], 6), got["tier"], got["degraded"]) == want
    assert scoring.combine(df, params=CombineParams(medium=0.9, high=0.5)).first()["tier"] == "unknown"


def test_plan_and_outcomes(spark):
    points = spark.createDataFrame([("t", "s", {"core.subject_age_h": 1.4, "core.upgraded": 1.0}, {"name_skeleton": ["x"]})], "tenant string, subject string, features map<string,double>, text map<string,array<string>>")
    rules = scoring.rules_table(spark, [NEW_ACCOUNT_RULE, Rule("late", stage={"min_local_risk": 0.5}), Rule("vendor", scorer="v")])
    plan = scoring.plan_calls(points, rules)
    got = {r["rule"]: r for r in scoring.outcomes(scoring.score_local(plan)).collect()}
    assert got["new_account_velocity"]["status"] == "scored" and abs(got["new_account_velocity"]["risk"] - 1 / (1 + math.exp(4.5 + 0.028 - 1.3))) < 1e-12
    assert got["late"]["error_code"] == "staged" and got["vendor"]["error_code"] == "unknown_scorer"
    last = spark.createDataFrame([("t", "s", "new_account_velocity", 0.7, got["new_account_velocity"]["input_hash"])], "tenant string, subject string, rule string, last_risk double, last_hash string")
    later = {r["rule"]: r["skip_reason"] for r in scoring.plan_calls(points, rules, last).collect()}
    assert later == {"new_account_velocity": "input_unchanged", "late": None, "vendor": None}
    aged = points.withColumn("features", F.create_map(F.lit("core.subject_age_h"), F.lit(1.9), F.lit("core.upgraded"), F.lit(1.0)))
    assert {r["input_hash"] for r in scoring.plan_calls(aged, rules).collect()} == {r["input_hash"] for r in plan.collect()}
    odd = points.withColumn("features", F.create_map(F.lit("core.upgraded"), F.lit(float("nan"))))
    assert {r["input_hash"] for r in scoring.plan_calls(odd, rules).collect()} == {""}
    stored = spark.createDataFrame([("t", "s", "new_account_velocity", {"benign": 0.2, "suspicious": 0.4, "abusive": 0.4})], "tenant string, subject string, rule string, probs map<string,double>")
    carried = scoring.carry_unchanged(scoring.score_local(scoring.plan_calls(points, rules, last)), stored)
    assert abs({r["rule"]: r for r in scoring.outcomes(carried).collect()}["new_account_velocity"]["risk"] - 0.8) < 1e-12
    bad = scoring.score_local(plan).withColumn("probs", F.create_map(F.lit("benign"), F.lit(0.5)))
    assert {r["error_code"] for r in scoring.outcomes(bad).where("skip_reason is null").collect()} == {"invalid_result"}


def test_subjects(spark):
    v = spark.createDataFrame([("t", "s", "r", "scored", "advise", None, 0.3, "h1", 1, "1", 5), ("t", "s", "r", "unscored", "advise", "deadline", None, "h2", 2, "2", 6), ("t", "s", "r", "scored", "advise", None, 0.9, "h0", 0, "0", 6)], "tenant string, subject string, rule string, status string, mode string, error_code string, risk double, input_hash string, scored_ns long, id string, dirty_seq_at_start long")
    got = subjects.latest_verdicts(v).first()
    assert (got["status"], got["last_risk"], got["last_hash"]) == ("unscored", 0.3, "h1")
    assert {r["id"] for r in subjects.current_round(v).collect()} == {"2", "0"}


# --- evaluation ---


def records(spark, rows):
    return spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "subject string, positive boolean, unscored boolean, risk double, flagged boolean, error_code string, category string")


def test_metrics(spark):
    r = records(spark, [(True, False, 0.9, True, None, "burst"), (True, True, None, False, "missing_slice", "burst"), (False, False, 0.9, True, None, ""), (False, False, 0.2, False, None, ""), (False, True, None, False, "scorer_error", "")])
    c = metrics.confusion(r).first()
    assert (c["tp"], c["fp"], c["tn"], c["fn"], c["unscored"], c["missing_slice"], c["total"]) == (1, 1, 1, 1, 2, 1, 5)
    assert metrics.auroc(r).first()["auroc"] == 0.75  # one tie, one win
    assert metrics.family_recall(r).first()["recall"] == 0.5
    assert metrics.auroc(r.where("positive")).first()["auroc"] is None
    assert metrics.calibration_error(r.limit(0)).first()["ece"] is None
    bins = records(spark, [(True, False, 0.95, True, None, ""), (False, False, 0.5, True, None, "")])
    assert abs(metrics.calibration_error(bins).first()["ece"] - (0.05 + 0.5) / 2) < 1e-12
    floors = spark.createDataFrame([("ece", 0.1), ("precision", 0.4), ("unheard_of", 0.1)], "metric string, floor double")
    assert {(g["metric"], g["undefined"]) for g in metrics.gate(metrics.long_metrics(r), floors).collect()} == {("ece", False), ("unheard_of", True)}


def test_recorded_scores(spark):
    key = "scorer string, version string, model string, prompt_version string, input_hash string"
    calls = spark.createDataFrame([("v", "1", "m", "p", "h")], key)
    stored = spark.createDataFrame([("v", "1", "m", "p", "h", {"benign": 1.0})], key + ", probs map<string,double>")
    assert metrics.replay_recorded(calls, stored).first()["probs"] == {"benign": 1.0}
    with pytest.raises(LookupError):
        metrics.replay_recorded(calls, stored.limit(0))


def test_points_from_labels(spark):
    rows = [event(START, "subject.created", subject="a"), event(START + DAY_NS, "content.sent", subject="a"), event(START + 5, "subject.deleted", subject="d", mode="permanent"), event(START + 9, "resource.created", subject="d")]
    ts = lambda k: f"2023-11-14T22:13:20.{k:09d}Z"
    labels = spark.createDataFrame(
        [("t", "a", {"early_15m": ts(10)}), ("t", "none", {"full": ts(1)}), ("t", "d", {"full": ts(8)}), ("t", "a2", None)], "tenant string, subject string, decision_at map<string,string>"
    )
    at, bad = replay.points_from_labels(labels, frame(spark, rows))
    assert sorted((r["subject"], r["point"], r["now_ns"] - START) for r in at.collect()) == [("a", "early_15m", 10), ("a", "full", DAY_NS + 1)]
    assert sorted((r["subject"], r["code"]) for r in bad.collect()) == [("a2", "zero_events"), ("d", "decision_after_deletion"), ("none", "zero_events")]


def test_replay_at_every_event(spark):
    rows = [event(START, "resource.created"), event(START + MINUTE_NS, "content.sent", subject_line="Paypal")]
    at = replay.every_event(frame(spark, rows))
    assert at.count() == 2
    texts = replay.collect_texts(frame(spark, rows), ("tenant", "subject")).first()["text"]
    assert texts == {"subject_line_skeleton": ["paypal"]}
    with pytest.raises(ValueError, match="twice"):
        replay.every_event(frame(spark, [rows[0], rows[0]]))


# --- sources ---


def test_event_log(spark, tmp_path):
    good = {"subject": "s", "type": "content.sent", "at": "2024-01-01T00:00:00Z", "data": {"subject_line": "hi", "recipient_domain": None}}
    lines = [json.dumps(good), "", "{broken", json.dumps(good | {"extra": 1}), json.dumps(good | {"subject": "u", "at": "soon"}), json.dumps(good | {"type": "label", "data": {"label": "abusive"}}), json.dumps(good | {"type": "label", "data": {}}), json.dumps({"type": "x", "at": good["at"]}), json.dumps(good | {"id": "7", "subject": "w", "data": {"first_link_host": "a@b.org"}})]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    activity, labels, errors, tainted = jsonl.read_events(spark, str(tmp_path / "log.jsonl"))
    assert [(r["id"], r["subject_line"], r["recipient_domain"]) for r in activity.collect()] == [("replay-line-1", "hi", None)]
    assert [r["label"] for r in labels.collect()] == ["abusive"]
    assert sorted((r["line"], r["code"]) for r in errors.collect()) == [(3, "bad_json"), (4, "bad_json"), (5, "bad_at"), (7, "bad_label_event"), (8, "missing_field"), (9, "redact_failed")]
    assert {r["subject"] for r in tainted.collect()} == {"s", "u", "w"}
    assert {r["code"]: r["n"] for r in jsonl.skipped_by_code(errors).collect()}["bad_json"] == 2
    with pytest.raises(ValueError, match="line 3"):
        jsonl.skipped_by_code(errors, strict=True)


def test_labels_and_corpus_files(spark, tmp_path):
    rows = [{"subject": "a", "label": "x", "source": "s"}, {"subject": "a", "label": "y", "source": "s"}, {"subject": "b", "label": "", "source": "s"}, {"subject": "b", "label": "x", "source": "s"}, {"subject": "c", "odd": 1}]
    (tmp_path / "labels.jsonl").write_text("\n".join(map(json.dumps, rows)))
    good, errors = jsonl.read_labels(spark, str(tmp_path / "labels.jsonl"))
    assert sorted((r["subject"], r["label"]) for r in good.collect()) == [("a", "x"), ("b", "x")]
    assert sorted((r["line"], r["code"]) for r in errors.collect()) == [(2, "duplicate_subject"), (3, "missing_field"), (5, "bad_json")]
    base = {"feature_key_space": "ns-v1", "id": "1", "input": {"features": {"core.x": 1.0}}, "label": "l", "source": "s", "meta": {}}
    rows = [base, base, base | {"id": ""}, base | {"id": "2", "label": ""}, base | {"id": "2"}, base | {"id": "3", "split": "x"}, base | {"id": "4", "input": {}}, base | {"id": "5", "input": {"features": {"old": 1.0}}}, base | {"id": "6", "input": {"features": {"Bad": 1.0}}}, base | {"id": "7", "feature_key_space": "v0"}]
    (tmp_path / "corpus.jsonl").write_text("\n".join(map(json.dumps, rows)))
    good, errors = jsonl.read_corpus(spark, str(tmp_path / "corpus.jsonl"), {"old": "core.old"})
    assert [r["id"] for r in good.collect()] == ["1"]
    assert [r["code"] for r in errors.orderBy("line").collect()] == ["duplicate_id", "missing_id", "missing_label", "duplicate_id", "bad_split", "empty_input", "feature_renamed", "invalid_feature_name", "feature_key_space"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("t", "p", "1", "a", 1, 0, "2024-01-01"), ("t", "p", "1", "a", 2, 0, "2024-01-01")], "tenant string, producer string, id string, body_hash string, received_ns long, seq int, at string").withColumn("at", F.to_timestamp("at"))
    assert sorted(r["outcome"] for r in jsonl.append_events(rows, str(tmp_path / "log")).collect()) == ["accepted", "duplicate"]
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    assert jsonl.dataset_hash(rows) == jsonl.dataset_hash(rows.orderBy(F.desc("received_ns"))) != jsonl.dataset_hash(rows.limit(1))
    (tmp_path / "in.jsonl").write_text('{"id": "1", "features": {"core.upgraded": 1.0}}\n')
    jsonl.score_files(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"), lambda df: df.select("id", F.lit(0.5).alias("risk")))
    assert spark.read.json(str(tmp_path / "out")).first()["risk"] == 0.5
    (tmp_path / "in.jsonl").write_text("{bad\n")
    with pytest.raises(ValueError, match="bad_json"):
        jsonl.score_files(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out2"), lambda df: df)
    brands = spark.createDataFrame([("A", ["x"], False), ("A", ["y", "x"], None), ("B", None, True)], "name string, aliases array<string>, case_sensitive boolean")
    assert sorted(map(tuple, jsonl.read_brands(brands).collect())) == [("A", ["x", "y"], False), ("B", [], True)]


def test_instants_are_divided_exactly(spark):
    """Whole microseconds and milliseconds that a double of nanoseconds misses by one."""
    micros = [1704101451078096, 1704099014907856, -1704101451078097, 0]
    rows = spark.createDataFrame([(m * 1000 + r, m) for m in micros for r in (0, 999)], "ns long, micros long")
    assert rows.where(floor_div(F.col("ns"), 1000) != F.col("micros")).isEmpty()
    text = rows.where("ns > 0 and ns % 1000 = 0").select("micros", F.date_format(F.timestamp_micros("micros"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("text"))
    assert text.where(F.unix_micros(parse_rfc3339(F.col("text"))["at"]) != F.col("micros")).isEmpty()


def test_emails_beside_long_runs(spark):
    """A long run without an @ takes no more time than its length, and what is masked stays the same."""
    plain = r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.[\p{L}]{2,}"
    texts = ["a@b.com1@c.org", "x.y+z@q.de, b@", "@@a@b.cc@d.ee", "a@b.com.@c.de", "ü_ä@ö.öö-a@b.cc", "a@b@c.dd e%f@g.h.ii"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert rows.where(mask_emails(F.col("text")) != F.regexp_replace("text", plain, "@")).isEmpty()
    assert rows.where(looks_like_email(F.col("text")) != F.col("text").rlike(plain)).isEmpty()
    began = time.time()
    long = spark.range(8).select(F.repeat(F.lit("x"), 400_000).alias("text"))
    assert long.where(looks_like_email(F.col("text")) | mask_emails(F.col("text")).contains("@")).isEmpty()
    assert time.time() - began < 20


def test_field_rules_at_the_size_cap(spark, tmp_path):
    docs = [(5 + 6 * k, 8168 + k) for k in range(12)]
    spark.createDataFrame(docs, "doc_id long, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["reject_code"] for r in QUERIES["field_rules"](spark, str(tmp_path)).collect()}
    assert got == {k: "too_large" if n > 8170 else None for k, n in docs}


def test_log_rows_are_checked_once(spark, tmp_path):
    """What is read off a log file shares one stored table of checked rows."""
    line = {"id": "1", "subject": "s", "type": "custom.kind", "at": "2024-01-01T00:00:00Z", "data": {"note": "plain"}}
    (tmp_path / "log.jsonl").write_text("\n".join(json.dumps(x) for x in (line, line | {"odd": 1})))
    activity, _, errors, tainted = jsonl.read_events(spark, str(tmp_path))
    assert [len(df.inputFiles()) > 0 and all("checked" in f for f in df.inputFiles()) for df in (activity, errors, tainted)] == [True] * 3
    assert (activity.count(), errors.count(), [r["subject"] for r in tainted.collect()]) == (1, 1, ["s"])


def test_skeletons_of_long_texts(spark):
    """As slow as its characters, not as a step of Python for each; digits spell letters only beside two of them."""
    assert [skeleton_of(t) for t in ("pay1 a1 1b 12ab 4a4", "Pаypаl 1Iı", "É́ﬁ ②x3y")] == ["payl a1 1b l2ab 4a4", "paypal lll", "efi 2xey"]
    began = time.process_time()
    assert len(skeleton_of("naïve prose of words " * 100_000)) == 21 * 100_000 - 1
    assert time.process_time() - began < 1

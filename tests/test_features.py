"""Features against a plain evaluator of one subject on random histories, and their window edges."""

import math
import random

from riskloom.operators.features import features
from riskloom.schema import DAY_NS, EVENTS, FEATURES, HOUR_NS, LOCAL_WEIGHTS, MINUTE_NS, WEBMAIL, column

START = 1_700_000_000_000_000_000


def event(at_ns, event_type, /, **data):
    row = {f.name: None for f in EVENTS} | {"tenant": "t", "producer": "", "id": f"e{at_ns}-{random.random()}", "subject": "s", "type": event_type, "at_ns": at_ns}
    return row | data


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in EVENTS) for r in rows], EVENTS)


def spine(spark, points):
    return spark.createDataFrame([("t", s, str(k), now, now + 1) for k, (s, now) in enumerate(points)], "tenant string, subject string, point string, now_ns long, cutoff_ns long")


def plain(events, now):
    """All features of one subject's events, one loop each."""
    ev = [e for e in events if e["at_ns"] <= now]
    out = dict.fromkeys(FEATURES, 0.0)
    if not ev:
        return out
    first = min(e["at_ns"] for e in ev)
    inside = lambda e, w: now - w < e["at_ns"] <= now
    n = lambda e: int(min(300, e["recipient_count"])) if e["recipient_count"] and e["recipient_count"] > 0 and e["recipient_count"] == int(e["recipient_count"]) else 1
    created = [e for e in ev if e["type"] == "resource.created"]
    keys = [e for e in created if (e["kind"] or "").strip().lower() in ("key", "keys", "api_key", "api_keys", "api-key", "apikey", "api key")]
    sent = [e for e in ev if e["type"] == "content.sent"]
    reach = [e for e in sent if not e["recipient_is_own_identity"]]
    pay = [e for e in ev if e["type"] == "payment.attempt"]
    ok = [e["at_ns"] for e in pay if e["outcome"] == "succeeded"]
    external = [e["at_ns"] for e in sent if e["recipient_is_own_identity"] is False]
    paid = [e["at_ns"] for e in ev if e["type"] == "subscription.changed" and e["status"] == "active" and (e["amount_minor"] or 0) > 0]

    def peak(low, high):
        rows = [e for e in reach if low < e["at_ns"] <= high]
        return max([sum(n(x) for x in rows if e["at_ns"] - 10 * MINUTE_NS < x["at_ns"] <= e["at_ns"]) for e in rows] or [0])

    base = max(1, peak(now - 30 * DAY_NS, now - DAY_NS))
    decay = min(1, max(0.2, 1 - ((now - first) / DAY_NS - 3) / 27))
    burst = lambda v: min(300, v / base) * decay
    hour = [e for e in reach if inside(e, HOUR_NS)]
    windowed = created + sent
    webmail = lambda e: (e["recipient_domain"] or "").strip().lower() in WEBMAIL
    total = sum(n(e) for e in reach)
    out |= {
        "core.subject_age_h": min(24, max(0, (now - first) / HOUR_NS)),
        "core.resource_velocity_1h": sum(inside(e, HOUR_NS) for e in created),
        "core.resource_total": len(created),
        "core.credential_velocity_1h": sum(inside(e, HOUR_NS) for e in keys),
        "core.credential_total": len(keys),
        "core.upgrade_delay_min": min(1440, max(0, ((min(paid) if paid else now) - first) / MINUTE_NS)),
        "core.upgraded": float(bool(paid)),
        "core.declines_before_first_success": sum(e["outcome"] == "declined" and (not ok or e["at_ns"] <= min(ok)) for e in pay),
        "core.first_funding_prepaid": float(bool(ok) and min((e["at_ns"], e["producer"], e["id"], e["funding"]) for e in pay if e["outcome"] == "succeeded")[3] == "prepaid"),
        "brand.name_has_at": float(any("@" in (e["name"] or "") for e in ev if e["type"].startswith("resource."))),
        "email.first_day_distinct_domains": math.log1p(len({e["recipient_domain"].strip().lower() for e in sent if e["recipient_domain"] and e["at_ns"] <= first + DAY_NS})) * 10 / math.log1p(10),
        "email.self_send_before_external": min(2, sum(e["recipient_is_own_identity"] is True and (not external or e["at_ns"] <= min(external)) for e in sent)),
        "core.burst_ratio_24h_vs_lifetime": sum(inside(e, DAY_NS) for e in windowed) / len(windowed) if windowed else 0,
        "email.sends_10m_max": burst(peak(now - DAY_NS, now)),
        "email.sends_1h": burst(sum(n(e) for e in hour)),
        "email.sends_first_day": min(300, sum(n(e) for e in reach if e["at_ns"] <= first + DAY_NS)),
        "email.webmail_recipient_share": sum(n(e) for e in reach if webmail(e)) / total if total else 0,
        "email.webmail_sends_1h": burst(sum(n(e) for e in hour if webmail(e))),
        "email.distinct_recipients_1h": burst(len({e["recipient_hash"] for e in hour if e["recipient_hash"]}) + sum(n(e) for e in hour if not e["recipient_hash"])),
    }
    return out


def random_history(rnd, subject):
    out = []
    for _ in range(rnd.randrange(1, 60)):
        at = START + rnd.choice((MINUTE_NS, HOUR_NS, DAY_NS)) * rnd.randrange(40) + rnd.choice((0, 0, 1, -1))
        kind = rnd.choice(("subject.created", "payment.attempt", "subscription.changed", "resource.created", "resource.deleted", "content.sent", "content.sent"))
        out.append(
            event(
                at, kind, subject=subject, outcome=rnd.choice(("succeeded", "declined")) if kind == "payment.attempt" else None, funding=rnd.choice(("prepaid", "credit")), status=rnd.choice(("active", "off")),
                amount_minor=float(rnd.choice((0, 100))), kind=rnd.choice(("Key", " api key", "agent", None)), name=rnd.choice(("a@b", "plain", None)), recipient_domain=rnd.choice(("gmail.com", " Gmail.com", "x.org", "", None)),
                recipient_count=rnd.choice((None, 0.0, 1.5, 3.0, 300.0, 10000.0)), recipient_is_own_identity=rnd.choice((True, False, None)), recipient_hash=rnd.choice((None, "", "h1", "h2")),
            )
        )
    return out


def test_random_histories(spark):
    rnd = random.Random(4)
    rows, points = [], []
    for k in range(40):
        own = random_history(rnd, f"s{k}")
        rows += own
        points += [(f"s{k}", rnd.choice(own)["at_ns"] + rnd.choice((0, 1, HOUR_NS - 1, HOUR_NS, DAY_NS, 25 * DAY_NS))) for _ in range(3)]
    points.append(("nobody", START))
    got = features(spine(spark, points), frame(spark, rows)).collect()
    assert len(got) == len(points)
    for r in got:
        want = plain([e for e in rows if e["subject"] == r["subject"]], r["now_ns"])
        for f in FEATURES:
            assert abs(r[column(f)] - want[f]) < 1e-9, (r["subject"], f)


def test_window_edges(spark):
    now = START + 10 * DAY_NS
    rows = [event(now - HOUR_NS, "resource.created"), event(now - HOUR_NS + 1, "resource.created"), event(now, "resource.created"), event(now + 1, "resource.created")]
    (got,) = features(spine(spark, [("s", now)]), frame(spark, rows)).collect()
    assert got["core__resource_velocity_1h"] == 2
    assert got["core__resource_total"] == 3  # the cutoff is a nanosecond after now
    live = spark.createDataFrame([("t", "s", "0", now, now + HOUR_NS)], "tenant string, subject string, point string, now_ns long, cutoff_ns long")
    (got,) = features(live, frame(spark, rows)).collect()
    assert (got["core__resource_velocity_1h"], got["core__resource_total"]) == (2, 4)
    assert got["next_rescore_ns"] == -(-(now + 1) // (5 * MINUTE_NS)) * 5 * MINUTE_NS


def test_account_created_at_and_no_events(spark):
    rows = [event(START, "subject.created", account_created_at="2020-01-01T00:00:00Z")]
    got = {r["subject"]: r for r in features(spine(spark, [("s", START + 1), ("none", START)]), frame(spark, rows)).collect()}
    assert got["s"]["core__subject_age_h"] == 24 and got["s"]["next_rescore_ns"] is None
    assert all(got["none"][column(f)] == 0 for f in FEATURES) and got["none"]["next_rescore_ns"] is None


def test_brand_features(spark):
    at = START
    rows = [
        event(at, "resource.created", name="PayPaI Support", kind="agent"),
        event(at + 1, "resource.created", name="Stripe Webhook Relay", kind="agent"),
        event(at + 2, "content.sent", subject_line="Your Netflix and paypal and Stripe bill", recipient_is_own_identity=False),
        event(at + 3, "content.sent", subject_line="Amazon", recipient_is_own_identity=True),
    ]
    (got,) = features(spine(spark, [("s", at + 10)]), frame(spark, rows)).collect()
    assert got["brand__name_match"] == 1
    assert got["email__subject_brand_match"] == 1  # Netflix; PayPal is in a name, Stripe is exempt, Amazon went to itself
    rows.append(event(at + 4, "resource.deleted", name="stripe webhook relay", kind="agent"))
    (got,) = features(spine(spark, [("s", at + 10)]), frame(spark, rows)).collect()
    assert got["email__subject_brand_match"] == 2  # the integration is gone, and with it the exemption


def test_bands(spark):
    """A burst of credentials, declines, a prepaid upgrade and a webmail blast is high; a slow upgrade is low."""
    from riskloom.operators.scoring import local_risk

    m = MINUTE_NS
    burst = [event(START, "subject.created", subject="burst")]
    burst += [event(START + k * m, "payment.attempt", subject="burst", outcome="declined") for k in (1, 2)] + [event(START + 3 * m, "payment.attempt", subject="burst", outcome="succeeded", funding="prepaid")]
    burst += [event(START + 4 * m, "subscription.changed", subject="burst", status="active", amount_minor=900.0)]
    burst += [event(START + 5 * m + k, "resource.created", subject="burst", kind="key" if k % 2 else "agent", name="PayPal help") for k in range(6)]
    burst += [event(START + 20 * m + k * 1_000_000_000, "content.sent", subject="burst", recipient_domain="gmail.com", recipient_count=10.0, recipient_is_own_identity=False) for k in range(10)]
    slow = [event(START, "subject.created", subject="slow"), event(START + 3 * DAY_NS, "subscription.changed", subject="slow", status="active", amount_minor=900.0)]
    got = features(spine(spark, [("burst", START + 30 * m), ("slow", START + 3 * DAY_NS + m)]), frame(spark, burst + slow)).withColumn("risk", local_risk(LOCAL_WEIGHTS))
    risk = {r["subject"]: r["risk"] for r in got.collect()}
    assert risk["burst"] > 0.99 and risk["slow"] < 0.05

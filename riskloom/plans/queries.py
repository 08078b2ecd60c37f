"""Registered queries over the driver's tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp, parse_rfc3339, reason, sha_bucket, split_for, wilson
from ..functions.text import mask_emails, match_brands, skeleton, truncate_utf8
from ..operators import ingest, links, metrics, replay, scoring, subjects
from ..operators.features import features
from ..operators.sweep import features_by_sweep
from ..schema import DAY_NS, FEATURES, HASH_QUANTA, HOUR_NS, LOCAL_WEIGHTS, Rule, column
from ..sources.mapped import EVENTS_SQL, mapped_events, read_table
from .registry import ORACLES, QUERIES, query
from .risk import risk_of_points

__all__ = ["ORACLES", "QUERIES"]

# --- points and features -------------------------------------------------------------------------------------------

_ACTIVITY = """
act AS (SELECT subject, min(at_ns) AS first_ns, max(at_ns) AS last_ns, min(CASE WHEN type = 'content.sent' AND NOT own THEN at_ns END) AS external_ns FROM ev WHERE type <> 'label' GROUP BY subject),
slices AS (SELECT subject, point, now_ns, now_ns AS cutoff_ns FROM (
  SELECT subject, 'full' AS point, last_ns + 1 AS now_ns FROM act
  UNION ALL SELECT subject, 'early_15m', least(first_ns + 900000000000, last_ns + 1) FROM act
  UNION ALL SELECT subject, 'first_send', least(external_ns, first_ns + 900000000000, last_ns + 1) FROM act WHERE external_ns IS NOT NULL) s SEMI JOIN act a ON a.subject = s.subject AND a.first_ns < s.now_ns)"""
_SENDS = ", sends AS (SELECT subject, id AS point, at_ns AS now_ns, at_ns + 1 AS cutoff_ns FROM ev WHERE type = 'content.sent')"


ALL_KINDS = "'email_hash', 'card_fingerprint_hash', 'device_hash'"


def _touch_sql() -> str:
    return """
touches AS (SELECT 'email_hash' AS kind, email_hash AS hash, subject, at_ns FROM ev WHERE type <> 'label' UNION ALL SELECT 'card_fingerprint_hash', card_fingerprint_hash, subject, at_ns FROM ev WHERE type <> 'label'
  UNION ALL SELECT 'device_hash', device_hash, subject, at_ns FROM ev WHERE type <> 'label' AND device_hash IS NOT NULL)"""


def _neighbour_sql(name: str, spine: str, kinds: str, per_key: int = 50, total: int = 200) -> str:
    return f"""
{name}_cand AS (SELECT o.subject, o.point, o.kind, o.hash, t.subject AS other, max(t.at_ns) AS last_ns FROM
  (SELECT DISTINCT s.subject, s.point, s.cutoff_ns, t.kind, t.hash FROM {spine} s JOIN touches t ON t.subject = s.subject AND t.at_ns < s.cutoff_ns WHERE t.kind IN ({kinds})) o
  JOIN touches t ON t.kind = o.kind AND t.hash = o.hash AND t.subject <> o.subject AND t.at_ns < o.cutoff_ns GROUP BY ALL),
{name}_rank AS (SELECT *, row_number() OVER (PARTITION BY subject, point, kind, hash ORDER BY last_ns DESC, other) AS r FROM {name}_cand),
{name}_first AS (SELECT subject, point, other, min(struct_pack(k := kind, h := hash, r := r)) AS place FROM {name}_rank WHERE r <= {per_key} GROUP BY ALL),
{name} AS (SELECT f.subject, f.point, f.other, f.over OR c.subject IS NOT NULL AS truncated FROM
  (SELECT *, count(*) OVER (PARTITION BY subject, point) > {total} AS over, row_number() OVER (PARTITION BY subject, point ORDER BY place) AS n FROM {name}_first) f
  LEFT JOIN (SELECT DISTINCT subject, point FROM {name}_rank WHERE r > {per_key}) c ON c.subject = f.subject AND c.point = f.point WHERE f.n <= {total})"""


def _evidence_sql(spine: str) -> str:
    return f"""{_touch_sql()},{_neighbour_sql('general', spine, ALL_KINDS)},{_neighbour_sql('cards', spine, "'card_fingerprint_hash'")},
fate AS (SELECT subject AS other, min(CASE WHEN type = 'subject.deleted' THEN at_ns END) AS deleted_ns, min(CASE WHEN type = 'label' THEN at_ns END) AS labelled_ns FROM ev WHERE type IN ('subject.deleted', 'label') GROUP BY subject),
evidence AS (SELECT s.subject, s.point,
  coalesce(g.deleted_n, 0) AS deleted_n, coalesce(g.labelled_n, 0) AS labelled_n, c.subject IS NOT NULL AS shared, coalesce(g.cut, false) OR coalesce(c.cut, false) AS cut FROM {spine} s
  LEFT JOIN (SELECT g.subject, g.point, count(*) FILTER (f.deleted_ns < s.cutoff_ns) AS deleted_n, count(*) FILTER (f.labelled_ns < s.cutoff_ns) AS labelled_n, bool_or(truncated) AS cut
    FROM general g JOIN {spine} s ON s.subject = g.subject AND s.point = g.point LEFT JOIN fate f ON f.other = g.other GROUP BY ALL) g ON g.subject = s.subject AND g.point = s.point
  LEFT JOIN (SELECT subject, point, bool_or(truncated) AS cut FROM cards GROUP BY ALL) c ON c.subject = s.subject AND c.point = s.point)"""


def _features_sql(spine: str, evidence: bool, known: str = "e.at_ns < s.cutoff_ns") -> str:
    """Common table ``feat`` of all features at the points of ``spine``, from the events that are ``known`` at them."""
    ev = "e.deleted_n, e.labelled_n, e.shared, e.cut" if evidence else "0 AS deleted_n, 0 AS labelled_n, false AS shared, false AS cut"
    join = "LEFT JOIN evidence e ON e.subject = g.subject AND e.point = g.point" if evidence else ""
    h, d = HOUR_NS, DAY_NS
    values = {
        "core.subject_age_h": f"least(24, greatest(0, (now_ns - first_ns) / {float(h)}))",
        "core.resource_velocity_1h": "resource_1h",
        "core.resource_total": "resources",
        "core.credential_velocity_1h": "credential_1h",
        "core.credential_total": "credentials",
        "core.upgrade_delay_min": "least(1440, greatest(0, (coalesce(paid_ns, now_ns) - first_ns) / 60000000000.0))",
        "core.upgraded": "CASE WHEN paid_ns IS NULL THEN 0 ELSE 1 END",
        "core.declines_before_first_success": "declines",
        "core.first_funding_prepaid": "CASE WHEN funding = 'prepaid' THEN 1 ELSE 0 END",
        "brand.name_match": "CASE WHEN named_paypal THEN 1 ELSE 0 END",
        "brand.name_has_at": "CASE WHEN has_at THEN 1 ELSE 0 END",
        "email.first_day_distinct_domains": "ln(1 + first_day_domains) * 10 / ln(11)",
        "email.self_send_before_external": "least(2, self_sends)",
        "core.linked_deleted_n": "least(3, deleted_n)",
        "core.linked_labelled_abusive_n": "labelled_n",
        "core.fingerprint_seen_on_other_subjects": "CASE WHEN shared THEN 1 ELSE 0 END",
        "core.neighbors_truncated": "CASE WHEN cut THEN 1 ELSE 0 END",
        "core.burst_ratio_24h_vs_lifetime": "coalesce(windowed_day / nullif(windowed, 0), 0)",
        "email.sends_10m_max": "least(300, peak / base) * decay",
        "email.sends_1h": "least(300, sends_1h / base) * decay",
        "email.sends_first_day": "least(300, sends_first_day)",
        "email.webmail_recipient_share": "coalesce(webmail / nullif(sends, 0), 0)",
        "email.webmail_sends_1h": "least(300, webmail_1h / base) * decay",
        "email.distinct_recipients_1h": "least(300, (hashes_1h + unhashed_1h) / base) * decay",
        "email.subject_brand_match": "least(3, CASE WHEN line_paypal AND NOT named_paypal THEN 1 ELSE 0 END + CASE WHEN line_parcel THEN 2 ELSE 0 END + CASE WHEN line_netflix AND NOT agent_netflix THEN 1 ELSE 0 END) * decay",
    }
    columns = ", ".join(f"CAST({v} AS DOUBLE) AS {column(f)}" for f, v in values.items())
    hour, day = (f"at_ns > now_ns - {w} AND at_ns <= now_ns" for w in (h, d))
    return f"""
j0 AS (SELECT s.*, e.* EXCLUDE (subject) FROM {spine} s JOIN ev e ON e.subject = s.subject AND {known} WHERE e.type <> 'label'),
j1 AS (SELECT *, type = 'content.sent' AND NOT own AS reach, least(300, n) AS rec,
  CASE WHEN type = 'content.sent' AND NOT own AND {day} THEN 'recent' WHEN type = 'content.sent' AND NOT own AND at_ns > now_ns - {30 * d} AND at_ns <= now_ns - {d} THEN 'prior' END AS phase,
  min(at_ns) OVER (PARTITION BY subject, point) AS first_ns,
  min(CASE WHEN outcome = 'succeeded' THEN at_ns END) OVER (PARTITION BY subject, point) AS success_ns,
  min(CASE WHEN type = 'content.sent' AND NOT own THEN at_ns END) OVER (PARTITION BY subject, point) AS external_ns FROM j0),
j2 AS (SELECT *, sum(rec) OVER (PARTITION BY subject, point, phase ORDER BY at_ns RANGE BETWEEN 599999999999 PRECEDING AND CURRENT ROW) AS running FROM j1),
g0 AS (SELECT subject, point, any_value(now_ns) AS now_ns, any_value(first_ns) AS first_ns,
  count(*) FILTER (type = 'resource.created' AND {hour}) AS resource_1h, count(*) FILTER (type = 'resource.created') AS resources,
  count(*) FILTER (kind = 'key' AND {hour}) AS credential_1h, count(*) FILTER (kind = 'key') AS credentials,
  min(at_ns) FILTER (type = 'subscription.changed' AND amount_minor > 0) AS paid_ns,
  count(*) FILTER (outcome = 'declined' AND (success_ns IS NULL OR at_ns <= success_ns)) AS declines,
  arg_min(funding, struct_pack(a := at_ns, i := id)) FILTER (outcome = 'succeeded') AS funding,
  count(DISTINCT CASE WHEN type = 'content.sent' AND at_ns BETWEEN first_ns AND first_ns + {d} THEN recipient_domain END) AS first_day_domains,
  count(*) FILTER (own AND (external_ns IS NULL OR at_ns <= external_ns)) AS self_sends,
  count(*) FILTER (type IN ('resource.created', 'content.sent') AND {day}) AS windowed_day, count(*) FILTER (type IN ('resource.created', 'content.sent')) AS windowed,
  coalesce(max(running) FILTER (phase = 'recent'), 0) AS peak, greatest(1, coalesce(max(running) FILTER (phase = 'prior'), 0)) AS base,
  coalesce(sum(rec) FILTER (reach AND {hour}), 0) AS sends_1h, coalesce(sum(rec) FILTER (reach AND at_ns <= now_ns AND at_ns BETWEEN first_ns AND first_ns + {d}), 0) AS sends_first_day,
  count(DISTINCT CASE WHEN reach AND {hour} THEN recipient_hash END) AS hashes_1h, coalesce(sum(rec) FILTER (reach AND {hour} AND recipient_hash IS NULL), 0) AS unhashed_1h,
  coalesce(bool_or(type = 'resource.created' AND k % 10 = 0), false) AS named_paypal, coalesce(bool_or(type = 'resource.created' AND k % 10 = 1), false) AS has_at, coalesce(bool_or(kind = 'agent' AND k % 10 = 3), false) AS agent_netflix,
  coalesce(bool_or(reach AND {hour} AND k % 9 = 0), false) AS line_paypal, coalesce(bool_or(reach AND {hour} AND k % 9 = 2), false) AS line_parcel, coalesce(bool_or(reach AND {hour} AND k % 9 = 4), false) AS line_netflix,
  coalesce(sum(rec) FILTER (reach AND at_ns <= now_ns), 0) AS sends, coalesce(sum(rec) FILTER (reach AND at_ns <= now_ns AND k % 23 < 2), 0) AS webmail, coalesce(sum(rec) FILTER (reach AND {hour} AND k % 23 < 2), 0) AS webmail_1h,
  min(at_ns) FILTER (type IN ('resource.created', 'content.sent') AND {hour}) AS oldest_hour, min(at_ns) FILTER (type IN ('resource.created', 'content.sent') AND {day}) AS oldest_day
  FROM j2 GROUP BY subject, point),
g AS (SELECT *, least(1.0, greatest(0.2, 1 - ((now_ns - first_ns) / {float(d)} - 3) / 27)) AS decay,
  least(oldest_hour + {h}, oldest_day + {d}, CASE WHEN first_ns + {d} > now_ns THEN first_ns + {d} END) AS soon FROM g0),
feat AS (SELECT g.subject, g.point, g.now_ns, {columns}, CAST(CASE WHEN soon % 300000000000 = 0 THEN soon ELSE (soon // 300000000000 + 1) * 300000000000 END AS BIGINT) AS next_rescore_ns
  FROM (SELECT g.*, {ev} FROM g {join}) g)"""


_ROUNDED = ", ".join(f"round({column(f)}, 9) AS {column(f)}" for f in FEATURES)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("subject", "point", *[F.round(column(f), 9).alias(column(f)) for f in FEATURES], F.col("next_rescore_ns").cast("string").alias("next_rescore_ns"))


def _logit_sql() -> str:
    return f"{LOCAL_WEIGHTS.bias}" + "".join(f" + ({LOCAL_WEIGHTS.weights[f]}) * {column(f)}" for f in FEATURES)


def _slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = mapped_events(spark, sf_dir)
    return replay.points_from_activity(events), events


@query(f"WITH {EVENTS_SQL},{_ACTIVITY} SELECT subject, point, CAST(now_ns AS BIGINT) AS now_ns FROM slices")
def decision_points(spark, sf_dir):
    return _slices(spark, sf_dir)[0].select("subject", "point", "now_ns")


@query(f"WITH {EVENTS_SQL},{_ACTIVITY},{_evidence_sql('slices')},{_features_sql('slices', True)} SELECT subject, point, {_ROUNDED}, CAST(next_rescore_ns AS VARCHAR) AS next_rescore_ns FROM feat")
def features_at_slices(spark, sf_dir):
    spine, events = _slices(spark, sf_dir)
    return _shown(features(spine, events, links.evidence_as_of(spine, events)))


@query(f"WITH {EVENTS_SQL}{_SENDS},{_features_sql('sends', False)} SELECT subject, point, {_ROUNDED}, CAST(next_rescore_ns AS VARCHAR) AS next_rescore_ns FROM feat")
def features_at_sends(spark, sf_dir):
    events = mapped_events(spark, sf_dir)
    spine = events.where("type = 'content.sent'").select("tenant", "subject", F.col("id").alias("point"), F.col("at_ns").alias("now_ns"), (F.col("at_ns") + 1).alias("cutoff_ns"))
    return _shown(features_by_sweep(spine, events))


@query(
    f"""WITH {EVENTS_SQL},{_ACTIVITY}, sp AS (SELECT * FROM slices WHERE point = 'full'),{_evidence_sql('sp')},{_features_sql('sp', True)},
risk AS (SELECT subject, point, 1 / (1 + exp(-({_logit_sql()}))) AS r FROM feat)
SELECT subject, point, round(r, 9) AS score, CASE WHEN r >= 0.8 THEN 'high' WHEN r >= 0.4 THEN 'medium' ELSE 'low' END AS tier, false AS degraded FROM risk"""
)
def risk_of_subjects(spark, sf_dir):
    spine, events = _slices(spark, sf_dir)
    return risk_of_points(spine.where("point = 'full'"), events).select("subject", "point", F.round("score", 9).alias("score"), "tier", "degraded")


@query()
def brand_features(spark, sf_dir):
    """Features of the slices with names and subject lines from documents, and brands of common words."""
    events = mapped_events(spark, sf_dir, texts=True)
    out = features(replay.points_from_activity(events), events, brands=TEST_BRANDS)
    return out.select("subject", "point", *[column(f) for f in ("brand.name_match", "brand.name_has_at", "email.subject_brand_match")])


TEST_BRANDS = (("The", (), False), ("And", ("Und",), False), ("In The", (), False), ("La", (), True), ("De", (), False))


@query()
def brand_matches(spark, sf_dir):
    lines = read_table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    got = match_brands(lines, TEST_BRANDS)
    return got.select(F.sha2("text", 256).alias("line"), F.array_join("name_brands", ",").alias("name_brands"), F.array_join("subject_brands", ",").alias("subject_brands"), "has_integration")


@query(
    f"""WITH {EVENTS_SQL},{_ACTIVITY},{_features_sql('slices', False)}, v AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {k}, {w * (k - 1)!r})" for f, w in LOCAL_WEIGHTS.weights.items() for k in (0.0, 0.5, 2.0))}) t(feature, factor, delta)),
p AS (SELECT subject, point, unnest([{', '.join(f"'{f}'" for f in FEATURES)}]) AS feature, unnest([{', '.join(column(f) for f in FEATURES)}]) AS x, {_logit_sql()} AS z FROM feat),
r AS (SELECT v.feature, v.factor, 1 / (1 + exp(-z)) AS a, 1 / (1 + exp(-(z + delta * x))) AS b FROM p JOIN v ON v.feature = p.feature)
SELECT feature, CAST(factor AS DOUBLE) AS factor, count(*) AS points, count(*) FILTER ((a >= 0.8) <> (b >= 0.8) OR (a >= 0.4) <> (b >= 0.4)) AS moved, round(avg(b - a), 9) AS mean_change FROM r GROUP BY feature, factor"""
)
def weight_sweep(spark, sf_dir):
    spine, events = _slices(spark, sf_dir)
    rows = scoring.sweep(features(spine, events), ("subject", "point"))
    return rows.groupBy("feature", "factor").agg(F.count("*").alias("points"), F.count_if(F.col("tier") != F.col("base_tier")).alias("moved"), F.round(F.avg(F.col("risk") - F.col("base_risk")), 9).alias("mean_change"))


@query(f"WITH {EVENTS_SQL},{_ACTIVITY}, l AS (SELECT subject, 'p' || k AS label_id, coalesce((SELECT min(at_ns) FROM ev s WHERE s.subject = ev.subject AND s.type = 'content.sent'), at_ns) AS now_ns, id FROM ev WHERE type = 'label') SELECT l.id AS label_id, l.subject, CAST(l.now_ns AS BIGINT) AS now_ns, count(e.id) AS n_events FROM l LEFT JOIN ev e ON e.subject = l.subject AND e.at_ns <= l.now_ns AND e.type <> 'label' GROUP BY ALL HAVING count(e.id) > 0")
def corpus_snapshots(spark, sf_dir):
    events = mapped_events(spark, sf_dir)
    marks = events.where("type = 'label'").select("tenant", "subject", F.col("id").alias("label_id"), "label", F.col("at_ns").alias("labelled_ns"))
    spine = replay.snapshot_points(marks, events)
    return replay.event_slice(spine, events).join(spine, ["tenant", "subject", "point"]).select(F.col("point").alias("label_id"), "subject", "now_ns", F.size("slice").cast("long").alias("n_events"))


# --- links ---------------------------------------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL},{_touch_sql()} SELECT kind, hash, subject, CAST(min(at_ns) AS BIGINT) AS first_ns, CAST(max(at_ns) AS BIGINT) AS last_ns FROM touches GROUP BY kind, hash, subject")
def link_summary(spark, sf_dir):
    return links.link_summary(links.link_touches(mapped_events(spark, sf_dir))).drop("tenant")


@query(f"WITH {EVENTS_SQL},{_ACTIVITY},{_evidence_sql('slices')} SELECT subject, point, other, truncated FROM general")
def neighbours_as_of(spark, sf_dir):
    spine, events = _slices(spark, sf_dir)
    return links.neighbours_as_of(spine, links.link_touches(events)).drop("tenant")


@query(f"WITH {EVENTS_SQL},{_ACTIVITY}, now AS (SELECT DISTINCT subject, 'now' AS point, CAST(9e18 AS BIGINT) AS cutoff_ns FROM ev),{_evidence_sql('now')} SELECT subject, deleted_n, labelled_n FROM evidence")
def neighbour_outcomes(spark, sf_dir):
    events = mapped_events(spark, sf_dir)
    every = events.select("tenant", "subject").distinct()
    found = links.neighbours(every, links.link_summary(links.link_touches(events)))
    got = links.current_outcomes(found, events)
    zero = F.lit(0)
    return every.join(got, ["tenant", "subject"], "left").select("subject", F.coalesce("deleted_n", zero).alias("deleted_n"), F.coalesce("labelled_n", zero).alias("labelled_n"))


@query(f"WITH {EVENTS_SQL},{_ACTIVITY},{_touch_sql()},{_neighbour_sql('few', 'slices', ALL_KINDS, 3, 5)} SELECT subject, point, other, truncated FROM few")
def neighbours_capped(spark, sf_dir):
    """Caps small enough to bite at every key: three subjects a key, five in all."""
    spine, events = _slices(spark, sf_dir)
    return links.neighbours_as_of(spine, links.link_touches(events), per_key=3, total=5).drop("tenant")


@query(f"WITH {EVENTS_SQL}, changed AS (SELECT DISTINCT subject, 'now' AS point, CAST(9e18 AS BIGINT) AS cutoff_ns FROM ev WHERE type IN ('subject.deleted', 'label')),{_touch_sql()},{_neighbour_sql('near', 'changed', ALL_KINDS)} SELECT DISTINCT other AS subject FROM near")
def dirty_neighbours(spark, sf_dir):
    events = mapped_events(spark, sf_dir)
    changed = events.where("type in ('subject.deleted', 'label')").select("tenant", "subject").distinct()
    return links.propagate_dirty(changed, links.link_summary(links.link_touches(events))).select("subject")


@query(
    f"""WITH RECURSIVE {EVENTS_SQL},{_touch_sql()}, e AS (SELECT DISTINCT a.subject AS a, b.subject AS b FROM touches a JOIN touches b ON a.kind = b.kind AND a.hash = b.hash),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
lab AS (SELECT DISTINCT subject FROM ev WHERE type = 'label'), c AS (SELECT l.subject, min(r.b) AS cluster FROM lab l JOIN reach r ON r.a = l.subject JOIN lab k ON k.subject = r.b GROUP BY l.subject)
SELECT subject, cluster, CASE WHEN CAST('0x' || substr(sha256(cluster), 1, 16) AS UBIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM c"""
)
def link_clusters(spark, sf_dir):
    events = mapped_events(spark, sf_dir)
    return links.link_clusters(links.link_touches(events), events.where("type = 'label'").select("subject").distinct())


# --- subjects and verdicts -----------------------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT subject, CAST(min(at_ns) FILTER (type <> 'label') AS BIGINT) AS first_ns, CAST(max(at_ns) FILTER (type <> 'label') AS BIGINT) AS last_ns, count(*) AS dirty_seq FROM ev GROUP BY subject")
def subject_roll_up(spark, sf_dir):
    events = mapped_events(spark, sf_dir)
    return subjects.roll_up(events.where("type <> 'label'"), events.where("type = 'label'")).drop("tenant")


@query(f"WITH {EVENTS_SQL} SELECT subject, arg_max(CASE WHEN k % 3 = 0 THEN 'internal' WHEN k % 3 = 1 THEN 'customer' ELSE 'synthetic' END, struct_pack(a := at_ns, b := CAST(id AS BIGINT))) AS class FROM ev WHERE type = 'content.sent' GROUP BY subject")
def latest_class(spark, sf_dir):
    return _classes(mapped_events(spark, sf_dir)).drop("tenant")


def _classes(events: DataFrame) -> DataFrame:
    """Sends read as class events; their count of recipients and domain tell the number that names the class."""
    sent = events.where("type = 'content.sent'")
    k = _number(F.col("recipient_domain"), F.col("recipient_count"))
    named = F.when(k % 3 == 0, "internal").when(k % 3 == 1, "customer").otherwise("synthetic")
    return subjects.latest_class(sent.withColumns({"class": named, "seq": F.col("id").cast("long"), "type": F.lit("subject.class")}))


def _number(domain, count):
    """The k of 0 to 99 with k % 23 and k % 5 given (23 and 5 have no common factor, and 115 > 99)."""
    a, b = F.when(domain == "gmail.com", 0).when(domain == " Web.DE", 1).otherwise(F.substring(domain, 2, 3).try_cast("int")), (count - 1).cast("int")
    return (a * 70 + b * 46) % 115


_VERDICTS = f"""verdicts AS (SELECT id, subject, 'rule' || (k % 3) AS rule, CASE WHEN k % 3 = 2 THEN 'shadow' ELSE 'advise' END AS mode, CASE WHEN k % 5 = 0 THEN 'unscored' ELSE 'scored' END AS status,
  CASE WHEN k % 5 <> 0 THEN k / 100.0 END AS risk, CASE WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'cost_cap' ELSE 'adapter_error' END END AS error_code, 'h' || (k % 7) AS input_hash, at_ns AS scored_ns,
  CASE WHEN k % 2 = 0 THEN 'local' ELSE 'vendor' END AS scorer, CAST(k AS DOUBLE) AS latency_ms FROM ev WHERE type = 'content.sent')"""


def _verdicts(events: DataFrame) -> DataFrame:
    k = _number(F.col("recipient_domain"), F.col("recipient_count"))
    sent = events.where("type = 'content.sent'").withColumn("k", k)
    off = F.col("k") % 5 == 0
    return sent.select(
        "tenant",
        "subject",
        "id",
        F.concat(F.lit("rule"), F.col("k") % 3).alias("rule"),
        F.when(F.col("k") % 3 == 2, "shadow").otherwise("advise").alias("mode"),
        F.when(off, "unscored").otherwise("scored").alias("status"),
        F.when(~off, F.col("k") / 100.0).alias("risk"),
        F.when(off, F.when(F.col("k") % 2 == 0, "cost_cap").otherwise("adapter_error")).alias("error_code"),
        F.concat(F.lit("h"), F.col("k") % 7).alias("input_hash"),
        F.col("at_ns").alias("scored_ns"),
        F.when(F.col("k") % 2 == 0, "local").otherwise("vendor").alias("scorer"),
        F.col("k").cast("double").alias("latency_ms"),
        F.col("at_ns").alias("called_ns"),
    )


_LATEST = """latest AS (SELECT n.subject, n.rule, n.mode, n.status, n.error_code, n.scored_ns, s.risk AS last_risk, s.input_hash AS last_hash, s.scored_ns AS last_scored_ns FROM
  (SELECT *, row_number() OVER (PARTITION BY subject, rule ORDER BY scored_ns DESC, id DESC) AS r FROM verdicts) n LEFT JOIN
  (SELECT *, row_number() OVER (PARTITION BY subject, rule ORDER BY scored_ns DESC, id DESC) AS r FROM verdicts WHERE status = 'scored') s ON s.subject = n.subject AND s.rule = n.rule AND s.r = 1 WHERE n.r = 1)"""


@query(f"WITH {EVENTS_SQL}, {_VERDICTS}, {_LATEST} SELECT subject, rule, status, error_code, CAST(scored_ns AS BIGINT) AS scored_ns, last_risk, last_hash FROM latest")
def latest_verdicts(spark, sf_dir):
    return subjects.latest_verdicts(_verdicts(mapped_events(spark, sf_dir))).select("subject", "rule", "status", "error_code", "scored_ns", "last_risk", "last_hash")


@query(
    f"""WITH {EVENTS_SQL}, {_VERDICTS}, {_LATEST}, s AS (SELECT subject, count(*) AS dirty_seq FROM ev GROUP BY subject), r AS (SELECT * FROM (VALUES ('rule0', 'advise'), ('rule1', 'advise'), ('rule2', 'shadow')) t(rule, mode))
SELECT s.subject, s.dirty_seq - 50 AS events_since_score, s.dirty_seq > 50 AS stale, bool_or(r.mode = 'advise' AND (l.status IS NULL OR l.status = 'unscored')) AS degraded, count(l.status) AS n_signals
FROM s CROSS JOIN r LEFT JOIN latest l ON l.subject = s.subject AND l.rule = r.rule GROUP BY ALL"""
)
def subject_view(spark, sf_dir):
    events = mapped_events(spark, sf_dir)
    rolled = subjects.roll_up(events).withColumn("scored_seq", F.lit(50))
    rules = spark.createDataFrame([("rule0", "advise"), ("rule1", "advise"), ("rule2", "shadow")], "rule string, mode string")
    view = subjects.subject_view(rolled, _verdicts(events), rules)
    return view.select("subject", "events_since_score", "stale", "degraded", F.size("signals").cast("long").alias("n_signals"))


_NOW = 1_706_500_000_000_000_000


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT subject, min(at_ns) AS first_ns, max(at_ns) AS last_ns, count(*) AS dirty_seq, CAST(subject AS INT) AS u FROM ev GROUP BY subject),
d AS (SELECT *, dirty_seq > 60 AS dirty, dirty_seq <= 60 AND last_ns + {HOUR_NS} <= {_NOW} AS timer FROM s WHERE u % 4 <> 0)
SELECT subject, dirty, CAST(row_number() OVER (ORDER BY dirty DESC, (first_ns > {_NOW - DAY_NS}) DESC, CASE WHEN u % 3 <> 0 THEN u / 1000.0 END DESC NULLS FIRST, last_ns, subject) AS BIGINT) AS place FROM d WHERE dirty OR timer ORDER BY place LIMIT 200"""
)
def due_subjects(spark, sf_dir):
    """The next 200 subjects to score; the limit is the claim's own batch size."""
    s = subjects.roll_up(mapped_events(spark, sf_dir))
    u = F.col("subject").cast("int")
    s = s.withColumns({"scored_seq": F.lit(60), "class": F.when(u % 4 == 0, "internal"), "next_rescore_ns": F.col("last_ns") + HOUR_NS, "score": F.when(u % 3 != 0, u / 1000.0)})
    rows = subjects.due(s, _NOW)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("dirty"), F.desc("young"), F.desc_nulls_first("score"), "last_ns", "subject"))
    return rows.withColumn("place", place.cast("long")).select("subject", "dirty", "place")


@query(f"WITH {EVENTS_SQL}, {_VERDICTS}, paid AS (SELECT strftime(make_timestamp(scored_ns // 1000), '%Y-%m-%d') AS day, * FROM verdicts WHERE scorer <> 'local') SELECT day, 'adapter' AS dim, scorer AS key, count(*) AS n FROM paid GROUP BY ALL UNION ALL SELECT day, 'subject', 't/' || subject, count(*) FROM paid GROUP BY ALL UNION ALL SELECT day, 'tenant', 't', count(*) FROM paid GROUP BY ALL")
def scorer_usage(spark, sf_dir):
    return subjects.usage(_verdicts(mapped_events(spark, sf_dir)))


@query(f"WITH {EVENTS_SQL}, {_VERDICTS} SELECT scorer, count(*) AS calls, count(*) FILTER (error_code IS NOT NULL AND error_code <> 'cost_cap') AS errors, count(*) FILTER (error_code = 'cost_cap') AS denials, round(avg(latency_ms), 9) AS mean_latency_ms FROM verdicts GROUP BY scorer")
def scorer_counters(spark, sf_dir):
    rows = _verdicts(mapped_events(spark, sf_dir)).withColumn("tier", F.lit("low"))
    return subjects.counters(rows)[1].withColumn("mean_latency_ms", F.round("mean_latency_ms", 9))


# --- ingest --------------------------------------------------------------------------------------------------------


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as they arrive: text instants, JSON data, and a fault for some numbers in ``props``."""
    e = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    kind = F.when(F.col("event_type") == "purchase", "payment.attempt").when(F.col("event_type") == "view", "content.sent").otherwise("custom.kind")
    data = (
        F.when((kind == "payment.attempt") & (k < 50), F.to_json(F.struct(F.lit("succeeded").alias("outcome"), F.col("value").alias("amount_minor"), F.lit("x").alias("unlisted"))))
        .when(kind == "payment.attempt", F.to_json(F.struct(F.when(k < 60, "perhaps").otherwise("declined").alias("outcome"))))
        .when(kind == "content.sent", F.to_json(F.struct(F.concat(F.lit("Hello "), F.when(k < 30, "a.b@example.com").otherwise("you"), F.lit(" ok")).alias("subject_line"), F.when(k >= 90, k / 4).otherwise(k + 1).alias("recipient_count"))))
        .otherwise(F.when(k < 20, '{"note":"write to x@example.org"}').otherwise('{"note":"plain"}'))
    )
    return e.select(
        "event_id",
        F.lit("t").alias("tenant"),
        F.lit("p").alias("producer"),
        F.when(k == 1, "").otherwise(F.col("event_id").cast("string")).alias("id"),
        F.when(k == 2, F.repeat(F.lit("x"), 257)).otherwise(F.col("user_id").cast("string")).alias("subject"),
        F.when(k == 3, "Bad-Type").otherwise(kind).alias("type"),
        F.when(k == 4, "yesterday").otherwise(at).alias("at"),
        *[(F.when(k == 5, "zz") if c == "email_hash" else F.lit("")).alias(c) for c in ("email_hash", "card_fingerprint_hash", "ip24_hash", "asn", "ua_hash", "device_hash")],
        data.alias("data"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.when(k == 6, 2 * DAY_NS).otherwise(0)).alias("received_ns"),
        F.lit(False).alias("backfill"),
    )


@query(
    r"""WITH e AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events),
c AS (SELECT event_id, CASE WHEN k = 1 THEN 'bad_id' WHEN k = 2 THEN 'bad_subject' WHEN k = 3 THEN 'bad_type' WHEN k IN (4, 6) THEN 'bad_timestamp' WHEN k = 5 THEN 'bad_links'
  WHEN event_type = 'purchase' AND k BETWEEN 50 AND 59 THEN 'redaction_failed' WHEN event_type = 'view' AND k >= 90 AND k % 4 <> 0 THEN 'redaction_failed'
  WHEN event_type NOT IN ('purchase', 'view') AND k < 20 THEN 'redaction_failed' ELSE 'accepted' END AS outcome FROM e)
SELECT outcome, count(*) AS n FROM c GROUP BY outcome"""
)
def ingest_outcomes(spark, sf_dir):
    rows = ingest.prepare(_raw_events(spark, sf_dir))
    return rows.groupBy(F.coalesce("reject_code", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


@query(r"""SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS body, CASE WHEN r = 1 THEN 'accepted' WHEN s = f THEN 'duplicate' ELSE 'conflict' END AS outcome FROM (
  SELECT *, o_orderstatus AS s, row_number() OVER w AS r, first_value(o_orderstatus) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))""")
def idempotency(spark, sf_dir):
    rows = read_table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant"), F.lit("").alias("producer"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("body_hash"), F.col("o_orderkey").cast("long").alias("received_ns"), F.lit(0).alias("seq"), F.col("o_orderkey").cast("string").alias("body"))
    return ingest.classify(rows).select("id", "body", "outcome")


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}.\-]+\.[\p{L}]{2,}', '@', 'g')) AS masked_sha256 FROM documents")
def masked_emails(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(mask_emails(F.col("text")), 256).alias("masked_sha256"))


@query(
    """WITH c AS (SELECT conv_id, turn, text, string_split(text, '') AS x FROM conversations),
l AS (SELECT conv_id, turn, text, list_transform(range(0, least(len(x), 200) + 1), lambda i: strlen(array_to_string(x[1:i], ''))) AS b FROM c)
SELECT conv_id, turn, substr(text, 1, len(list_filter(b, lambda v: v <= 200)) - 1) AS cut FROM l"""
)
def truncated_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", truncate_utf8(F.col("text"), 200).alias("cut"))


@query()
def skeletons(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(skeleton(F.col("text")), 256).alias("skeleton_sha256"))


@query("SELECT c_custkey, CAST(CAST('0x' || substr(sha256(c_name), 1, 16) AS UBIGINT) % 100 AS INT) AS bucket, CASE WHEN CAST('0x' || substr(sha256(c_name), 1, 16) AS UBIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM customer")
def hash_splits(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", sha_bucket(F.col("c_name")).alias("bucket"), split_for(F.sha2("c_name", 256)).alias("split"))


@query("SELECT o_orderkey, epoch_us(CAST(o_orderdate AS TIMESTAMP)) * 1000 + 123456789 AS at_ns FROM orders")
def parsed_instants(spark, sf_dir):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00.123456789Z"))
    return read_table(spark, sf_dir, "orders").select("o_orderkey", parse_rfc3339(text)["at_ns"].alias("at_ns"))


# --- scoring -------------------------------------------------------------------------------------------------------

_RULES = [Rule("velocity"), Rule("late_stage", inputs=FEATURES[:9], stage={"min_local_risk": 0.5}), Rule("young", inputs=FEATURES[:5], stage={"max_subject_age_h": 12.0})]


@query(
    f"""WITH {EVENTS_SQL},{_ACTIVITY},{_features_sql('slices', False)}, {_VERDICTS}, {_LATEST}, r AS (SELECT * FROM (VALUES ('velocity', 'rule0'), ('late_stage', 'rule1'), ('young', 'rule2')) t(rule, old)),
m AS (SELECT subject, max(last_risk) AS top FROM latest GROUP BY subject)
SELECT f.subject, f.point, r.rule, CASE WHEN r.rule = 'late_stage' AND coalesce(m.top, 0) < 0.5 THEN 'stage_condition' WHEN r.rule = 'young' AND core__subject_age_h > 12 THEN 'stage_condition' END AS skip_reason
FROM feat f CROSS JOIN r LEFT JOIN m ON m.subject = f.subject"""
)
def scoring_plan(spark, sf_dir):
    spine, events = _slices(spark, sf_dir)
    points = features(spine, events).withColumn("features", scoring.feature_map()).withColumn("text", F.create_map().cast("map<string,array<string>>"))
    names = F.create_map(*[F.lit(x) for pair in (("rule0", "velocity"), ("rule1", "late_stage"), ("rule2", "young")) for x in pair])
    last = subjects.latest_verdicts(_verdicts(events)).withColumn("rule", names[F.col("rule")])
    plan = scoring.plan_calls(points.select("tenant", "subject", "point", "features", "text"), scoring.rules_table(spark, _RULES), last)
    return plan.select("subject", "point", "rule", "skip_reason")


@query(
    f"""WITH {EVENTS_SQL}, {_VERDICTS}, {_LATEST}, g AS (SELECT subject, max(last_risk) FILTER (mode = 'advise' AND status = 'scored' AND rule = 'rule0') AS f, max(last_risk) FILTER (mode = 'advise' AND status = 'scored' AND rule = 'rule1') AS t,
  count(*) FILTER (mode = 'advise' AND status = 'scored') AS n, coalesce(bool_or(status = 'unscored') FILTER (mode = 'advise'), false) AS degraded FROM latest GROUP BY subject),
s AS (SELECT subject, n, degraded, coalesce(greatest(f, CASE WHEN f >= 0.4 THEN t WHEN t IS NOT NULL THEN least(t, 0.4 - 1e-6) END), 0) AS score FROM g)
SELECT subject, round(score, 9) AS score, CASE WHEN n < 1 THEN 'unknown' WHEN score >= 0.8 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS tier, degraded FROM s"""
)
def combined_verdicts(spark, sf_dir):
    """Combining several rules: one on features, one on text alone (rule1), one in shadow."""
    latest = subjects.latest_verdicts(_verdicts(mapped_events(spark, sf_dir)))
    rows = latest.select("tenant", "subject", "rule", "mode", "status", F.when(F.col("status") == "scored", F.col("last_risk")).alias("risk"), F.lit(False).alias("flagged"), "error_code", (F.col("rule") == "rule1").alias("text_only"))
    got = scoring.combine(rows)
    return got.select("subject", F.round("score", 9).alias("score"), "tier", "degraded")


@query(f"WITH {EVENTS_SQL},{_ACTIVITY},{_features_sql('slices', False)} SELECT subject, point, printf('core.resource_velocity_1h=%.0f core.credential_velocity_1h=%.0f', core__resource_velocity_1h, core__credential_velocity_1h) AS head, floor(core__subject_age_h / 1.0) * 1.0 AS age_step, floor(core__upgrade_delay_min / 60.0) * 60.0 AS delay_step FROM feat")
def reasons(spark, sf_dir):
    spine, events = _slices(spark, sf_dir)
    f = features(spine, events)
    text = reason({name: F.col(column(name)) for name in FEATURES})
    step = {name: (F.floor(F.col(column(name)) / q) * q).alias("age_step" if "age" in name else "delay_step") for name, q in HASH_QUANTA.items()}
    return f.select("subject", "point", F.regexp_extract(text, r"^(\S+ \S+)", 1).alias("head"), *step.values())


# --- evaluation ----------------------------------------------------------------------------------------------------

_RECORDS = """rec AS (SELECT CAST(l.doc_id AS VARCHAR) AS subject, l.toxic = 1 AS positive, (d.n_chars % 997) / 997.0 AS risk, l.doc_id % 11 = 0 AS unscored, CASE WHEN l.doc_id % 22 = 0 THEN 'missing_slice' WHEN l.doc_id % 11 = 0 THEN 'scorer_error' END AS error_code,
  (d.n_chars % 997) / 997.0 >= 0.6 AND l.doc_id % 11 <> 0 AS flagged, CASE WHEN l.quality = 1 THEN 'burst' ELSE 'churn_card' END AS category, CAST(d.n_chars AS DOUBLE) AS latency_ms, d.lang AS scorer FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    risk = (F.col("n_chars") % 997) / 997.0
    off = F.col("doc_id") % 11 == 0
    return rows.select(
        F.col("doc_id").cast("string").alias("subject"),
        (F.col("toxic") == 1).alias("positive"),
        risk.alias("risk"),
        off.alias("unscored"),
        F.when(F.col("doc_id") % 22 == 0, "missing_slice").when(off, "scorer_error").alias("error_code"),
        ((risk >= 0.6) & ~off).alias("flagged"),
        F.when(F.col("quality") == 1, "burst").otherwise("churn_card").alias("category"),
        F.col("n_chars").cast("double").alias("latency_ms"),
        F.col("lang").alias("scorer"),
    )


def _wilson_sql(hits: str, n: str) -> tuple[str, str]:
    z = 1.959963984540054
    middle = f"({hits} / {n} + {z * z} / (2 * {n})) / (1 + {z * z} / {n})"
    half = f"({z} / (1 + {z * z} / {n})) * sqrt(({hits} / {n}) * (1 - {hits} / {n}) / {n} + {z * z} / (4 * {n} * {n}))"
    return f"CASE WHEN {n} > 0 THEN greatest(0, {middle} - {half}) END", f"CASE WHEN {n} > 0 THEN least(1, {middle} + {half}) END"


def _confusion_sql(flag: str, group: str, source: str) -> str:
    p, r = _wilson_sql("CAST(tp AS DOUBLE)", "nullif(tp + fp, 0)"), _wilson_sql("CAST(tp AS DOUBLE)", "nullif(tp + fn, 0)")
    shown = f"{group}, " if group else ""
    return f"""c AS (SELECT {shown}count(*) FILTER (positive AND NOT unscored AND {flag}) AS tp, count(*) FILTER (NOT positive AND NOT unscored AND {flag}) AS fp, count(*) FILTER (NOT positive AND NOT unscored AND NOT {flag}) AS tn,
  count(*) FILTER (positive AND (unscored OR NOT {flag})) AS fn, count(*) FILTER (unscored) AS unscored, count(*) FILTER (error_code = 'missing_slice') AS missing_slice, count(*) AS total FROM {source} {'GROUP BY ' + group if group else ''})
SELECT {shown}tp, fp, tn, fn, unscored, missing_slice, total, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1,
  round({p[0]}, 9) AS precision_low, round({p[1]}, 9) AS precision_high, round({r[0]}, 9) AS recall_low, round({r[1]}, 9) AS recall_high FROM c"""


def _nine(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


@query(f"WITH {_RECORDS}, {_confusion_sql('flagged', '', 'rec')}")
def confusion(spark, sf_dir):
    return _nine(metrics.confusion(_records(spark, sf_dir)))


@query(f"WITH {_RECORDS}, {_confusion_sql('flagged', 'scorer', 'rec')}")
def confusion_by_scorer(spark, sf_dir):
    return _nine(metrics.confusion(_records(spark, sf_dir), ("scorer",)))


@query(f"WITH {_RECORDS}, cut AS (SELECT rec.*, x.cut, x.v FROM rec CROSS JOIN (VALUES ('high', 0.8), ('medium', 0.4)) x(cut, v)), {_confusion_sql('(risk >= v)', 'cut', 'cut')}")
def confusion_at_cuts(spark, sf_dir):
    return _nine(metrics.tier_confusion(_records(spark, sf_dir)))


@query(f"WITH {_RECORDS} SELECT b.bin, count(risk) AS n, round(avg(risk), 9) AS mean_risk, round(avg(CAST(positive AS INT)), 9) AS positive_rate FROM (SELECT CAST(unnest(range(10)) AS INT) AS bin) b LEFT JOIN (SELECT * FROM rec WHERE NOT unscored) r ON least(9, CAST(floor(r.risk * 10) AS INT)) = b.bin GROUP BY b.bin")
def calibration_bins(spark, sf_dir):
    return _nine(metrics.calibration_bins(_records(spark, sf_dir)))


_METRICS = f"""{_RECORDS}, sc AS (SELECT * FROM rec WHERE NOT unscored), rk AS (SELECT *, rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2 AS r FROM sc),
au AS (SELECT (sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2) / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)) AS v FROM rk),
bins AS (SELECT least(9, CAST(floor(risk * 10) AS INT)) AS b, count(*) AS n, avg(risk) AS m, avg(CAST(positive AS INT)) AS p FROM sc GROUP BY 1),
met AS (SELECT 'auroc' AS metric, v AS value FROM au UNION ALL SELECT 'ece', sum(n * abs(m - p)) / sum(n) FROM bins
  UNION ALL SELECT 'precision', count(*) FILTER (positive AND flagged AND NOT unscored) / count(*) FILTER (flagged AND NOT unscored) FROM rec
  UNION ALL SELECT 'recall', count(*) FILTER (positive AND flagged AND NOT unscored) / count(*) FILTER (positive) FROM rec
  UNION ALL SELECT 'high_tier_recall', count(*) FILTER (positive AND risk >= 0.8 AND NOT unscored) / count(*) FILTER (positive) FROM rec
  UNION ALL SELECT 'family_high_tier_recall.burst', count(*) FILTER (risk >= 0.8 AND NOT unscored) / count(*) FROM rec WHERE positive AND category = 'burst')"""


@query(f"WITH {_METRICS} SELECT metric, round(value, 9) AS value FROM met")
def run_metrics(spark, sf_dir):
    return _nine(metrics.long_metrics(_records(spark, sf_dir)))


_FLOORS = (("precision", 0.72), ("recall", 0.01), ("ece", 0.132), ("auroc", 0.93), ("high_tier_recall", 0.60), ("family_high_tier_recall.dormant_then_blast", 0.5))


@query(f"WITH {_METRICS}, f AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _FLOORS)}) t(metric, floor)) SELECT f.metric, CAST(f.floor AS DOUBLE) AS floor, round(value, 9) AS got, value IS NULL AS undefined FROM f LEFT JOIN met ON met.metric = f.metric WHERE value IS NULL OR CASE WHEN f.metric = 'ece' THEN value > floor ELSE value < floor END")
def gate_violations(spark, sf_dir):
    floors = spark.createDataFrame(list(_FLOORS), "metric string, floor double")
    return _nine(metrics.gate(metrics.long_metrics(_records(spark, sf_dir)), floors))


@query(f"WITH {_RECORDS}, s AS (SELECT subject, slice, CASE slice WHEN 'first_send' THEN 1 WHEN 'early_15m' THEN 2 ELSE 3 END AS k, flagged AND NOT unscored AND (risk * 10) % 3 >= CASE slice WHEN 'first_send' THEN 2 WHEN 'early_15m' THEN 1 ELSE 0.5 END AS f FROM rec CROSS JOIN (VALUES ('first_send'), ('early_15m'), ('full')) x(slice) WHERE positive), m AS (SELECT subject, min(k) FILTER (f) AS k FROM s GROUP BY subject) SELECT n.name AS first_flagged, count(m.subject) AS n FROM (VALUES (1, 'first_send'), (2, 'early_15m'), (3, 'full'), (4, 'never')) n(k, name) LEFT JOIN m ON coalesce(m.k, 4) = n.k GROUP BY n.name")
def lead_time(spark, sf_dir):
    rows = _records(spark, sf_dir)
    at = F.array(*[F.struct(F.lit(s).alias("slice"), F.lit(v).alias("need")) for s, v in zip(metrics.SLICES, (2.0, 1.0, 0.5), strict=True)])
    rows = rows.select("*", F.inline(at)).withColumn("flagged", F.col("flagged") & ((F.col("risk") * 10) % 3 >= F.col("need")))
    return metrics.lead_time(rows)


@query(f"WITH {_RECORDS} SELECT scorer, quantile_cont(latency_ms, 0.5) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM rec GROUP BY scorer")
def latency(spark, sf_dir):
    return metrics.latency(_records(spark, sf_dir), ("scorer",)).withColumn("p95", F.round("p95", 6))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'left' WHEN o_orderkey % 7 = 1 THEN 'right' ELSE 'both' END AS side FROM orders WHERE o_orderkey % 7 IN (0, 1) OR (o_orderkey % 7 = 2 AND o_orderstatus <> 'F')")
def run_comparison(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    left = o.where("o_orderkey % 7 <> 1")
    right = o.where("o_orderkey % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 2, "F").otherwise(F.col("o_orderstatus")))
    return metrics.compare_runs(left, right, ("o_orderkey",)).select("o_orderkey", "side")


@query(f"SELECT c_custkey, round({_wilson_sql('CAST(c_custkey % 50 AS DOUBLE)', '50')[0]}, 9) AS low, round({_wilson_sql('CAST(c_custkey % 50 AS DOUBLE)', '50')[1]}, 9) AS high, least(10.0, greatest(0.0, c_acctbal)) AS clamped FROM customer")
def intervals(spark, sf_dir):
    w = wilson(F.col("c_custkey") % 50, F.lit(50))
    return read_table(spark, sf_dir, "customer").select("c_custkey", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"), clamp(F.col("c_acctbal").cast("double"), 0, 10).alias("clamped"))


from . import operator_queries  # noqa: E402, F401  (registers more)

"""Point-in-time features: a spine of (tenant, subject, point, now_ns) joined with each subject's events before it.

One plan computes all features of all points: events, whose names and subject lines have become the brands in them, join
the spine on the subject with a time predicate; the few values that others lean on (first seen, first success, first
external send) and the sliding peaks are windows over the joined rows, and one grouped aggregation gives the rest. The
join's partitioning by subject serves windows and aggregation, so the joined rows are made once and not shuffled again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, floor_div, parse_rfc3339
from ..functions.text import match_brands
from ..schema import BRANDS, DAY_NS, FEATURES, HOUR_NS, MINUTE_NS, WEBMAIL, column

KEY = ("tenant", "subject", "point")
SEND_CAP = 300
#: Spellings of a credential's kind (fixed values).
CREDENTIAL_KINDS = ("key", "keys", "api_key", "api_keys", "api-key", "apikey", "api key")
AGENT_KINDS = ("agent", "agents")
LOG_SCALE = 10 / math.log(11)


def fold(text: Column) -> Column:
    return F.lower(F.trim(text))


def within(at: Column, now: Column, width: int) -> Column:
    """In the trailing half-open window (now - width, now]."""
    return (at > now - width) & (at <= now)


def history(spine: DataFrame, events: DataFrame, inclusive: bool = False) -> DataFrame:
    """Each point's events: those strictly before its ``cutoff_ns`` (``inclusive``: those up to it too). Where the spine
    has ``cutoff_seq``, those whose ``seq`` is not above it, whatever their instant (see ``replay.replay_points``).

    Points without an event keep one row of nulls, so that they come out with zeros.
    """
    past = F.col("e.at_ns") <= F.col("s.cutoff_ns") if inclusive else F.col("e.at_ns") < F.col("s.cutoff_ns")
    if "cutoff_seq" in spine.columns:
        past = F.col("e.seq") <= F.col("s.cutoff_seq")
    s, e = spine.alias("s"), events.where("type <> 'label'").alias("e")
    own = [F.col(f"e.{c}") for c in events.columns if c not in ("tenant", "subject")]
    return s.join(e, (F.col("s.tenant") == F.col("e.tenant")) & (F.col("s.subject") == F.col("e.subject")) & past, "left").select("s.*", *own)


def tag_brands(events: DataFrame, brands=BRANDS) -> DataFrame:
    """``events`` with what names and subject lines tell in place of the texts, so that histories carry no text:
    ``has_at``, ``text_brands`` (of a name, or of a subject line), ``agent_brands`` (exempt ones, of an agent's name that
    says it is an integration) and ``name_key`` (hash of the folded name). Each distinct text is matched once; rows without
    a text take no part in that."""
    named = F.col("type").isin("resource.created", "resource.deleted")
    line = (F.col("type") == "content.sent") & ~F.coalesce(F.col("recipient_is_own_identity"), F.lit(False)) & (F.col("subject_line") != "")
    rows = events.withColumn("__text", F.when(named, F.col("name")).when(line, F.col("subject_line")))
    agent = (F.col("type") == "resource.created") & F.coalesce(fold(F.col("kind")), F.lit("")).isin(*AGENT_KINDS)
    told = rows.where("__text is not null")
    matched = match_brands(told.select(F.col("__text").alias("text")), brands).withColumn("__key", F.sha2("text", 256)).drop("text")
    # rows meet what was found by digest, and leave their text behind before they are shuffled
    told = told.withColumns({"has_at": named & F.col("name").contains("@"), "name_key": F.when(named, F.md5(fold(F.col("__text")))), "__key": F.sha2("__text", 256)})
    tags = {
        "text_brands": F.when(named, F.col("name_brands")).otherwise(F.col("subject_brands")),
        "agent_brands": F.when(agent & F.col("has_integration"), F.col("subject_brands")),
    }
    gone = ("name", "subject_line", "__text", "__key", "name_brands", "subject_brands", "has_integration")
    found = told.drop("name", "subject_line", "__text").join(matched, "__key").withColumns(tags).drop(*gone)
    none = {"has_at": "boolean", "text_brands": "array<string>", "agent_brands": "array<string>", "name_key": "string"}
    silent = rows.where("__text is null").withColumns({c: F.lit(None).cast(t) for c, t in none.items()}).drop(*gone)
    return found.unionByName(silent)


def _peak(width: int, name: str) -> Column:
    """Largest recipient sum of any ``width`` within the phase's own rows."""
    return F.max(F.when(F.col("phase") == name, F.col("running")))


def behaviour(joined: DataFrame, webmail: tuple[str, ...] | list[str] = tuple(WEBMAIL)) -> DataFrame:
    """Features of one subject's own tagged events (all but links), with first_ns, decay and next_rescore_ns."""
    at, now, kind_of = F.col("at_ns"), F.col("now_ns"), F.col("type")
    sent = kind_of == "content.sent"
    own = F.coalesce(F.col("recipient_is_own_identity"), F.lit(False))
    reach = sent & ~own
    count = F.col("recipient_count")
    recipients = F.least(F.lit(SEND_CAP), F.when((count > 0) & (count == F.floor(count)), count).otherwise(1)).cast("long")
    key = Window.partitionBy(*KEY)
    created_at = F.when(kind_of == "subject.created", parse_rfc3339(F.col("account_created_at"))["at_ns"])
    paid = (kind_of == "subscription.changed") & (F.col("status") == "active") & (F.col("amount_minor") > 0)
    success = (kind_of == "payment.attempt") & (F.col("outcome") == "succeeded")
    phase = F.when(reach & within(at, now, DAY_NS), "recent").when(reach & (at > now - 30 * DAY_NS) & (at <= now - DAY_NS), "prior")
    rows = joined.withColumns({"phase": phase, "n": recipients, "created_ns": created_at})
    running = Window.partitionBy(*KEY, "phase").orderBy("at_ns").rangeBetween(-(10 * MINUTE_NS - 1), 0)
    rows = rows.withColumn("running", F.when(F.col("phase").isNotNull(), F.sum("n").over(running)))
    rows = rows.withColumns(
        {
            "first_ns": F.coalesce(F.min("created_ns").over(key), F.min("at_ns").over(key)),
            "success_ns": F.min(F.when(success, at)).over(key),
            "external_ns": F.min(F.when(sent & (F.col("recipient_is_own_identity") == F.lit(False)), at)).over(key),
        }
    )
    first = F.col("first_ns")
    hour, day = within(at, now, HOUR_NS), within(at, now, DAY_NS)
    resource, credential = kind_of == "resource.created", fold(F.col("kind")).isin(*CREDENTIAL_KINDS)
    windowed = resource | sent
    first_day = (at >= first) & (at <= first + DAY_NS)
    domain = fold(F.col("recipient_domain"))
    to_webmail = domain.isin(*webmail)
    named = kind_of.isin("resource.created", "resource.deleted")
    own_name = F.struct("name_key", F.col("agent_brands").alias("brands"))
    total = lambda condition, value=1: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    flag = lambda condition: F.coalesce(F.max(F.when(condition, 1)), F.lit(0))
    up_to = lambda limit: F.col(limit).isNull() | (at <= F.col(limit))
    grouped = rows.groupBy(*KEY).agg(
        F.first("now_ns").alias("now_ns"),
        F.first("first_ns").alias("first_ns"),
        total(resource & hour).alias("resource_1h"),
        total(resource).alias("resources"),
        total(resource & credential & hour).alias("credential_1h"),
        total(resource & credential).alias("credentials"),
        F.min(F.when(paid, at)).alias("paid_ns"),
        total((kind_of == "payment.attempt") & (F.col("outcome") == "declined") & up_to("success_ns")).alias("declines"),
        F.min_by(F.when(success, F.col("funding")), F.when(success, F.struct("at_ns", "producer", "id"))).alias("first_funding"),
        flag(F.col("has_at")).alias("has_at"),
        F.flatten(F.collect_set(F.when(named, F.col("text_brands")))).alias("named"),
        F.flatten(F.collect_set(F.when(sent & hour, F.col("text_brands")))).alias("lines"),
        F.collect_set(F.when(F.col("agent_brands").isNotNull(), own_name)).alias("agents"),
        F.collect_set(F.when(kind_of == "resource.deleted", F.col("name_key"))).alias("gone"),
        F.size(F.collect_set(F.when(sent & first_day & (F.col("recipient_domain") != ""), domain))).alias("first_day_domains"),
        total(sent & own & up_to("external_ns")).alias("self_sends"),
        total(windowed & day).alias("windowed_day"),
        total(windowed).alias("windowed"),
        _peak(10, "recent").alias("peak"),
        _peak(10, "prior").alias("baseline"),
        total(reach & hour, F.col("n")).alias("sends_1h"),
        total(reach & (at <= now) & first_day, F.col("n")).alias("sends_first_day"),
        total(reach & (at <= now), F.col("n")).alias("sends"),
        total(reach & (at <= now) & to_webmail, F.col("n")).alias("webmail"),
        total(reach & hour & to_webmail, F.col("n")).alias("webmail_1h"),
        F.size(F.collect_set(F.when(reach & hour & (F.col("recipient_hash") != ""), F.col("recipient_hash")))).alias("hashes_1h"),
        total(reach & hour & (F.coalesce(F.col("recipient_hash"), F.lit("")) == ""), F.col("n")).alias("unhashed_1h"),
        F.min(F.when(windowed & hour, at)).alias("oldest_hour"),
        F.min(F.when(windowed & day, at)).alias("oldest_day"),
        F.min(F.when(at > now, at)).alias("future_ns"),
    )
    # brands of names, and brands of the last hour's lines that neither a name nor a live agent's name accounts for
    exempt = F.flatten(F.transform(F.filter("agents", lambda a: ~F.array_contains("gone", a["name_key"])), lambda a: a["brands"]))
    line_brands = F.size(F.array_except(F.array_except(F.array_distinct("lines"), F.col("named")), exempt))
    return finish(grouped.withColumns({"name_brands": F.size("named"), "line_brands": line_brands}))


def finish(grouped: DataFrame) -> DataFrame:
    """Features, with first_ns, decay and next_rescore_ns, from the counts of each point (see ``behaviour`` and ``sweep``)."""
    now, first = F.col("now_ns"), F.col("first_ns")
    seen = first.isNotNull()
    decay = clamp(1 - ((now - first) / float(DAY_NS) - 3) / 27, 0.2, 1.0)
    baseline = F.greatest(F.coalesce(F.col("baseline"), F.lit(0)), F.lit(1))
    burst = lambda value: F.least(F.lit(float(SEND_CAP)), F.coalesce(value, F.lit(0)) / baseline) * F.col("decay")
    grouped = grouped.withColumn("decay", F.when(seen, decay).otherwise(1.0))
    later = lambda value: F.when(value > now, value)
    soon = F.least(F.col("oldest_hour") + HOUR_NS, F.col("oldest_day") + DAY_NS, later(first + DAY_NS), F.col("future_ns"))
    step = 5 * MINUTE_NS
    values = {
        "core.subject_age_h": clamp((now - first) / float(HOUR_NS), 0, 24),
        "core.resource_velocity_1h": F.col("resource_1h"),
        "core.resource_total": F.col("resources"),
        "core.credential_velocity_1h": F.col("credential_1h"),
        "core.credential_total": F.col("credentials"),
        "core.upgrade_delay_min": clamp((F.coalesce(F.col("paid_ns"), now) - first) / float(MINUTE_NS), 0, 1440),
        "core.upgraded": F.col("paid_ns").isNotNull().cast("int"),
        "core.declines_before_first_success": F.col("declines"),
        "core.first_funding_prepaid": (F.coalesce(F.col("first_funding"), F.lit("")) == "prepaid").cast("int"),
        "brand.name_match": (F.col("name_brands") > 0).cast("int"),
        "brand.name_has_at": F.col("has_at"),
        "email.subject_brand_match": F.least(F.lit(3), F.col("line_brands")) * F.col("decay"),
        "email.first_day_distinct_domains": F.log1p("first_day_domains") * LOG_SCALE,
        "email.self_send_before_external": F.least(F.col("self_sends"), F.lit(2)),
        "core.burst_ratio_24h_vs_lifetime": F.when(F.col("windowed") > 0, F.col("windowed_day") / F.col("windowed")),
        "email.sends_10m_max": burst(F.col("peak")),
        "email.sends_1h": burst(F.col("sends_1h")),
        "email.sends_first_day": F.least(F.lit(SEND_CAP), F.col("sends_first_day")),
        "email.webmail_recipient_share": F.when(F.col("sends") > 0, F.col("webmail") / F.col("sends")),
        "email.webmail_sends_1h": burst(F.col("webmail_1h")),
        "email.distinct_recipients_1h": burst(F.col("hashes_1h") + F.col("unhashed_1h")),
    }
    out = [F.coalesce(v.cast("double"), F.lit(0.0)).alias(column(f)) for f, v in values.items()]
    return grouped.select(*KEY, "now_ns", "first_ns", "decay", F.when(seen, -floor_div(-soon, step) * step).alias("next_rescore_ns"), *out)


def features(spine: DataFrame, events: DataFrame, evidence: DataFrame | None = None, brands=BRANDS, webmail=tuple(WEBMAIL), inclusive: bool = False) -> DataFrame:
    """All features of every spine row (tenant, subject, point, now_ns, cutoff_ns), in feature order, with next_rescore_ns.

    ``evidence``: (key, deleted_n, labelled_n, fingerprint_shared, truncated) of linked subjects; without it they count
    nothing. Points without events are all zeros and are never rescored.
    """
    return with_evidence(behaviour(history(spine, tag_brands(events, brands), inclusive), webmail), evidence)


def with_evidence(out: DataFrame, evidence: DataFrame | None) -> DataFrame:
    """``finish``-ed points with the features of linked subjects, in feature order."""
    if evidence is None:
        linked = {"deleted_n": F.lit(0), "labelled_n": F.lit(0), "fingerprint_shared": F.lit(False), "truncated": F.lit(False)}
    else:
        out = out.join(evidence, list(KEY), "left")
        linked = {c: F.col(c) for c in ("deleted_n", "labelled_n", "fingerprint_shared", "truncated")}
    seen = F.col("first_ns").isNotNull()
    more = {
        "core.linked_deleted_n": F.least(F.lit(3), F.coalesce(linked["deleted_n"], F.lit(0))),
        "core.linked_labelled_abusive_n": linked["labelled_n"],
        "core.fingerprint_seen_on_other_subjects": linked["fingerprint_shared"].cast("int"),
        "core.neighbors_truncated": linked["truncated"].cast("int"),
    }
    out = out.withColumns({column(f): F.when(seen, F.coalesce(v.cast("double"), F.lit(0.0))).otherwise(0.0) for f, v in more.items()})
    return out.select(*KEY, "now_ns", *[column(f) for f in FEATURES], "next_rescore_ns")


def as_map(df: DataFrame) -> DataFrame:
    """Adds ``features`` map<string, double> of the feature columns."""
    return df.withColumn("features", F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(column(f)))]))

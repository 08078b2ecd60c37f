"""Replay: decision points from labels or activity, collected texts, corpus snapshots, and scoring at every event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hmac_sha256, parse_rfc3339, split_for
from ..functions.text import skeleton
from ..schema import DAY_NS, HOUR_NS, MINUTE_NS
from .features import as_map, features, history
from .links import evidence_as_of
from .metrics import SLICES
from .ranges import running_sum

RESCORE_STEP = 5 * MINUTE_NS


def _activity(events: DataFrame) -> DataFrame:
    own = (F.col("type") == "content.sent") & (F.col("recipient_is_own_identity") == F.lit(False))
    gone = (F.col("type") == "subject.deleted") & (F.col("mode") == "permanent")
    return events.where("type <> 'label'").groupBy("tenant", "subject").agg(
        F.min("at_ns").alias("first_ns"), F.max("at_ns").alias("last_ns"), F.min(F.when(own, F.col("at_ns"))).alias("external_ns"), F.min(F.when(gone, F.col("at_ns"))).alias("deleted_ns")
    )


def points_from_activity(events: DataFrame) -> DataFrame:
    """Spine (tenant, subject, point, now_ns, cutoff_ns) of the slices that activity itself names and that have an event before them."""
    a = _activity(events)
    full = F.col("last_ns") + 1
    early = F.least(F.col("first_ns") + 15 * MINUTE_NS, full)
    at = F.array(*[F.struct(F.lit(s).alias("point"), v.alias("now_ns")) for s, v in zip(SLICES, (F.least(F.col("external_ns"), early), early, full), strict=True)])
    at = F.filter(at, lambda x: F.coalesce((x["now_ns"] > F.col("first_ns")) & ((x["point"] != "first_send") | F.col("external_ns").isNotNull()), F.lit(False)))
    return a.select("tenant", "subject", F.inline(at)).withColumn("cutoff_ns", F.col("now_ns"))


def points_from_labels(labels: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spine, bad rows) from labels (tenant, subject, label, decision_at map<slice, RFC 3339>).

    Codes, first that holds: zero_events, empty_decision_at, bad_decision_at, slice_order, decision_after_deletion, and
    zero_slices when no slice has an event before it. ``full`` defaults to a nanosecond after the last event.
    """
    rows = labels.join(_activity(events), ["tenant", "subject"], "left")
    given = {s: F.element_at(F.col("decision_at"), s) for s in SLICES}
    ns = {s: parse_rfc3339(v)["at_ns"] for s, v in given.items()}
    rows = rows.withColumns({s: F.coalesce(ns[s], F.when(given[s].isNull(), F.col("last_ns") + 1)) if s == "full" else ns[s] for s in SLICES})
    no = F.lit(False)
    bad = F.lit(False)
    for s in SLICES:
        bad = bad | (given[s].isNotNull() & ns[s].isNull())
    order = no
    for a, b in (("first_send", "early_15m"), ("early_15m", "full"), ("first_send", "full")):
        order = order | F.coalesce(F.col(a) > F.col(b), no)
    after = F.coalesce(F.greatest(*SLICES) > F.col("deleted_ns") + 1, no)
    some = F.coalesce(F.greatest(*SLICES) > F.col("first_ns"), no)
    code = (
        F.when(F.col("first_ns").isNull(), "zero_events")
        .when(F.coalesce(F.size("decision_at") <= 0, F.lit(True)), "empty_decision_at")
        .when(bad, "bad_decision_at")
        .when(order, "slice_order")
        .when(after, "decision_after_deletion")
        .when(~some, "zero_slices")
    )
    rows = rows.withColumn("code", code)
    slices = F.filter(F.array(*[F.struct(F.lit(s).alias("point"), F.col(s).alias("now_ns")) for s in SLICES]), lambda x: x["now_ns"] > F.col("first_ns"))
    spine = rows.where("code is null").select("tenant", "subject", F.inline(slices)).withColumn("cutoff_ns", F.col("now_ns"))
    return spine, rows.where("code is not null").select("tenant", "subject", "code")


def collect_texts(joined: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, text map<field, array<string>>): name and subject skeletons and first link hosts, in event order."""
    fields = {"name_skeleton": skeleton(F.col("name")), "subject_line_skeleton": skeleton(F.col("subject_line")), "first_link_host": F.col("first_link_host")}
    values = F.array(*[F.struct(F.lit(f).alias("field"), v.alias("value")) for f, v in fields.items()])
    rows = joined.select(*keys, "at_ns", "producer", "id", F.inline(values)).where(F.col("value").isNotNull())
    each = rows.groupBy(*keys, "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("at_ns", "producer", "id", "value"))), lambda x: x["value"]).alias("values"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "values")))).alias("text"))


def snapshot_points(labels: DataFrame, events: DataFrame) -> DataFrame:
    """Spine of corpus examples: the first content.sent of a labelled subject, or the label's own instant; inclusive."""
    first = events.where("type = 'content.sent'").groupBy("tenant", "subject").agg(F.min("at_ns").alias("sent_ns"))
    rows = labels.join(first, ["tenant", "subject"], "left")
    return rows.select("tenant", "subject", F.col("label_id").cast("string").alias("point"), "label", F.coalesce("sent_ns", "labelled_ns").alias("now_ns")).withColumn("cutoff_ns", F.col("now_ns"))


def event_slice(spine: DataFrame, events: DataFrame) -> DataFrame:
    """(key, slice): the events of each point up to and at its instant, in order, as an array of structs."""
    part = spine.select("tenant", "subject", "point", "cutoff_ns").join(events.where("type <> 'label'"), ["tenant", "subject"]).where("at_ns <= cutoff_ns")
    return part.groupBy("tenant", "subject", "point").agg(F.array_sort(F.collect_list(F.struct("at_ns", "producer", "id", "type", "name", "subject_line"))).alias("slice"))


def subject_split(subject: Column, secret: bytes) -> Column:
    """train or test by a keyed hash of the subject."""
    return split_for(hmac_sha256(secret, subject))


def unique_ids(events: DataFrame) -> None:
    """Raise if a (producer, id) of a tenant occurs twice, under whatever subject."""
    twice = events.groupBy("tenant", "producer", "id").agg(F.count("*").alias("n")).where("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError("an event id occurs twice")


def every_event(events: DataFrame) -> DataFrame:
    """Spine with one point per event, at its instant and including it; raises if a (producer, id) occurs twice."""
    own = events.where("type <> 'label'")
    unique_ids(own)
    return own.select("tenant", "subject", F.concat_ws("/", "producer", "id").alias("point"), F.col("at_ns").alias("now_ns"), F.col("at_ns").alias("cutoff_ns"))


def _timers(events: DataFrame) -> DataFrame:
    """(tenant, subject, now_ns) of all timer points that a replay of ``events`` meets.

    After each point the next timer is the first instant at which a window loses an event (an hour and a day after a
    windowed event) or the first day ends, rounded up to ``RESCORE_STEP``. So every such instant fires at its step, unless an
    event of the subject comes in between and is scored instead: at or after the instant, and before the step. That is one
    look ahead over the subject's events in order of time, and needs no rounds of scoring.
    """
    key = Window.partitionBy("tenant", "subject")
    first = F.coalesce(F.min(F.when(F.col("type") == "subject.created", parse_rfc3339(F.col("account_created_at"))["at_ns"])).over(key), F.min(F.when(F.col("type") != "label", F.col("at_ns"))).over(key))
    windowed = F.col("type").isin("resource.created", "content.sent")
    exits = F.filter(F.array(F.when(windowed, F.col("at_ns") + HOUR_NS), F.when(windowed, F.col("at_ns") + DAY_NS), F.when(F.row_number().over(key.orderBy("at_ns", "producer", "id")) == 1, first + DAY_NS)), lambda x: x.isNotNull())
    rows = events.select("tenant", "subject", "at_ns", exits.alias("exits"))
    gone = rows.select("tenant", "subject", F.explode("exits").alias("t"), F.lit(False).alias("is_event")).distinct()
    seen = rows.select("tenant", "subject", F.col("at_ns").alias("t"), F.lit(True).alias("is_event")).distinct()
    ahead = key.orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    both = gone.unionByName(seen).withColumn("next", F.min(F.when(F.col("is_event"), F.col("t"))).over(ahead))
    step = (F.ceil(F.col("t") / F.lit(RESCORE_STEP).cast("decimal(20,0)")) * RESCORE_STEP).cast("long")
    fired = both.where(~F.col("is_event")).withColumn("now_ns", step).where(F.col("next").isNull() | (F.col("now_ns") <= F.col("next")))
    return fired.select("tenant", "subject", "now_ns").distinct()


def replay_points(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spine, events with ``seq``) of scoring at every event, label events too, and at every timer until none is pending.

    ``seq`` is the canonical order of the whole log (instant, producer, id). A point of an event knows the events up to
    it in that order, so of events at one instant only earlier ones; a timer goes before the events of its instant. The
    spine has trigger (event or timer), point, now_ns and cutoff_seq. For evidence of linked subjects as of a point, put
    ``seq`` and ``cutoff_seq + 1`` in the places of instant and cutoff (see ``replay_evidence``).
    """
    unique_ids(events)
    told = events.select("tenant", "subject", F.lit("event").alias("trigger"), "producer", "id", F.col("at_ns").alias("now_ns"))
    due = _timers(events).select("tenant", "subject", F.lit("timer").alias("trigger"), F.lit("").alias("producer"), F.lit("").alias("id"), "now_ns")
    is_event = F.col("trigger") == "event"
    rows = told.unionByName(due).withColumn("__late", is_event)
    # the subject comes last, to settle the order of timers
    rows = running_sum(rows, [], ["now_ns", "__late", "producer", "id", "tenant", "subject"], is_event.cast("long"), "cutoff_seq")
    point = F.when(is_event, F.concat_ws("/", "producer", "id")).otherwise(F.concat(F.lit("timer/"), F.col("now_ns").cast("string")))
    spine = rows.select("tenant", "subject", "trigger", point.alias("point"), "now_ns", (F.col("now_ns") + is_event.cast("int")).alias("cutoff_ns"), "cutoff_seq", "producer", "id")
    numbered = events.join(spine.where(is_event).select("tenant", "producer", "id", F.col("cutoff_seq").alias("seq")), ["tenant", "producer", "id"])
    return spine.drop("producer", "id"), numbered


def replay_evidence(spine: DataFrame, events: DataFrame, **options) -> DataFrame:
    """Evidence of linked subjects at replay points, from the events before each in canonical order."""
    return evidence_as_of(spine.withColumn("cutoff_ns", F.col("cutoff_seq") + 1), events.withColumn("at_ns", F.col("seq")), **options)


def corpus_snapshot(labels: DataFrame, events: DataFrame, secret: bytes) -> DataFrame:
    """One example for each label (tenant, subject, label_id, label, labelled_ns, rule): decision instant, event slice,
    features and texts as of it (inclusive), the split by a keyed hash of the subject, gated false."""
    spine = snapshot_points(labels, events)
    key = ["tenant", "subject", "point"]
    as_of = spine.withColumn("cutoff_ns", F.col("cutoff_ns") + 1)
    got = as_map(features(as_of.drop("label"), events, evidence_as_of(as_of, events))).select(*key, "features")
    texts = collect_texts(history(as_of.drop("label"), events), ("tenant", "subject", "point"))
    rows = spine.join(got, key).join(event_slice(spine, events), key, "left").join(texts, key, "left")
    rows = rows.join(labels.select("tenant", F.col("label_id").cast("string").alias("point"), "rule"), ["tenant", "point"])
    none = F.create_map().cast("map<string,array<string>>")
    return rows.select(
        "tenant", F.col("point").alias("label_id"), "subject", "label", "rule", F.col("now_ns").alias("decision_ns"), "slice", "features", F.coalesce("text", none).alias("text"),
        subject_split(F.col("subject"), secret).alias("split"), F.lit(False).alias("gated"),
    )

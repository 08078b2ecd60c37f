"""Streaming ingest, deduplication with conflicts, dirty subjects, incremental scoring and timers.

Batches go through the batch operators in ``foreachBatch``; state lives either in the tables they append to, or in the
stateful operators here. Late and future rows carry a reject code or are counted later. Only the timers have a watermark
and drop rows older than it: ``rescore_timers`` plans from the events themselves, ``score_timers`` keeps the instant that a
subject's last score asked for. State that grows with the log belongs in the RocksDB store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions.scalar import floor_div
from ..operators.ingest import classify, prepare
from ..operators.graph import add_edges
from ..operators.links import link_touches, propagate_dirty
from ..schema import HOUR_NS

STEP_MS = 300_000


def _batch_id(df: DataFrame, batch: int) -> DataFrame:
    """Rows of one micro-batch in a fixed order of arrival."""
    return df.withColumn("seq", F.monotonically_increasing_id()).withColumn("batch", F.lit(batch))


def ingest(raw: DataFrame, events_path: str, rejects_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Validate, redact and append a stream of raw events: good rows to the log, the others with their code.

    A row is classified against its batch and against the log's rows of the same ids, so a batch that is run again appends
    no event twice; its rejects are the partition of its number, which is written over.
    """

    def append(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        checked = _batch_id(prepare(df), batch).persist()
        try:
            log = _log(spark, events_path)
            if log is not None:
                key = ["tenant", "producer", "id"]
                log = log.select(*key, "body_hash").join(checked.select(*key).distinct(), key, "left_semi")
            # rows are told apart by narrow columns, once, and only accepted rows move with all that they hold
            told = classify(checked.where("reject_code is null").select("tenant", "producer", "id", "subject", "body_hash", "received_ns", "seq", "batch"), log).where("outcome <> 'duplicate'").persist()
            refused = checked.where("reject_code is not null").select("tenant", "producer", "id", "subject", F.col("reject_code").alias("code"), "batch")
            conflicts = told.where("outcome = 'conflict'").select("tenant", "producer", "id", "subject", F.lit("conflict").alias("code"), "batch")
            refused.unionByName(conflicts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects_path)
            accepted = checked.join(told.where("outcome = 'accepted'").select("seq"), "seq", "left_semi").drop("seq", "reject_code", "backfill")
            accepted.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("tenant", "day").parquet(events_path)
            told.unpersist()
        finally:
            checked.unpersist()

    writer = raw.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # the first batch meets no log yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def dedup(events: DataFrame) -> DataFrame:
    """Drop repeats of (tenant, producer, id), however late they come; the state holds every id."""
    return events.dropDuplicates(["tenant", "producer", "id"])


def _classify_group(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps an id's first body hash. An id's rows come in parts cut anywhere, in no order: they are counted by hash, with
    each hash's first instant, before any is told."""
    counts: dict[str, int] = {}
    first: dict[str, int] = {}
    for part in parts:
        for value, at in zip(part["body_hash"], part["received_ns"], strict=True):
            counts[value] = counts.get(value, 0) + 1
            first[value] = min(at, first.get(value, at))
    fresh = not state.exists
    known = min(counts, key=lambda value: (first[value], value)) if fresh else state.get[0]
    same = counts.pop(known, 0)
    found = ["accepted"] * fresh + ["duplicate"] * (same - fresh) + ["conflict"] * sum(counts.values())
    for k in range(0, len(found), 10_000):
        yield pd.DataFrame({"tenant": key[0], "producer": key[1], "id": key[2], "outcome": found[k : k + 10_000]})
    if fresh:
        state.update((known,))


def outcomes(prepared: DataFrame) -> DataFrame:
    """(tenant, producer, id, outcome) of a stream of prepared rows, one for each row; the state holds every id's first hash."""
    rows = prepared.select("tenant", "producer", "id", "body_hash", "received_ns")
    return rows.groupBy("tenant", "producer", "id").applyInPandasWithState(
        _classify_group, "tenant string, producer string, id string, outcome string", "hash string", "append", "NoTimeout"
    )


def _exits(ms: int) -> list[int]:
    """When an event at ``ms`` leaves the hour and the day window, rounded up to the step."""
    return [-(-(ms + width) // STEP_MS) * STEP_MS for width in (3_600_000, 86_400_000)]


def _time_group(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Remembers the instants at which a subject's windows change, and tells those that the watermark has passed."""
    waiting = {int(x) for x in state.get[0].split(",")} if state.exists else set()
    for part in parts:
        waiting |= {x for ms in part["ms"].astype("int64") for x in _exits(int(ms))}
    passed = state.getCurrentWatermarkMs()
    due = sorted(x for x in waiting if x <= passed)
    later = sorted(x for x in waiting if x > passed)
    if later:
        state.update((",".join(map(str, later)),))
        state.setTimeoutTimestamp(later[0])
    elif state.exists:
        state.remove()
    if due:
        yield pd.DataFrame({"tenant": key[0], "subject": key[1], "due_ms": due})


def rescore_timers(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(tenant, subject, due_ms): event-time timers at the exits of the hour and day windows, in steps of five minutes.

    A subject's state is bounded by the steps of one day, however many events it has.
    """
    own = events.where(F.col("type").isin("resource.created", "content.sent")).withWatermark("at", delay)
    rows = own.select("tenant", "subject", "at", floor_div(F.col("at_ns"), 1_000_000).alias("ms"))
    return rows.groupBy("tenant", "subject").applyInPandasWithState(
        _time_group, "tenant string, subject string, due_ms long", "waiting string", "append", "EventTimeTimeout"
    )


def _score_group(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the instant asked for by the latest score; tells it once the watermark has passed it."""
    scored, due = state.get if state.exists else (-1, None)
    for part in parts:
        for at, wanted in zip(part["scored_ns"], part["next_rescore_ns"], strict=True):
            if at >= scored:
                scored, due = int(at), None if wanted < 0 else -(-int(wanted) // 1_000_000)
    passed = state.getCurrentWatermarkMs()
    if due is not None and due <= passed:
        yield pd.DataFrame({"tenant": [key[0]], "subject": [key[1]], "due_ms": [due]})
        due = None
    state.update((scored, due))
    if due is not None:
        state.setTimeoutTimestamp(due)


def score_timers(scores: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(tenant, subject, due_ms) from a stream of scores (tenant, subject, at, scored_ns, next_rescore_ns): a later score
    replaces the timer of the one before, and one that asks for none removes it. What is asked for comes from the features
    (see ``features``): the next window exit, the end of the first day, or a future event."""
    rows = scores.withWatermark("at", delay).select("tenant", "subject", "at", "scored_ns", F.coalesce("next_rescore_ns", F.lit(-1)).alias("next_rescore_ns"))
    return rows.groupBy("tenant", "subject").applyInPandasWithState(
        _score_group, "tenant string, subject string, due_ms long", "scored long, due long", "append", "EventTimeTimeout"
    )


def velocity(events: DataFrame) -> DataFrame:
    """Resource and send counts of each subject by sliding hour, for dashboards; exact windows come from the features.

    For update or complete mode: a window stays open to late and backfilled events, so its count is kept.
    """
    own = events.where(F.col("type").isin("resource.created", "content.sent"))
    return own.groupBy("tenant", "subject", F.window("at", "1 hour", "5 minutes")).agg(F.count_if(F.col("type") == "resource.created").alias("resources"), F.count_if(F.col("type") == "content.sent").alias("sends"))


def dirty_subjects(batch: DataFrame, links: DataFrame) -> DataFrame:
    """(tenant, subject) that a micro-batch makes due: its own, and neighbours of those deleted for good or labelled abusive."""
    own = batch.select("tenant", "subject").distinct()
    changed = batch.where("(type = 'subject.deleted' and mode = 'permanent') or (type = 'label' and label = 'abusive')").select("tenant", "subject").distinct()
    return own.unionByName(propagate_dirty(changed, links)).distinct()


def score_stream(events: DataFrame, score: Callable[[DataFrame, int], DataFrame], verdicts_path: str, links: Callable[[], DataFrame], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Score the subjects that each micro-batch makes due. ``score`` takes (tenant, subject) and the batch number, which
    stands as the round in the appended verdicts; a round run again is overtaken by itself (see current_round)."""

    def run(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            verdicts = score(dirty_subjects(df, links()), batch)
            verdicts.withColumn("dirty_seq_at_start", F.lit(batch).cast("long")).write.mode("append").parquet(verdicts_path)
        finally:
            df.unpersist()

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def link_edges(touches: DataFrame) -> DataFrame:
    """(src, dst): subjects, as ``s`` and the name, with the keys that they touched."""
    key = F.concat_ws("\x1f", F.lit("key"), "tenant", "kind", "hash")
    return touches.select(F.concat_ws("\x1f", F.lit("s"), "tenant", "subject").alias("src"), key.alias("dst"))


def cluster_stream(events: DataFrame, forest_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the clusters of linked subjects up to date: each micro-batch contracts its own links against the components so
    far (see ``graph.add_edges``), and its number is the version of the rows that it adds."""

    def run(df: DataFrame, batch: int) -> None:
        add_edges(link_edges(link_touches(df)), forest_path, batch)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def is_late(received_ns: str = "received_ns", at_ns: str = "at_ns", most: int = 24 * HOUR_NS):
    """A row outside the accepted skew, told apart instead of dropped."""
    return F.abs(F.col(received_ns) - F.col(at_ns)) > most

"""Operators with several state variables, timers and expiring state: ``transformWithState`` on the RocksDB store; ingest by
an aggregate, or by ``applyInPandasWithState`` where ids expire.

Timers here go by the clock of the cluster, as a due score does: no watermark stands before them, so no row is ever too late
for its state, and an instant that has passed when its row comes is told at once or in the next micro-batch. Use
``with_state_store`` before a query starts. In an availableNow run, switch off spark.sql.streaming.noDataMicroBatches.enabled
(``with_state_store`` does): timers by the clock would go on asking for another batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.ingest import prepare
from ..schema import DAY_NS, HOUR_NS

STEP_MS = 300_000
MS = 1_000_000
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

#: Instants in JSON to the microsecond that Spark keeps.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """RocksDB as the state store of the queries started inside; the session's own settings come back at the end."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class _ScoreTimer(StatefulProcessor):
    """The instant asked for by a subject's latest score. One timer a subject: a later score deletes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scored = handle.getValueState("scored", "scored_ns long")
        self.due = handle.getValueState("due", "due_ms long")

    def handleInputRows(self, key, rows, timerValues):
        scored, wanted = self.scored.get()[0] if self.scored.exists() else -1, None
        newer = False
        for row in rows:
            if row["scored_ns"] >= scored:
                scored, wanted, newer = row["scored_ns"], row["next_rescore_ns"], True
        if not newer:
            return
        self.scored.update((scored,))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if wanted is not None:
            due = -(-wanted // MS)
            self.due.update((due,))
            self.handle.registerTimer(due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.exists() and self.due.get()[0] == due:
            self.due.clear()
            yield Row(tenant=key[0], subject=key[1], due_ms=due)

    def close(self) -> None:
        pass


def score_timers(scores: DataFrame) -> DataFrame:
    """(tenant, subject, due_ms) from a stream of scores (tenant, subject, scored_ns, next_rescore_ns): when the clock passes
    what a subject's latest score asked for. A later score replaces the timer, one that asks for none deletes it, and an
    earlier one that comes late changes nothing."""
    rows = scores.select("tenant", "subject", "scored_ns", "next_rescore_ns")
    return rows.groupBy("tenant", "subject").transformWithState(_ScoreTimer(), "tenant string, subject string, due_ms long", "Append", "ProcessingTime")


class _ExitTimers(StatefulProcessor):
    """The steps at which a subject's windows lose an event, each once. One timer a subject, for the first of them: what is
    asked of the store does not grow with the steps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "due_ms long")

    def _known(self) -> set[int]:
        return {x[0] for x in self.waiting.get()} if self.waiting.exists() else set()

    def _wait(self, steps: set[int]) -> None:
        if steps:
            self.waiting.put([(due,) for due in sorted(steps)])
            self.handle.registerTimer(min(steps))
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows, timerValues):
        known = self._known()
        if known:
            self.handle.deleteTimer(min(known))
        self._wait(known | {-(-(row["at_ns"] + width) // (STEP_MS * MS)) * STEP_MS for row in rows for width in (HOUR_NS, DAY_NS)})
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known, now = self._known(), max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._wait({due for due in known if due > now})
        for due in sorted(known):
            if due <= now:
                yield Row(tenant=key[0], subject=key[1], due_ms=due)

    def close(self) -> None:
        pass


def rescore_timers(events: DataFrame) -> DataFrame:
    """(tenant, subject, due_ms): timers at the exits of the hour and day windows of each resource or send, in steps of five
    minutes, planned from the events alone. Late events have their timers, too. What is due stays bounded by the steps of a
    day and by late events."""
    own = events.where(F.col("type").isin("resource.created", "content.sent")).select("tenant", "subject", "at_ns")
    return own.groupBy("tenant", "subject").transformWithState(_ExitTimers(), "tenant string, subject string, due_ms long", "Append", "ProcessingTime")


class _FirstHash(StatefulProcessor):
    """An id's first body hash, for as long as a repeat may come."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "body_hash string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        held = self.known.get()  # one call to the store, and none more for an id that is known
        known = held[0] if held else None
        fresh = known is None
        for row in sorted(rows, key=lambda r: r["received_ns"]):
            value = row["body_hash"]
            outcome = "accepted" if known is None else "duplicate" if value == known else "conflict"
            known = value if known is None else known
            yield Row(tenant=key[0], producer=key[1], id=key[2], received_ns=row["received_ns"], outcome=outcome)
        if fresh and known is not None:
            self.known.update((known,))

    def close(self) -> None:
        pass


def outcomes(prepared: DataFrame, ttl_ms: int = 48 * 3_600_000) -> DataFrame:
    """(tenant, producer, id, received_ns, outcome) of a stream of prepared rows, one for each. An id's hash is kept for
    ``ttl_ms`` after it was first seen (the skew that ingest accepts, twice, by default): an id that comes back later is
    told from the log (see ``jobs.ingest``), not from state."""
    rows = prepared.select("tenant", "producer", "id", "body_hash", "received_ns")
    return rows.groupBy("tenant", "producer", "id").transformWithState(_FirstHash(ttl_ms), "tenant string, producer string, id string, received_ns long, outcome string", "Append", "ProcessingTime")


def _judge_group(ttl_ms: int | None):
    """Passes an id's rows on with their outcome, and keeps its first body hash and until when it counts."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known, until = state.get if state.exists else (None, None)
        if until is not None and until <= now:
            known = None
        if state.hasTimedOut:
            if state.exists:
                state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["received_ns", "body_hash"], kind="stable")
        hashes = rows["body_hash"].tolist()
        found = ["accepted"] if known is None else []
        if known is None:
            known, until = hashes[0], None if ttl_ms is None else now + ttl_ms
            state.update((known, until))
        found += ["duplicate" if value == known else "conflict" for value in hashes[len(found) :]]
        if until is not None:
            state.setTimeoutDuration(until - now)
        yield pd.DataFrame({"row": rows["row"].to_numpy(), "judged": found})

    return run


def judged(prepared: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """A stream of prepared rows that are not rejected, with ``judged`` (accepted, duplicate or conflict), from the first hash
    of each id in state. State comes and goes with the rows: a processor that asks the store for each id waits for every
    answer. A row passes as one text, as Python would take each of its columns apart."""
    rows = prepared.select("tenant", "producer", "id", "body_hash", "received_ns", F.to_json(F.struct(*prepared.columns), _EXACT).alias("row"))
    timeout = "NoTimeout" if ttl_ms is None else "ProcessingTimeTimeout"
    passed = rows.groupBy("tenant", "producer", "id").applyInPandasWithState(_judge_group(ttl_ms), "row string, judged string", "known string, until long", "append", timeout)
    return passed.select(F.from_json("row", prepared.schema, _EXACT).alias("row"), "judged").select("row.*", "judged")


def first_seen(prepared: DataFrame) -> DataFrame:
    """(tenant, producer, id, first, seen) of a stream of prepared rows with ``batch_at``, in update mode: of each id that a
    micro-batch brings and does not reject, the instant of the batch that brought it first, with the earliest row's
    received_ns and body hash there, and how many rows it has had in all. Spark's own aggregate: no id is a call of Python."""
    return prepared.where("reject_code is null").groupBy("tenant", "producer", "id").agg(F.min(F.struct("batch_at", "received_ns", "body_hash")).alias("first"), F.count("*").alias("seen"))


def _told(df: DataFrame) -> DataFrame:
    """``judged`` for the rows of one micro-batch, which hold those of ``first_seen``, too; without the duplicates. An id is
    new where all rows that it has had are here."""
    # a rejected row meets no other: its id may be one that all of them have
    alone = F.when(F.col("reject_code").isNotNull(), F.monotonically_increasing_id())
    of_id = Window.partitionBy("tenant", "producer", "id", "__alone")
    rows = df.withColumn("__alone", alone).withColumns(
        {
            "__first": F.max("first").over(of_id),
            "__seen": F.max("seen").over(of_id),
            "__here": F.count("batch_at").over(of_id),
            "__place": F.row_number().over(of_id.orderBy(F.col("batch_at").isNull(), "received_ns", "body_hash")),
        }
    )
    fresh = F.col("__seen") == F.col("__here")
    # the first of an id that came before can't be of this batch
    back = ~fresh & (F.col("__first.batch_at") >= F.col("batch_at"))
    found = (
        F.when(F.col("reject_code").isNotNull(), "rejected")
        .when(back, F.raise_error(F.lit("the clock stands before an earlier micro-batch")).cast("string"))
        .when(fresh & (F.col("__place") == 1), "accepted")
        .when(F.col("body_hash") == F.col("__first.body_hash"), "duplicate")
        .otherwise("conflict")
    )
    told = rows.where("batch_at is not null").withColumn("judged", found).where("judged <> 'duplicate'")
    return told.drop("first", "seen", "batch_at", "__alone", "__first", "__seen", "__here", "__place")


def ingest(raw: DataFrame, events_path: str, rejects_path: str, checkpoint: str, trigger: dict | None = None, ttl_ms: int | None = None) -> StreamingQuery:
    """As ``jobs.ingest``, but what is known of each id is in state and not looked up in the log: a micro-batch reads its own
    rows and the state of its own ids, however long the log has grown (RocksDB's files have Bloom filters of their keys).

    Log and rejects are partitioned by micro-batch, too, so one that runs again writes its own partitions over. A session
    needs ``with_state_store`` when this starts. Ids are known for ever, by an aggregate whose rows meet the batch's own, or
    for ``ttl_ms``, which takes a call of Python for each id.
    """
    prepared = prepare(raw)
    if ttl_ms is None:
        prepared = prepared.withColumn("batch_at", F.current_timestamp())
        both, mode = prepared.unionByName(first_seen(prepared), allowMissingColumns=True), "update"
    else:
        both, mode = judged(prepared.where("reject_code is null"), ttl_ms).unionByName(prepared.where("reject_code is not null").withColumn("judged", F.lit("rejected"))), "append"

    def put(df: DataFrame, batch: int) -> None:
        df = (_told(df) if ttl_ms is None else df).withColumn("batch", F.lit(batch)).persist()
        try:
            code = F.coalesce("reject_code", F.lit("conflict"))
            refused = df.where("judged in ('rejected', 'conflict')").select("tenant", "producer", "id", "subject", code.alias("code"), "batch")
            refused.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(rejects_path)
            accepted = df.where("judged = 'accepted'").drop("judged", "reject_code", "backfill").withColumn("day", F.to_date("at"))
            accepted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "tenant", "day").parquet(events_path)
        finally:
            df.unpersist()

    return both.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Velocity(StatefulProcessor):
    """A subject's recent resources and sends in state, each told with the counts of the hour up to it."""

    def __init__(self, keep_ns: int):
        self.keep_ns = keep_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "at_ns long, producer string, id string, resources long, sends long")
        self.latest = handle.getValueState("latest", "at_ns long, timer_ms long")

    def handleInputRows(self, key, rows, timerValues):
        new = sorted((r["at_ns"], r["producer"], r["id"], r["resources"], r["sends"]) for r in rows)
        old = [tuple(x) for x in self.recent.get()] if self.recent.exists() else []
        both, fresh = sorted(old + new), set(new)
        low = resources = sends = 0
        for row in both:
            resources += row[3]
            sends += row[4]
            while both[low][0] <= row[0] - HOUR_NS:
                resources -= both[low][3]
                sends -= both[low][4]
                low += 1
            if row in fresh:
                yield Row(tenant=key[0], subject=key[1], producer=row[1], id=row[2], at_ns=row[0], resource_1h=resources, sends_1h=sends)
        kept = [r for r in both if r[0] > both[-1][0] - self.keep_ns]
        self.recent.put(kept)
        # idle subjects let go of their state: the timer of the last event's hour, by the clock
        due = timerValues.getCurrentProcessingTimeInMs() + self.keep_ns // MS
        if self.latest.exists():
            self.handle.deleteTimer(self.latest.get()[1])
        self.latest.update((both[-1][0], due))
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.recent.clear()
        self.latest.clear()
        yield from ()

    def close(self) -> None:
        pass


def velocity(events: DataFrame, keep_ns: int = 25 * HOUR_NS) -> DataFrame:
    """(tenant, subject, producer, id, at_ns, resource_1h, sends_1h): at each resource or send the number of resources and of
    recipients in the hour up to it, itself and what came in with it included. State keeps ``keep_ns`` before a subject's
    latest event, so an event that is less late than that has exact counts; rows already told are not told again."""
    own = F.coalesce(F.col("recipient_is_own_identity"), F.lit(False))
    count = F.col("recipient_count")
    n = F.least(F.lit(300), F.when((count > 0) & (count == F.floor(count)), count).otherwise(1)).cast("long")
    created, sent = F.col("type") == "resource.created", F.col("type") == "content.sent"
    rows = events.where(created | sent).select(
        "tenant", "subject", "producer", "id", "at_ns", created.cast("long").alias("resources"), F.when(sent & ~own, n).otherwise(0).cast("long").alias("sends")
    )
    return rows.groupBy("tenant", "subject").transformWithState(
        _Velocity(keep_ns), "tenant string, subject string, producer string, id string, at_ns long, resource_1h long, sends_1h long", "Append", "ProcessingTime"
    )

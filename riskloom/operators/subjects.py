"""Subject roll-ups, verdict history views, the set to score again, usage and operational counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..schema import DAY_NS


def roll_up(events: DataFrame, bumps: DataFrame | None = None) -> DataFrame:
    """(tenant, subject, first_ns, last_ns, dirty_seq): bumps (tenant, subject) are labels and propagations."""
    rows = events.select("tenant", "subject", "at_ns")
    if bumps is not None:
        rows = rows.unionByName(bumps.select("tenant", "subject", F.lit(None).cast("long").alias("at_ns")))
    return rows.groupBy("tenant", "subject").agg(F.min("at_ns").alias("first_ns"), F.max("at_ns").alias("last_ns"), F.count("*").alias("dirty_seq"))


def latest_class(events: DataFrame) -> DataFrame:
    """(tenant, subject, class): the latest by event time, at a tie the later arrival (column seq)."""
    own = events.where("type = 'subject.class'")
    return own.groupBy("tenant", "subject").agg(F.max_by("class", F.struct("at_ns", "seq")).alias("class"))


def scorable(subjects: DataFrame) -> DataFrame:
    """Internal and synthetic subjects are kept but never scored."""
    return subjects.where(~F.coalesce(F.col("class"), F.lit("customer")).isin("internal", "synthetic"))


def latest_verdicts(verdicts: DataFrame) -> DataFrame:
    """(tenant, subject, rule): the newest row's status and, from the newest scored row, risk and input hash."""
    order = F.struct("scored_ns", "id")
    scored = F.col("status") == "scored"
    return verdicts.groupBy("tenant", "subject", "rule").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("mode", order).alias("mode"),
        F.max_by("error_code", order).alias("error_code"),
        F.max("scored_ns").alias("scored_ns"),
        F.max_by(F.when(scored, F.col("risk")), F.when(scored, order)).alias("last_risk"),
        F.max_by(F.when(scored, F.col("input_hash")), F.when(scored, order)).alias("last_hash"),
        F.max(F.when(scored, F.col("scored_ns"))).alias("last_scored_ns"),
    )


def current_round(verdicts: DataFrame) -> DataFrame:
    """The verdict rounds that stand: of each (tenant, subject), the rows of the highest dirty_seq_at_start.

    A round that a newer one has overtaken drops out here, so appending needs no lock and may be repeated.
    """
    top = Window.partitionBy("tenant", "subject")
    return verdicts.withColumn("__top", F.max("dirty_seq_at_start").over(top)).where("dirty_seq_at_start = __top").drop("__top")


def subject_view(subjects: DataFrame, verdicts: DataFrame, rules: DataFrame) -> DataFrame:
    """(subjects columns, signals, degraded, stale, events_since_score); ``rules``: current (rule, mode).

    Degraded: a current advise rule is unscored or has no verdict. Stale: something came after the scored round.
    """
    latest = latest_verdicts(verdicts)
    wanted = rules.select("rule", F.col("mode").alias("now_mode"))
    every = subjects.select("tenant", "subject").crossJoin(F.broadcast(wanted))
    joined = every.join(latest, ["tenant", "subject", "rule"], "left")
    weak = (F.col("now_mode") == "advise") & (F.col("status").isNull() | (F.col("status") == "unscored"))
    signal = F.when(F.col("status").isNotNull(), F.struct("rule", "mode", "status", F.col("last_risk").alias("risk"), "error_code"))
    view = joined.groupBy("tenant", "subject").agg(F.array_sort(F.collect_list(signal)).alias("signals"), F.max(weak).alias("degraded"))
    since = F.col("dirty_seq") - F.coalesce("scored_seq", F.lit(0))
    return subjects.join(view, ["tenant", "subject"], "left").withColumns({"events_since_score": since, "stale": since > 0})


def due(subjects: DataFrame, now_ns: int, limit: int | None = 200) -> DataFrame:
    """Subjects to score now: changed ones first, then timers; new accounts, then higher scores, then older events first."""
    dirty = F.col("dirty_seq") > F.coalesce("scored_seq", F.lit(0))
    timer = ~dirty & F.coalesce(F.col("next_rescore_ns") <= now_ns, F.lit(False))
    rows = scorable(subjects).where(dirty | timer)
    young = F.coalesce(F.col("first_ns") > now_ns - DAY_NS, F.lit(False))
    rows = rows.withColumns({"dirty": dirty, "young": young}).orderBy(F.desc("dirty"), F.desc("young"), F.desc_nulls_first("score"), F.asc("last_ns"), F.asc("subject"))
    return rows.limit(limit) if limit else rows


def backlog(subjects: DataFrame, now_ns: int) -> DataFrame:
    """One row: how many subjects are due, and the age of the oldest change among them."""
    rows = scorable(subjects)
    dirty = F.col("dirty_seq") > F.coalesce("scored_seq", F.lit(0))
    timer = F.coalesce(F.col("next_rescore_ns") <= now_ns, F.lit(False))
    return rows.agg(F.count_if(dirty | timer).alias("due"), (F.lit(now_ns) - F.min(F.when(dirty, F.col("last_ns")))).alias("oldest_age_ns"))


def usage(calls: DataFrame) -> DataFrame:
    """(day, dim, key, n) of calls to scorers that cost something: by adapter, subject and tenant."""
    paid = calls.where("scorer <> 'local'").withColumn("day", F.date_format(F.timestamp_micros(floor_div(F.col("called_ns"), 1000)), "yyyy-MM-dd"))
    dims = F.array(
        F.struct(F.lit("adapter").alias("dim"), F.col("scorer").alias("key")),
        F.struct(F.lit("subject").alias("dim"), F.concat_ws("/", "tenant", "subject").alias("key")),
        F.struct(F.lit("tenant").alias("dim"), F.col("tenant").alias("key")),
    )
    return paid.select("day", F.inline(dims)).groupBy("day", "dim", "key").agg(F.count("*").alias("n"))


def cap_report(used: DataFrame, adapter_cap: int, subject_cap: int = 20, tenant_cap: int = 0, reserve: float = 0.25) -> DataFrame:
    """Usage against the daily caps; ``open_cap`` is what is left to subjects that are not elevated. A cap of 0 is none."""
    cap = F.when(F.col("dim") == "adapter", adapter_cap).when(F.col("dim") == "subject", subject_cap).otherwise(tenant_cap)
    rows = used.withColumn("cap", cap)
    open_cap = F.when(F.col("dim") == "adapter", F.col("cap") - F.floor(F.col("cap") * reserve)).otherwise(F.col("cap"))
    over = lambda c: (F.col("cap") > 0) & (F.col("n") >= c)
    return rows.withColumn("open_cap", open_cap).withColumns({"open_full": over(F.col("open_cap")), "full": over(F.col("cap"))})


def counters(verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts by tier, and calls, errors, denials and mean latency by scorer."""
    by_tier = verdicts.groupBy("tier").agg(F.count("*").alias("n"))
    denied = F.col("error_code") == "cost_cap"
    by_scorer = verdicts.groupBy("scorer").agg(F.count("*").alias("calls"), F.count_if(F.col("error_code").isNotNull() & ~denied).alias("errors"), F.count_if(F.coalesce(denied, F.lit(False))).alias("denials"), F.avg("latency_ms").alias("mean_latency_ms"))
    return by_tier, by_scorer

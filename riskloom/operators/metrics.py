"""Evaluation: runs over labelled subjects, confusion, intervals, calibration, AUROC, lead time and gates.

Metrics are grouped aggregations over (run keys); the only global order, AUROC's, runs over ranges of distinct risks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import family_keys, wilson
from ..schema import CombineParams
from .ranges import running_sum

SLICES = ("first_send", "early_15m", "full")


def run_slice(subjects: DataFrame, points: DataFrame, slice_name: str) -> DataFrame:
    """One row per subject at a slice: its scored point, or unscored with skipped_events or missing_slice."""
    at = points.where(F.col("slice") == slice_name).drop("slice")
    rows = subjects.join(at.withColumn("__found", F.lit(True)), "subject", "left")
    code = F.when(F.coalesce("has_skipped_events", F.lit(False)), "skipped_events").when(F.col("__found").isNull(), "missing_slice").otherwise(F.col("error_code"))
    rows = rows.withColumn("error_code", code)
    return rows.withColumns({"unscored": F.col("error_code").isNotNull(), "risk": F.when(F.col("error_code").isNull(), F.col("risk")), "slice": F.lit(slice_name)}).drop("__found")


def bad_labels(subjects: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    return subjects.where(~F.col("label").isin(*labels) | F.col("label").isNull()).select("subject", "label")


def filter_split(subjects: DataFrame, split: str) -> DataFrame:
    if split not in ("train", "test", "all"):
        raise ValueError(f"split {split}")
    return subjects if split == "all" else subjects.where(F.col("split") == split)


def _rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = F.when(tp + fp > 0, tp / (tp + fp)), F.when(tp + fn > 0, tp / (tp + fn))
    p, r = wilson(tp, tp + fp), wilson(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)), "precision_low": p["low"], "precision_high": p["high"], "recall_low": r["low"], "recall_high": r["high"]}


def confusion(records: DataFrame, keys: tuple[str, ...] = (), flagged: Column | None = None) -> DataFrame:
    """Counts and rates of records (positive, unscored, risk, flagged): an unscored positive is a miss, an unscored
    negative is left out. Records with ``truncated`` or ``cost_micro`` are counted and added up by them, too."""
    flag = F.col("flagged") if flagged is None else flagged
    scored = ~F.col("unscored")
    count = lambda c: F.count_if(c)
    out = records.groupBy(*keys).agg(
        count(F.col("positive") & scored & flag).alias("tp"),
        count(~F.col("positive") & scored & flag).alias("fp"),
        count(~F.col("positive") & scored & ~flag).alias("tn"),
        count(F.col("positive") & (F.col("unscored") | ~flag)).alias("fn"),
        count(F.col("unscored")).alias("unscored"),
        count(F.coalesce(F.col("error_code") == "missing_slice", F.lit(False))).alias("missing_slice"),
        F.count("*").alias("total"),
        *([count(F.coalesce("truncated", F.lit(False))).alias("truncated")] if "truncated" in records.columns else []),
        *([F.coalesce(F.sum("cost_micro"), F.lit(0)).cast("long").alias("cost_micro")] if "cost_micro" in records.columns else []),
    )
    return out.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("fn")))


def tier_confusion(records: DataFrame, keys: tuple[str, ...] = (), params: CombineParams = CombineParams()) -> DataFrame:
    """Confusion at each tier cut; no rows if the cuts are not valid."""
    cuts = [("high", params.high), ("medium", params.medium)] if params.valid else []
    at = F.array(*[F.struct(F.lit(n).alias("cut"), F.lit(float(v)).alias("cut_value")) for n, v in cuts]).cast("array<struct<cut:string,cut_value:double>>")
    rows = records.select("*", F.inline(at))
    return confusion(rows, (*keys, "cut"), F.coalesce(F.col("risk") >= F.col("cut_value"), F.lit(False)))


def family_recall(records: DataFrame, params: CombineParams = CombineParams()) -> DataFrame:
    """(family, hits, n, recall) of the positives of each scenario family at the high cut."""
    rows = records.where("positive").withColumn("family", F.explode(family_keys(F.col("category"), F.col("subject"))))
    hit = ~F.col("unscored") & (F.col("risk") >= params.high)
    return rows.groupBy("family").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.count("*").alias("n")).withColumn("recall", F.col("hits") / F.col("n"))


def calibration_bins(records: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_risk, positive_rate) for every bin, empty ones included."""
    place = F.least(F.lit(bins - 1), F.greatest(F.lit(0), (F.col("risk") * bins).cast("int")))
    got = records.where("not unscored").groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg("risk").alias("mean_risk"), F.avg(F.col("positive").cast("double")).alias("positive_rate"))
    every = records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(records: DataFrame, bins: int = 10) -> DataFrame:
    """One row with ``ece``; null without a scored record."""
    parts = calibration_bins(records, bins)
    return parts.agg((F.sum(F.col("n") * F.abs(F.col("mean_risk") - F.col("positive_rate"))) / F.sum("n")).alias("__ece"), F.sum("n").alias("__n")).select(F.when(F.col("__n") > 0, F.col("__ece")).alias("ece"))


def auroc(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, auroc) by ranks, tied risks sharing their mean rank; null if one class is missing."""
    each = records.where("not unscored").groupBy(*keys, "risk").agg(F.count_if(F.col("positive")).alias("pos"), F.count_if(~F.col("positive")).alias("neg"))
    upto = running_sum(each, list(keys), ["risk"], F.col("neg"), "upto")
    won = upto.withColumn("won", F.col("pos") * (F.col("upto") - F.col("neg") / 2))
    total = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("won") / (F.col("p") * F.col("n"))).alias("auroc"))


def lead_time(records: DataFrame) -> DataFrame:
    """(first_flagged, n): positives by the earliest slice that flags them, or never; every bucket is there."""
    order = F.array_position(F.array(*[F.lit(s) for s in SLICES]), F.col("slice"))
    first = records.where("positive").groupBy("subject").agg(F.min(F.when(F.col("flagged") & ~F.col("unscored"), order)).alias("k"))
    named = first.groupBy(F.coalesce(F.get(F.array(*[F.lit(s) for s in SLICES]), (F.col("k") - 1).cast("int")), F.lit("never")).alias("first_flagged")).agg(F.count("*").alias("n"))
    every = records.sparkSession.createDataFrame([(s,) for s in (*SLICES, "never")], "first_flagged string")
    return every.join(named, "first_flagged", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def quantiles(records: DataFrame, keys: tuple[str, ...], value: str, at: tuple[float, ...]) -> DataFrame:
    """(keys, q array<double>): exact quantiles with linear interpolation, null without a value.

    Equal values are counted before anything moves; the counted ones are ranked by sorted ranges (see ``running_sum``), and
    a quantile is the values whose ranks enclose it. So no buffer holds a key's values, however many they are.
    """
    counted = records.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    ranked = running_sum(counted, list(keys), ["__x"], F.col("__c"), "__upto")
    totals = records.groupBy(*keys).agg(F.count(value).alias("__n")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = totals.join(ranked, same, "left")
    found = []
    for i, q in enumerate(at):
        place = (F.col("__n") - 1) * F.lit(float(q))
        for name, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.max(F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("__c")), F.col("__x"))).alias(f"__{name}{i}"))
    got = rows.groupBy(*[f"__k{i}" for i in range(len(keys))], "__n").agg(*found)
    out = []
    for i, q in enumerate(at):
        place, low, high = (F.col("__n") - 1) * F.lit(float(q)), F.col(f"__low{i}"), F.col(f"__high{i}")
        out.append(F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high))
    return got.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], F.array(*out).alias("q"))


def latency(records: DataFrame, keys: tuple[str, ...] = (), value: str = "latency_ms") -> DataFrame:
    """Exact p50 and p95 with linear interpolation."""
    return quantiles(records, keys, value, (0.5, 0.95)).select(*keys, F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"))


def long_metrics(records: DataFrame, params: CombineParams = CombineParams()) -> DataFrame:
    """(metric, value) of a run: precision, recall, auroc, ece, high_tier_recall, and recall of each family."""
    whole = confusion(records).select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall")])))
    area = auroc(records).select(F.lit("auroc").alias("metric"), F.col("auroc").alias("value"))
    ece = calibration_error(records).select(F.lit("ece").alias("metric"), F.col("ece").alias("value"))
    high = tier_confusion(records, (), params).where("cut = 'high'").select(F.lit("high_tier_recall").alias("metric"), F.col("recall").alias("value"))
    families = family_recall(records, params).select(F.concat(F.lit("family_high_tier_recall."), "family").alias("metric"), F.col("recall").alias("value"))
    return whole.unionByName(area).unionByName(ece).unionByName(high).unionByName(families)


RUN = ("rule", "scorer", "slice")


def gate(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """Violations (metric, floor, got, undefined) of floors (metric, floor); ece is a ceiling; an undefined metric fails.

    With columns rule, scorer and slice in ``floors``, each floor holds for the run of that name: a floor of a run that
    is not in ``metrics`` is an error. So is one outside [0, 1] or without a name.
    """
    run = [c for c in RUN if c in floors.columns]
    wrong = floors.where((F.col("floor") < 0) | (F.col("floor") > 1) | F.col("floor").isNull() | F.exists(F.array(*[F.col(c) for c in (*run, "metric")]), lambda c: F.coalesce(c, F.lit("")) == "")).limit(1)
    if (row := wrong.first()) is not None:
        raise ValueError(f"floor {row.asDict()}")
    if run and (row := floors.join(metrics, run, "left_anti").first()) is not None:
        raise LookupError(f"no run for floor {row.asDict()}")
    joined = floors.join(metrics, [*run, "metric"], "left")
    broken = F.when(F.col("metric") == "ece", F.col("value") > F.col("floor")).otherwise(F.col("value") < F.col("floor"))
    return joined.where(F.col("value").isNull() | broken).select(*run, "metric", "floor", F.col("value").alias("got"), F.col("value").isNull().alias("undefined"))


def replay_recorded(calls: DataFrame, recorded: DataFrame, corpus_hash: str | None = None) -> DataFrame:
    """Calls with the stored ``probs`` of (scorer, version, model, prompt_version, input_hash); a miss fails the run.
    With ``corpus_hash`` so does a recording (column corpus_hash) made over another corpus."""
    if corpus_hash is not None and (row := recorded.where(~F.col("corpus_hash").eqNullSafe(F.lit(corpus_hash))).first()) is not None:
        raise ValueError(f"recorded over another corpus: {row['corpus_hash']}")
    key = ["scorer", "version", "model", "prompt_version", "input_hash"]
    missing = calls.join(recorded, key, "left_anti").select(*key).limit(1)
    if not missing.isEmpty():
        raise LookupError(f"no recorded score for {missing.first().asDict()}")
    return calls.join(recorded.select(*key, "probs"), key)


def compare_runs(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that differ: (keys, side 'left', 'right' or 'both' with the differing columns)."""
    values = [c for c in left.columns if c not in keys]
    a, b = left.withColumn("__l", F.lit(True)).alias("a"), right.withColumn("__r", F.lit(True)).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = a.join(b, on, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in values])) if values else F.array().cast("array<string>")
    side = F.when(F.col("b.__r").isNull(), "left").when(F.col("a.__l").isNull(), "right").otherwise("both")
    rows = joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], side.alias("side"), changed.alias("columns"))
    return rows.where((F.col("side") != "both") | (F.size("columns") > 0))

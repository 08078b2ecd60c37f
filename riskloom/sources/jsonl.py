"""JSON Lines sources with row-level errors, and the sinks of the event, verdict, label and run tables.

Readers return good rows and error rows (source, line, code) side by side; ``strict`` turns any error into a failure.
Files are read line by line in splits of any size; lines are numbered by their place in the split and the number of lines
in the splits of the file before it, which are counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import parse_rfc3339
from ..operators.ingest import feature_key_code, judge, prepare
from ..schema import DATA_TYPES, LINK_KINDS
from .shared import written

_EVENT_KEYS = ("producer", "id", "subject", "type", "at", "links", "data")
_LABEL_KEYS = ("subject", "label", "category", "source", "decision_at")
_CORPUS_KEYS = ("feature_key_space", "id", "input", "label", "split", "source", "meta")
KEY_SPACE = "ns-v1"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line, value) of the lines that are not blank."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    splits = rows.groupBy("source", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("source", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.join(F.broadcast(splits), ["source", "block"]).select("source", (F.col("place") - F.col("first") + F.col("before") + 1).alias("line"), "value")
    return numbered.where(F.trim("value") != "")


def _unknown(value: Column, allowed: tuple[str, ...]) -> Column:
    """Not one JSON object of allowed keys only."""
    keys = F.json_object_keys(value)
    return F.try_parse_json(value).isNull() | keys.isNull() | (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))) > 0)


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(activity, label events, errors, tainted subjects) of an event log; a missing id becomes replay-line-<n>.

    Codes: bad_json, missing_field, bad_at, validate_failed, redact_failed, bad_label_event. A subject with a dropped
    activity row is tainted, as far as the broken line still tells it; label rows never taint.
    """
    links = ", ".join(f"{k}: string" for k in LINK_KINDS)
    schema = f"producer string, id string, subject string, type string, at string, links struct<{links}>, data string"
    lines = read_lines(spark, path)
    rows = lines.withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    broken = _unknown(F.col("value"), _EVENT_KEYS)
    rows = rows.select("source", "line", "value", broken.alias("broken"), "row.*")
    rows = rows.select("*", *[F.coalesce(F.col(f"links.{k}"), F.lit("")).alias(k) for k in LINK_KINDS]).drop("links")
    rows = rows.withColumns({"tenant": F.lit("eval"), "producer": F.coalesce("producer", F.lit("")), "id": F.coalesce(F.when(F.col("id") != "", F.col("id")), F.concat(F.lit("replay-line-"), "line"))})
    rows = rows.withColumn("instant", parse_rfc3339(F.col("at")))
    at = F.col("instant")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    first = F.when(F.col("broken"), "bad_json").when(blank("subject") | blank("type") | blank("at"), "missing_field").when(at.isNull(), "bad_at")
    is_label = F.coalesce(F.col("type") == "label", F.lit(False))
    value = F.get_json_object("data", "$.label")
    rows = rows.withColumns({"code": F.coalesce(first, F.when(is_label & (F.coalesce(value, F.lit("")) == ""), "bad_label_event")), "label": value, "received_ns": at["at_ns"], "backfill": F.lit(False)})
    labels = rows.where(is_label & F.col("code").isNull()).select("tenant", "producer", "id", "subject", "type", at["at"].alias("at"), at["at_ns"].alias("at_ns"), "label")
    # null values of data are absent in offline logs
    checked = prepare(rows.where(~is_label | F.col("code").isNotNull()), null_is_absent=True)
    late = F.when(F.col("reject_code").isin("redaction_failed", "too_large"), "redact_failed").when(F.col("reject_code").isNotNull(), "validate_failed")
    # stored once for all that is read off it
    checked = written(checked.withColumn("code", F.coalesce("code", late)), "checked")
    activity = checked.where("code is null").select("tenant", "producer", "id", "subject", "type", "at", "at_ns", *LINK_KINDS, *DATA_TYPES, F.lit(None).cast("string").alias("label"), "data", "body_hash", "redaction_version", "source", "line")
    bad = checked.where("code is not null")
    errors = bad.select("source", "line", "code")
    tainted = bad.where("code <> 'bad_label_event'").select(F.coalesce(F.get_json_object("value", "$.subject"), F.regexp_extract("value", r'"subject"\s*:\s*"([^"]+)"', 1)).alias("subject"), F.get_json_object("value", "$.type").alias("type"))
    tainted = tainted.where("subject <> '' and (type is null or type <> 'label')").select("subject").distinct()
    return activity, labels, errors, tainted


def read_labels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(labels, errors): subject, label and source are required; of a repeated subject the first good row counts."""
    rows = read_lines(spark, path).withColumn("row", F.from_json("value", "subject string, label string, category string, source string, decision_at map<string,string>"))
    blank = lambda c: F.coalesce(F.col(f"row.{c}"), F.lit("")) == ""
    rows = rows.withColumn("code", F.when(_unknown(F.col("value"), _LABEL_KEYS), "bad_json").when(blank("subject") | blank("label") | blank("source"), "missing_field"))
    n = F.row_number().over(Window.partitionBy("row.subject", F.col("code").isNull()).orderBy("source", "line"))
    rows = rows.withColumn("code", F.coalesce("code", F.when(n > 1, "duplicate_subject")))
    return rows.where("code is null").select(F.lit("eval").alias("tenant"), "row.*"), rows.where("code is not null").select("source", "line", "code")


def read_corpus(spark: SparkSession, path: str, renames: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(examples, errors) of a label-snapshot corpus; an id counts as seen even if its first row fails later."""
    schema = "feature_key_space string, id string, input struct<features: map<string,double>, text: map<string,array<string>>, context: string>, label string, split string, source string, meta string"
    rows = read_lines(spark, path).withColumn("row", F.from_json("value", schema))
    rows = rows.withColumns({"bad": _unknown(F.col("value"), _CORPUS_KEYS), "id": F.coalesce(F.col("row.id"), F.lit(""))})
    counted = F.col("bad") | (F.col("id") == "")
    n = F.row_number().over(Window.partitionBy("id", counted).orderBy("source", "line"))
    features, text = F.col("row.input.features"), F.col("row.input.text")
    empty = (F.coalesce(F.size(features), F.lit(0)) <= 0) & (F.coalesce(F.size(text), F.lit(0)) <= 0)
    code = (
        F.when(F.col("bad"), "bad_json")
        .when(F.col("id") == "", "missing_id")
        .when(n > 1, "duplicate_id")
        .when(F.coalesce(F.col("row.label"), F.lit("")) == "", "missing_label")
        .when(~F.coalesce(F.col("row.split"), F.lit("")).isin("", "train", "test"), "bad_split")
        .when(empty, "empty_input")
        .otherwise(F.coalesce(feature_key_code(features, renames or {}, ()), F.when(F.coalesce(F.col("row.feature_key_space"), F.lit("")) != KEY_SPACE, "feature_key_space")))
    )
    rows = rows.withColumn("code", code)
    good = rows.where("code is null").select("id", "row.label", F.coalesce("row.split", F.lit("")).alias("split"), "row.source", "row.meta", features.alias("features"), text.alias("text"), F.col("row.input.context").alias("context"))
    return good, rows.where("code is not null").select("source", "line", "code")


def skipped_by_code(errors: DataFrame, strict: bool = False) -> DataFrame:
    """(code, n); strict: fail on the first error instead."""
    if strict and (first := errors.orderBy("source", "line").first()) is not None:
        raise ValueError(f"{first['source']} line {first['line']}: {first['code']}")
    return errors.groupBy("code").agg(F.count("*").alias("n"))


def append_events(events: DataFrame, path: str, history: DataFrame | None = None) -> DataFrame:
    """Append accepted rows to the log, partitioned by tenant and day; returns every row's outcome."""
    judged = judge(events, history)
    accepted = judged.where("judged = 'accepted'").drop("judged").withColumn("day", F.to_date("at"))
    accepted.write.mode("append").partitionBy("tenant", "day").parquet(path)
    return judged.select("tenant", "producer", "id", F.col("judged").alias("outcome"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a verdict or label table; nothing is updated in place."""
    rows.write.mode("append").partitionBy("tenant").parquet(path)


def export_corpus(examples: DataFrame, labels: DataFrame, split: str = "all") -> DataFrame:
    """JSON lines of stored examples (example_id, label_id, subject, decision_ns, rule, gated, split, features, text)
    joined with their labels; refuses a foreign feature key space."""
    if not examples.where(F.col("feature_key_space") != KEY_SPACE).limit(1).isEmpty():
        raise ValueError("an example is of another feature key space")
    rows = examples.join(labels.select("tenant", "label_id", "label", F.col("source").alias("label_source")), ["tenant", "label_id"])
    if split != "all":
        rows = rows.where(F.col("split") == split)
    meta = F.struct("subject", F.col("decision_ns").alias("decision_at"), "rule", "gated")
    body = F.struct("feature_key_space", F.concat(F.lit("corpus_"), "example_id").alias("id"), F.struct("features", "text").alias("input"), "label", "split", F.col("label_source").alias("source"), meta.alias("meta"))
    return rows.select(F.to_json(body).alias("value"))


def dataset_hash(rows: DataFrame) -> str:
    """Order-independent content hash: sums of row digests, so nothing is gathered or sorted."""
    digest = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    parts = [F.sum(F.conv(F.substring(digest, k * 8 + 1, 8), 16, 10).cast("decimal(30,0)")).cast("string") for k in range(8)]
    got = rows.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *parts), 256).alias("h")).first()
    return got["h"]


def write_run(folder: str, manifest: DataFrame, verdicts: DataFrame, metrics: DataFrame, skipped: DataFrame) -> None:
    for name, df in (("manifest", manifest), ("verdicts", verdicts), ("metrics", metrics), ("skipped", skipped)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def score_files(spark: SparkSession, source: str, target: str, scorer) -> None:
    """Feature vectors in, risks out: JSON lines (id, features) through ``scorer`` (DataFrame -> DataFrame); any bad row
    fails before anything is written."""
    rows = read_lines(spark, source).withColumn("row", F.from_json("value", "id string, features map<string,double>"))
    bad = rows.where(_unknown(F.col("value"), ("id", "features")) | F.col("row.features").isNull())
    if (first := bad.first()) is not None:
        raise ValueError(f"{first['source']} line {first['line']}: bad_json")
    scorer(rows.select("row.*")).write.mode("errorifexists").json(target)


def read_brands(rows: DataFrame) -> DataFrame:
    """Union of brand lists (name, aliases, case_sensitive): one row per name, aliases merged."""
    return rows.groupBy("name").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"), F.max(F.coalesce("case_sensitive", F.lit(False))).alias("case_sensitive"))


def read_webmail(spark: SparkSession, path: str) -> DataFrame:
    """(domain): a list of webmail domains, one a line, blank lines and # comments left out; lower case, each once."""
    return spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("domain")).where("domain <> ''").distinct()

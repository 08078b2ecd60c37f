"""Ingest: structural checks, redaction to a typed allow-list, body hashes and idempotency.

Raw events: tenant, producer, id, subject, type, at (RFC 3339 text), the link columns, data (JSON text), received_ns,
backfill. Every check is a column expression, so a batch of any size is one narrow projection; only the idempotency
classes need a shuffle, on (tenant, producer, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import RFC3339, parse_rfc3339
from ..functions.text import CONTROL, EMAIL, mask_emails, nfkc, skeleton, truncate_utf8
from ..schema import DATA_FIELDS, DATA_TYPES, DAY_NS, FIELD_KIND, LINK_KINDS

MAX_DATA_BYTES = 8192
REDACTION_VERSION = 2
_HASHES = tuple(k for k in LINK_KINDS if k != "asn")
#: Closed formats (fixed values).
FORMATS = {"rfc3339": RFC3339, "recipient_hash": r"^[A-Za-z0-9_:+/=-]{8,128}$"}
_SPECS = {name: spec for fields in DATA_FIELDS.values() for name, spec in fields.items()}


def _of_type(field: str) -> Column:
    return F.col("type").isin(*[t for t, fields in DATA_FIELDS.items() if field in fields])


def _short(text: Column, most: int) -> Column:
    return text.isNotNull() & F.octet_length(text).between(1, most) & ~text.rlike(CONTROL)


def structural_code(now_ns: Column | None = None, instant: Column | None = None) -> Column:
    """First structural violation in the order id, subject, type, time, links; null if there is none.

    Times more than a day from ``now_ns`` (received_ns by default) are refused unless the row is a backfill.
    """
    now = F.col("received_ns") if now_ns is None else now_ns
    at = parse_rfc3339(F.col("at")) if instant is None else instant
    skew = F.abs(now - at["at_ns"]) > DAY_NS
    links = F.lit(True)
    for k in _HASHES:
        links = links & (F.coalesce(F.col(k), F.lit("")).rlike(r"^(?:[0-9a-f]{64})?$"))
    asn = F.coalesce(F.col("asn"), F.lit(""))
    links = links & (F.octet_length(asn) <= 32) & ~asn.rlike(r"[\s\p{Cc}]")
    no = F.lit(False)
    return (
        F.when(~F.coalesce(_short(F.col("id"), 64), no), "bad_id")
        .when(~F.coalesce(_short(F.col("subject"), 256), no), "bad_subject")
        .when(~F.coalesce(_short(F.col("type"), 64) & F.col("type").rlike(r"^[a-z_.]+$"), no), "bad_type")
        .when(~F.coalesce(at["utc"], no) | (F.coalesce(skew, no) & ~F.coalesce(F.col("backfill"), no)), "bad_timestamp")
        .when(~links, "bad_links")
    )


def with_leaks(parsed: DataFrame) -> DataFrame:
    """``__leak``: does any key or string of the JSON in ``__v`` hold a control character, or an e-mail address outside a sent
    subject line? Each form of the text is named before it is looked at, so it is made once."""
    line = F.to_json(F.try_variant_get("__v", "$.subject_line", "variant"))
    exempt = F.coalesce(F.replace("__plain", F.concat(F.lit('"subject_line":'), "__line"), F.lit('"subject_line":""')), F.col("__plain"))
    rows = parsed.withColumn("__plain", F.to_json("__v")).withColumn("__line", F.when(F.col("type") == "content.sent", line))
    rows = rows.withColumn("__scanned", F.when(F.col("type") == "content.sent", exempt).otherwise(F.col("__plain")))
    rows = rows.withColumn("__folded", nfkc(F.col("__scanned")))
    controls = F.regexp_replace("__plain", r"\\\\", "").rlike(r"\\(?:u00(?:[01][0-9a-f]|7f|[89][0-9a-f])|[bfnrt])") | F.col("__plain").rlike(CONTROL)
    found = controls | F.coalesce(F.col("__folded").rlike(EMAIL), F.lit(False))
    return rows.withColumn("__leak", F.col("__v").isNull() | F.coalesce(found, F.lit(False))).drop("__plain", "__line", "__scanned", "__folded")


def redact(raw: DataFrame, null_is_absent: bool = False) -> DataFrame:
    """Adds the data fields as typed columns, name and subject skeletons, ``data`` reduced to what is allowed (unknown
    types keep all of it), redaction_version, and ``reject_code`` (a structural one stays first).

    Each step names its columns before the next one uses them, so no expression is written out twice in the plan.
    """
    if "reject_code" not in raw.columns:
        raw = raw.withColumn("reject_code", F.lit(None).cast("string"))
    parsed = raw.withColumn("__v", F.try_parse_json(F.coalesce(F.col("data"), F.lit("{}"))))
    parsed = with_leaks(parsed)
    seen = {f"__t_{name}": F.when(_of_type(name), F.expr(f"schema_of_variant(variant_get(__v, '$.{name}', 'variant'))")) for name in _SPECS}
    typed = {name: F.when(_of_type(name), F.try_variant_get(F.col("__v"), f"$.{name}", DATA_TYPES[name].simpleString())) for name in _SPECS}
    out = parsed.withColumns(seen | typed)
    out = out.withColumns({name: mask_emails(F.col(name)) for name, spec in _SPECS.items() if spec.get("mask_email")})
    bad = F.col("__leak")
    for name, spec in _SPECS.items():
        found, value = F.col(f"__t_{name}"), F.col(name)
        if null_is_absent:
            found = F.nullif(found, F.lit("VOID"))
        shape = {"text": "^STRING$", "number": "^(?:BIGINT|DOUBLE|DECIMAL.*)$", "bool": "^BOOLEAN$"}[FIELD_KIND[name]]
        wrong = ~found.rlike(shape)
        if spec.get("format"):
            wrong = wrong | ~value.rlike(FORMATS[spec["format"]])
        if spec.get("enum"):
            wrong = wrong | ~value.isin(*spec["enum"])
        if spec.get("positive_integer"):
            wrong = wrong | (value <= 0) | (value != F.floor(value))
        bad = bad | F.coalesce(wrong, F.lit(False))
    crossed = (F.col("type") == "content.sent") & F.col("recipient_hash").isNotNull() & (F.col("recipient_count") > 1)
    out = out.withColumn("__bad", bad | F.coalesce(crossed, F.lit(False)))
    out = out.withColumns({name: truncate_utf8(F.col(name), spec["max"]) for name, spec in _SPECS.items() if spec.get("max")})
    skeletons = {f"{n}_skeleton": skeleton(F.col(n)) for n, s in _SPECS.items() if s.get("skeleton")}
    out = out.withColumns(skeletons)
    kept = F.to_json(F.struct(*sorted([*_SPECS, *skeletons])))
    out = out.withColumn("data", F.when(F.col("type").isin(*DATA_FIELDS), kept).otherwise(F.coalesce(F.col("data"), F.lit("{}"))))
    code = F.coalesce(F.col("reject_code"), F.when(F.col("__bad"), "redaction_failed"), F.when(F.octet_length("data") > MAX_DATA_BYTES, "too_large"))
    return out.withColumn("reject_code", code).withColumn("redaction_version", F.lit(REDACTION_VERSION)).drop("__v", "__leak", "__bad", *seen)


def body_hash() -> Column:
    """sha256 of what makes two events of one id the same: subject, type, instant, links and redacted data."""
    body = F.to_json(F.struct("subject", "type", F.col("at_ns"), *LINK_KINDS, "data"))
    return F.sha2(body, 256)


def prepare(raw: DataFrame, now_ns: Column | None = None, null_is_absent: bool = False) -> DataFrame:
    """Structural check, redaction, instant and body hash of raw events; ``reject_code`` is null for accepted rows."""
    raw = raw.withColumn("__at", parse_rfc3339(F.col("at")))
    checked = redact(raw.withColumn("reject_code", structural_code(now_ns, F.col("__at"))), null_is_absent)
    return checked.withColumns({"at_ns": F.col("__at.at_ns"), "at": F.col("__at.at")}).drop("__at").withColumn("body_hash", body_hash())


def classify(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Adds ``outcome``: accepted for the first row of a (tenant, producer, id), duplicate for the same body again,
    conflict for another. Earlier rows of ``history`` (with body_hash) come before all; order by received_ns, then seq."""
    key = ("tenant", "producer", "id")
    order = Window.partitionBy(*key).orderBy("__old", "received_ns", "seq")
    rows = events.withColumn("__old", F.lit(1))
    if history is not None:
        old = history.select(*key, "body_hash", F.lit(0).alias("__old"), F.lit(0).cast("long").alias("received_ns"), F.lit(0).cast("long").alias("seq"))
        rows = rows.unionByName(old, allowMissingColumns=True)
    first = F.first("body_hash").over(order)
    outcome = F.when(F.row_number().over(order) == 1, "accepted").when(F.col("body_hash") == first, "duplicate").otherwise("conflict")
    return rows.withColumn("outcome", outcome).where("__old = 1").drop("__old")


def judge(events: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """As ``classify``, with the class in ``judged``: a payment's own ``outcome`` stays."""
    kept = events.withColumnRenamed("outcome", "__own")
    return classify(kept, history).withColumnRenamed("outcome", "judged").withColumnRenamed("__own", "outcome")


def feature_key_code(features: Column, renames: dict[str, str], known: tuple[str, ...]) -> Column:
    """feature_renamed for an old flat key, invalid_feature_name for one outside the grammar, null if all keys are good."""
    keys = F.map_keys(features)
    good = lambda k: k.rlike(r"^[a-z][a-z0-9]*\.[a-z][a-z0-9_]{0,55}$") & ~k.endswith("__absent")
    old = F.exists(keys, lambda k: k.isin(*renames)) if renames else F.lit(False)
    return F.when(old, "feature_renamed").when(F.exists(keys, lambda k: ~good(k)), "invalid_feature_name")


def rename_features(rows: DataFrame, renames: dict[str, str], features: str = "features") -> DataFrame:
    """Old flat feature keys become their new names; raises if a flat key is unknown or two keys would meet."""
    table = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
    named = F.transform(F.map_keys(F.col(features)), lambda k: F.coalesce(table[k], k))
    checked = rows.withColumn("__keys", named)
    wrong = checked.where(F.exists("__keys", lambda k: ~k.contains(".")) | (F.size("__keys") != F.size(F.array_distinct("__keys")))).limit(1)
    if not wrong.isEmpty():
        raise ValueError("unknown flat feature key, or two keys with one new name")
    return checked.withColumn(features, F.map_from_arrays("__keys", F.map_values(features))).drop("__keys")


def label_code(rule_labels: Column) -> Column:
    """First fault of a label row (subject, label, source, actor, note, evidence); ``rule_labels``: array, null without a rule."""
    short = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit(""))) <= 500
    no = F.lit(False)
    return (
        F.when(~F.coalesce(F.col("source").isin("operator", "outcome"), no), "bad_source")
        .when(F.coalesce(F.col("actor"), F.lit("")) == "", "missing_actor")
        .when(~short("note") | ~short("evidence"), "too_long")
        .when(rule_labels.isNull() & ~F.coalesce(F.col("label").isin("benign", "abusive"), no), "bad_label")
        .when(rule_labels.isNotNull() & ~F.coalesce(F.array_contains(rule_labels, F.col("label")), no), "bad_label")
    )


def check_labels(labels: DataFrame, rules: DataFrame, subjects: DataFrame) -> DataFrame:
    """Labels with ``reject_code``; ``rules``: (rule, labels); a subject without events is refused."""
    joined = labels.join(F.broadcast(rules.select("rule", F.col("labels").alias("__labels"))), "rule", "left")
    known = subjects.select("tenant", "subject").distinct().withColumn("__known", F.lit(True))
    joined = joined.join(known, ["tenant", "subject"], "left")
    unknown = F.col("rule").isNotNull() & F.col("__labels").isNull()
    code = F.when(unknown, "unknown_rule").otherwise(F.coalesce(label_code(F.col("__labels")), F.when(F.col("__known").isNull(), "unknown_subject")))
    return joined.withColumn("reject_code", code).drop("__labels", "__known")

"""The driver's tables as an account-risk event log: one fixed mapping, so that every operator runs on real rows.

signup -> subject.created, purchase -> payment.attempt, view -> content.sent, click -> resource.created; error becomes a
permanent deletion, a label or a paid subscription by the number in ``props``. Link hashes come from user ids, and every
second user shares one device, a hub. Names, subject lines and webmail domains come from the number, too; with ``texts``
names and subject lines are the whole text of a document picked by event id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENTS


#: Names and subject lines by the last digits of the number (k % 10, k % 9); the others are plain.
NAMES = {0: "PayPal login", 1: "mail@box desk", 2: "Amazon webhook", 3: "Netflix sync 7"}
LINES = {0: "Your PayPal invoice", 1: "Netflix fan club", 2: "DHL and UPS parcel", 3: "your ups and downs", 4: "Netflix premiere"}
WEBMAIL_DOMAINS = {0: "gmail.com", 1: " Web.DE"}


def _by_number(k: Column, texts: dict[int, str], other: Column) -> Column:
    out = other
    for number, text in texts.items():
        out = F.when(k == number, text).otherwise(out)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped_events(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """The mapped log. ``texts``: with names and subject lines, which takes a join with the documents."""
    e = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    e = e.withColumns({"k": k, "u": F.col("user_id")})
    error = F.col("event_type") == "error"
    kind = (
        F.when(F.col("event_type") == "signup", "subject.created")
        .when(F.col("event_type") == "purchase", "payment.attempt")
        .when(F.col("event_type") == "view", "content.sent")
        .when(F.col("event_type") == "click", "resource.created")
        .when(error & (F.col("k") < 3), "subject.deleted")
        .when(error & (F.col("k") < 6), "label")
        .otherwise("subscription.changed")
    )
    e = e.withColumn("type", kind)
    of = lambda t, v: F.when(F.col("type") == t, v)
    values = {
        "tenant": F.lit("t"),
        "producer": F.lit(""),
        "id": F.col("event_id").cast("string"),
        "subject": F.col("u").cast("string"),
        "type": F.col("type"),
        "at": F.col("ts").cast("timestamp"),
        "at_ns": F.unix_micros(F.col("ts").cast("timestamp")) * 1000,
        "email_hash": F.sha2(F.concat(F.lit("e"), (F.col("u") % 40).cast("string")), 256),
        "card_fingerprint_hash": F.sha2(F.concat(F.lit("c"), (F.col("u") % 25).cast("string")), 256),
        "device_hash": F.when(F.col("u") % 2 == 0, F.sha2(F.lit("d"), 256)),
        "mode": of("subject.deleted", F.lit("permanent")),
        "outcome": of("payment.attempt", F.when(F.col("k") % 4 == 0, "declined").otherwise("succeeded")),
        "funding": of("payment.attempt", F.when(F.col("k") % 3 == 0, "prepaid").otherwise("credit")),
        "amount_minor": F.when(F.col("type").isin("payment.attempt", "subscription.changed"), F.col("value")),
        "status": of("subscription.changed", F.lit("active")),
        "kind": of("resource.created", F.when(F.col("k") % 2 == 0, "key").otherwise("agent")),
        "recipient_domain": of("content.sent", _by_number(F.col("k") % 23, WEBMAIL_DOMAINS, F.concat(F.lit("d"), (F.col("k") % 23).cast("string")))),
        "name": of("resource.created", _by_number(F.col("k") % 10, NAMES, F.lit("plain name"))),
        "subject_line": of("content.sent", _by_number(F.col("k") % 9, LINES, F.lit("weekly notes"))),
        "recipient_count": of("content.sent", (1 + F.col("k") % 5).cast("double")),
        "recipient_is_own_identity": of("content.sent", F.col("k") % 7 == 0),
        "recipient_hash": of("content.sent", F.when(F.col("k") % 2 == 0, F.concat(F.lit("hash-"), (F.col("k") % 11).cast("string")))),
        "label": of("label", F.lit("abusive")),
    }
    out = e.select("event_id", *[v.alias(c) for c, v in values.items()])
    if texts:
        docs = read_table(spark, sf_dir, "documents")
        heads = docs.select(F.col("doc_id").alias("__doc"), F.col("text").alias("head"))
        n = docs.agg(F.max("doc_id") + 1).first()[0] or 1
        out = out.join(heads, F.col("event_id") % n == F.col("__doc"), "left")
        out = out.withColumns({"name": F.when(F.col("type") == "resource.created", F.col("head")), "subject_line": F.when(F.col("type") == "content.sent", F.col("head"))})
    missing = {f.name: F.lit(None).cast(f.dataType) for f in EVENTS if f.name not in out.columns}
    return out.withColumns(missing).select(*[f.name for f in EVENTS])


#: The same mapping in SQL, as the common table ``ev``.
EVENTS_SQL = r"""
raw AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k, user_id AS u FROM events),
typed AS (SELECT *, CASE event_type WHEN 'signup' THEN 'subject.created' WHEN 'purchase' THEN 'payment.attempt' WHEN 'view' THEN 'content.sent' WHEN 'click' THEN 'resource.created'
  ELSE CASE WHEN k < 3 THEN 'subject.deleted' WHEN k < 6 THEN 'label' ELSE 'subscription.changed' END END AS type FROM raw),
ev AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(u AS VARCHAR) AS subject, type, epoch_us(ts) * 1000 AS at_ns, k,
  sha256('e' || (u % 40)) AS email_hash, sha256('c' || (u % 25)) AS card_fingerprint_hash, CASE WHEN u % 2 = 0 THEN sha256('d') END AS device_hash,
  CASE WHEN type = 'payment.attempt' THEN CASE WHEN k % 4 = 0 THEN 'declined' ELSE 'succeeded' END END AS outcome,
  CASE WHEN type = 'payment.attempt' THEN CASE WHEN k % 3 = 0 THEN 'prepaid' ELSE 'credit' END END AS funding,
  CASE WHEN type IN ('payment.attempt', 'subscription.changed') THEN value END AS amount_minor,
  CASE WHEN type = 'resource.created' THEN CASE WHEN k % 2 = 0 THEN 'key' ELSE 'agent' END END AS kind,
  CASE WHEN type = 'content.sent' THEN CASE k % 23 WHEN 0 THEN 'gmail.com' WHEN 1 THEN ' Web.DE' ELSE 'd' || (k % 23) END END AS recipient_domain,
  CASE WHEN type = 'content.sent' THEN 1 + k % 5 END AS n,
  CASE WHEN type = 'content.sent' THEN k % 7 = 0 END AS own,
  CASE WHEN type = 'content.sent' AND k % 2 = 0 THEN 'hash-' || (k % 11) END AS recipient_hash
FROM typed)"""

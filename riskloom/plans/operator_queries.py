"""Registered queries over single operators: sources and sinks, redaction, texts, scoring steps, runs, replay and streams.

Queries that read or write files make them from the tables in the shared folder and read them back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalar import floor_div
from ..functions.text import COMMUNITY_PHRASES, INTEGRATION_WORDS, camel, match_brands, nfkc, skeleton, tokenise
from ..operators import graph, ingest, metrics, replay, scoring, subjects
from ..operators import links as link_ops
from ..operators.features import features
from ..operators.sweep import features_by_sweep
from ..schema import DAY_NS, FEATURES, HOUR_NS, LINK_KINDS, LOCAL_WEIGHTS, Rule, column
from ..sources import jsonl
from ..sources.mapped import EVENTS_SQL, mapped_events, read_table
from ..sources.shared import new_path, written
from ..streaming import jobs, stateful
from .queries import ALL_KINDS, TEST_BRANDS, _ACTIVITY, _LATEST, _METRICS, _RECORDS, _ROUNDED, _VERDICTS, _evidence_sql, _features_sql, _logit_sql, _neighbour_sql, _raw_events, _records, _shown, _slices, _touch_sql, _verdicts
from .registry import query
from .risk import risk_of_points, risk_of_replay

SECRET = b"k"


def _counted(part: str, rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "key", "n")


def _hmac_sql(text: str) -> str:
    inner, outer = (bytes((SECRET[0] ^ pad, *[pad] * 63)).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def _split_sql(digest: str) -> str:
    return f"CASE WHEN CAST('0x' || substr({digest}, 1, 16) AS UBIGINT) % 100 < 80 THEN 'train' ELSE 'test' END"


# --- redaction and checks ------------------------------------------------------------------------------------------

_RAW_SQL = r"""e AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events),
c AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'payment.attempt' WHEN event_type = 'view' THEN 'content.sent' ELSE 'custom.kind' END AS type,
  CASE WHEN k = 1 THEN 'bad_id' WHEN k = 2 THEN 'bad_subject' WHEN k = 3 THEN 'bad_type' WHEN k IN (4, 6) THEN 'bad_timestamp' WHEN k = 5 THEN 'bad_links'
  WHEN event_type = 'purchase' AND k BETWEEN 50 AND 59 THEN 'redaction_failed' WHEN event_type = 'view' AND k >= 90 AND k % 4 <> 0 THEN 'redaction_failed'
  WHEN event_type NOT IN ('purchase', 'view') AND k < 20 THEN 'redaction_failed' END AS code FROM e),
d AS (SELECT *, CASE WHEN k >= 90 THEN k / 4 ELSE CAST(k + 1 AS DOUBLE) END AS n, CASE WHEN k < 30 THEN 'Hello @ ok' ELSE 'Hello you ok' END AS line,
  CASE WHEN k < 30 THEN 'hello a ok' ELSE 'hello you ok' END AS skel FROM c),
r AS (SELECT *, CASE WHEN type = 'payment.attempt' AND k < 50 THEN '{"amount_minor":' || value || ',"outcome":"succeeded"}' WHEN type = 'payment.attempt' THEN '{"outcome":"declined"}'
  WHEN type = 'content.sent' THEN '{"recipient_count":' || n || ',"subject_line":"' || line || '","subject_line_skeleton":"' || skel || '"}' ELSE '{"note":"plain"}' END AS data FROM d)"""


@query(
    f"""WITH {_RAW_SQL} SELECT event_id, code AS reject_code, CASE WHEN code IS NULL THEN data END AS data, CASE WHEN code IS NULL AND type = 'payment.attempt' AND k < 50 THEN value END AS amount_minor,
  CASE WHEN code IS NULL AND type = 'content.sent' THEN line END AS subject_line, CASE WHEN code IS NULL AND type = 'content.sent' THEN skel END AS subject_line_skeleton, 2 AS redaction_version,
  CASE WHEN code IS NULL THEN sha256('{{"subject":"' || user_id || '","type":"' || type || '","at_ns":' || (epoch_us(ts) * 1000) || '{''.join(f',"{c}":""' for c in LINK_KINDS[1:])},"data":' || to_json(data) || '}}') END AS body_hash FROM r"""
)
def redacted_events(spark, sf_dir):
    """What redaction leaves of each event, and the hash of its body."""
    rows = ingest.prepare(_raw_events(spark, sf_dir))
    good = F.col("reject_code").isNull()
    shown = {c: F.when(good, F.col(c)) for c in ("data", "amount_minor", "subject_line", "subject_line_skeleton", "body_hash")}
    return rows.select("event_id", "reject_code", *[v.alias(c) for c, v in shown.items()], "redaction_version")


@query(
    r"""WITH t AS (SELECT *, repeat('aé', 150) AS long FROM documents), b AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'subject.created' WHEN 1 THEN 'content.sent' WHEN 2 THEN 'subject.deleted' WHEN 3 THEN 'subject.class' WHEN 4 THEN 'resource.created' ELSE 'free.form' END AS type, doc_id % 4 AS v, n_chars FROM documents)
SELECT doc_id, CASE WHEN type = 'subject.created' AND v = 0 THEN 'redaction_failed' WHEN type = 'content.sent' AND v IN (1, 3) THEN 'redaction_failed' WHEN type = 'subject.deleted' AND v = 2 THEN 'redaction_failed' WHEN type = 'subject.class' AND v = 1 THEN 'redaction_failed'
  WHEN type = 'free.form' AND n_chars > 8170 THEN 'too_large' END AS reject_code, CASE WHEN type = 'resource.created' THEN 199 END AS name_bytes FROM b"""
)
def field_rules(spark, sf_dir):
    """Closed formats, enumerations, cross-field rules, nulls as absent, truncation and the size cap."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 6).alias("t"), (F.col("doc_id") % 4).alias("v"), "n_chars")
    v = F.col("v")
    at = F.when(v == 0, "last week").otherwise("2024-01-01T00:00:00.5Z")
    sent = F.when(v == 1, '{"recipient_hash":"no","recipient_count":1}').when(v == 3, '{"recipient_hash":"0123456789","recipient_count":2}').otherwise('{"recipient_hash":null,"recipient_count":2}')
    data = (
        F.when(F.col("t") == 0, F.concat(F.lit('{"account_created_at":"'), at, F.lit('","other":1}')))
        .when(F.col("t") == 1, sent)
        .when(F.col("t") == 2, F.when(v == 2, '{"mode":"gone"}').otherwise('{"mode":"trash"}'))
        .when(F.col("t") == 3, F.when(v == 1, '{"class":"other"}').otherwise('{"class":"customer"}'))
        .when(F.col("t") == 4, F.concat(F.lit('{"name":"'), F.repeat(F.lit("aé"), 150), F.lit('"}')))
        .otherwise(F.concat(F.lit('{"free_text_field":"'), F.repeat(F.lit("x"), F.col("n_chars").cast("int")), F.lit('"}')))
    )
    names = ("subject.created", "content.sent", "subject.deleted", "subject.class", "resource.created", "free.form")
    kind = F.get(F.array(*[F.lit(n) for n in names]), F.col("t").cast("int"))
    rows = ingest.redact(docs.select("doc_id", kind.alias("type"), data.alias("data")), null_is_absent=True)
    return rows.select("doc_id", "reject_code", F.when(F.col("type") == "resource.created", F.octet_length("name")).alias("name_bytes"))


@query(
    """SELECT CAST(l.doc_id AS VARCHAR) AS subject, CASE WHEN l.doc_id % 4 = 2 THEN 'unknown_rule' WHEN l.doc_id % 6 = 0 THEN 'bad_source' WHEN l.doc_id % 7 = 0 THEN 'missing_actor' WHEN l.doc_id % 11 = 0 THEN 'too_long'
  WHEN l.doc_id % 4 = 0 AND l.doc_id % 5 > 1 THEN 'bad_label' WHEN l.doc_id % 4 IN (1, 3) AND l.doc_id % 5 NOT IN (2, 3) THEN 'bad_label' WHEN d.doc_id IS NULL THEN 'unknown_subject' END AS reject_code
FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 300) d ON d.doc_id = l.doc_id"""
)
def checked_labels(spark, sf_dir):
    k = F.col("doc_id")
    names = F.array(*[F.lit(x) for x in ("benign", "abusive", "low", "high", "other")])
    rows = read_table(spark, sf_dir, "labels").select(
        F.lit("t").alias("tenant"), k.cast("string").alias("subject"), F.when(k % 4 == 2, "nosuch").when(k % 4 != 0, "quality").alias("rule"), F.get(names, (k % 5).cast("int")).alias("label"),
        F.when(k % 6 == 0, "guess").otherwise("operator").alias("source"), F.when(k % 7 == 0, "").otherwise("me").alias("actor"), F.when(k % 11 == 0, F.repeat(F.lit("x"), 501)).otherwise("").alias("note"), F.lit("").alias("evidence"),
    )
    rules = spark.createDataFrame([("quality", ["low", "high"])], "rule string, labels array<string>")
    known = read_table(spark, sf_dir, "documents").where("n_chars > 300").select(F.lit("t").alias("tenant"), k.cast("string").alias("subject"))
    return ingest.check_labels(rows, rules, known).select("subject", "reject_code")


@query(f"WITH s AS (SELECT CAST(c_custkey AS VARCHAR) AS subject, c_mktsegment AS label, {_split_sql(_hmac_sql('CAST(c_custkey AS VARCHAR)'))} AS split FROM customer) SELECT subject, label, split, label NOT IN ('BUILDING', 'MACHINERY') AS odd FROM s WHERE split = 'test'")
def keyed_split(spark, sf_dir):
    """The test split by a keyed hash of the subject, and its labels outside the vocabulary."""
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject"), F.col("c_mktsegment").alias("label"))
    rows = metrics.filter_split(rows.withColumn("split", replay.subject_split(F.col("subject"), SECRET)), "test")
    odd = metrics.bad_labels(rows, ("BUILDING", "MACHINERY")).select("subject", F.lit(True).alias("odd"))
    return rows.join(odd, "subject", "left").withColumn("odd", F.coalesce("odd", F.lit(False)))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'feature_renamed' WHEN 2 THEN 'invalid_feature_name' WHEN 3 THEN 'invalid_feature_name' END AS code, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'core.bal' WHEN c_custkey % 5 = 4 THEN 'core.x_1' END AS renamed, c_acctbal AS value FROM customer")
def feature_keys(spark, sf_dir):
    """The grammar of feature keys, and the migration of old flat ones."""
    k = F.col("c_custkey") % 5
    key = F.when(k == 0, "old_bal").when(k == 1, "core.bal").when(k == 2, "Core.bal").when(k == 3, "core.x__absent").otherwise("core.x_1")
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", F.create_map(key, F.col("c_acctbal")).alias("features"))
    rows = rows.withColumn("code", ingest.feature_key_code(F.col("features"), {"old_bal": "core.bal"}, FEATURES))
    renamed = ingest.rename_features(rows, {"old_bal": "core.bal"})
    name = F.get(F.map_keys("features"), F.lit(0))
    return renamed.select("c_custkey", "code", F.when(F.coalesce(F.col("code"), F.lit("")) != "invalid_feature_name", name).alias("renamed"), F.get(F.map_values("features"), F.lit(0)).alias("value"))


# --- texts ---------------------------------------------------------------------------------------------------------

_FOLDED = "lower(translate(strip_accents(nfc_normalize({0})), 'Iı', 'll'))"
#: Digits are blanked first, so that no digit stands for a letter.
_SKELETON_SQL = "trim(regexp_replace(translate(" + _FOLDED.format("regexp_replace({0}, '[0-9]', ' ', 'g')") + ", '$@', 'sa'), '\\s+', ' ', 'g'))"


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, "[0-9]", " ")


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS nfkc_sha256 FROM documents")
def nfkc_texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(nfkc(F.col("text")), 256).alias("nfkc_sha256"))


@query(f"SELECT doc_id, sha256({_SKELETON_SQL.format('text')}) AS skeleton_sha256 FROM documents")
def skeleton_texts(spark, sf_dir):
    """Skeletons of the texts with their digits blanked."""
    return read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(skeleton(_blank(F.col("text"))), 256).alias("skeleton_sha256"))


_TOKENS_SQL = "list_filter(string_split_regex(replace({0}, 'i', 'l'), '[\\s\\p{{P}}\\p{{S}}]+'), lambda x: x <> '')"
_CAMEL_SQL = "regexp_replace({0}, '([\\p{{Ll}}\\p{{Nd}}])(\\p{{Lu}})', '\\1 \\2', 'g')"


@query(f"SELECT doc_id, len({_TOKENS_SQL.format(_SKELETON_SQL.format('text'))}) AS n_tokens, sha256(array_to_string({_TOKENS_SQL.format(_SKELETON_SQL.format('text'))}, ' ')) AS tokens_sha256, len({_TOKENS_SQL.format(_SKELETON_SQL.format(_CAMEL_SQL.format('text')))}) AS n_split FROM documents")
def token_texts(spark, sf_dir):
    """Canonical words of the texts, as they stand and with camel-case borders as spaces."""
    words, split = tokenise(skeleton(_blank(F.col("text")))), tokenise(skeleton(_blank(camel(F.col("text")))))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("tokens_sha256"), F.size(split).cast("long").alias("n_split"))


_GATES = ", ".join("'" + w.replace("i", "l") + "'" for w in INTEGRATION_WORDS)
_SOCIAL = " OR ".join("contains(line, ' " + p.replace("i", "l") + " ')" for p in COMMUNITY_PHRASES)
_BLANKED = "regexp_replace(text, '[0-9]', ' ', 'g')"


@query(
    rf"""WITH l AS (SELECT DISTINCT unnest(string_split({_BLANKED}, chr(10))) AS text FROM documents),
r AS (SELECT text, string_split_regex(nfc_normalize(text), '[\s\p{{P}}\p{{S}}]+') AS orig, {_TOKENS_SQL.format(_SKELETON_SQL.format('text'))} AS p, {_TOKENS_SQL.format(_SKELETON_SQL.format(_CAMEL_SQL.format('text')))} AS c FROM l),
t AS (SELECT text, orig, unnest([p, c]) AS t FROM r), g AS (SELECT text, orig, list_has_any(t, [{_GATES}]) AS gated, ' ' || array_to_string(t, ' ') || ' ' AS line FROM t), s AS (SELECT *, {_SOCIAL} AS social FROM g),
b AS (SELECT * FROM (VALUES ('The', 'the', NULL), ('And', 'and', NULL), ('And', 'und', NULL), ('In The', 'ln the', NULL), ('La', 'la', 'La'), ('De', 'de', NULL)) v(brand, words, exact)),
h AS (SELECT s.text, b.brand, bool_or(NOT gated) AS named, bool_or(NOT social) AS subject FROM s JOIN b ON contains(s.line, ' ' || b.words || ' ') AND (b.exact IS NULL OR list_contains(s.orig, b.exact)) GROUP BY ALL),
o AS (SELECT text, coalesce(string_agg(brand, ',' ORDER BY brand) FILTER (named), '') AS name_brands, coalesce(string_agg(brand, ',' ORDER BY brand) FILTER (subject), '') AS subject_brands FROM h GROUP BY text)
SELECT sha256(r.text) AS line, coalesce(o.name_brands, '') AS name_brands, coalesce(o.subject_brands, '') AS subject_brands, list_has_any(r.p, [{_GATES}]) AS has_integration FROM r LEFT JOIN o ON o.text = r.text"""
)
def brand_lines(spark, sf_dir):
    """Brands of common words in all lines, digits blanked."""
    lines = read_table(spark, sf_dir, "documents").select(F.explode(F.split(_blank(F.col("text")), "\n")).alias("text"))
    got = match_brands(lines, TEST_BRANDS)
    return got.select(F.sha2("text", 256).alias("line"), F.array_join("name_brands", ",").alias("name_brands"), F.array_join("subject_brands", ",").alias("subject_brands"), "has_integration")


@query(f"WITH {EVENTS_SQL}, x AS (SELECT subject, at_ns, id, CASE k % 10 WHEN 0 THEN 'paypal login' WHEN 1 THEN 'mailabox desk' WHEN 2 THEN 'amazon webhook' WHEN 3 THEN 'netflix sync 7' ELSE 'plain name' END AS v FROM ev WHERE type = 'resource.created') SELECT subject, count(*) AS n_names, array_to_string(list(v ORDER BY at_ns, id), '|') AS names FROM x GROUP BY subject")
def collected_names(spark, sf_dir):
    texts = replay.collect_texts(mapped_events(spark, sf_dir).where("type <> 'label'"), ("tenant", "subject"))
    names = F.element_at("text", "name_skeleton")
    return texts.where(names.isNotNull()).select("subject", F.size(names).cast("long").alias("n_names"), F.array_join(names, "|").alias("names"))


# --- sources and sinks ---------------------------------------------------------------------------------------------


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log as JSON lines, with a fault for some numbers."""
    e = read_table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    at = F.when(k == 9, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    label = (F.col("event_type") == "error") & (k < 50)
    kind = F.when(label, "label").when(F.col("event_type") == "purchase", "payment.attempt").otherwise("custom.kind")
    data = F.when(label, F.when(k % 10 == 0, "{}").otherwise('{"label":"abusive"}')).when(F.col("event_type") == "purchase", F.when(k == 11, '{"outcome":"perhaps"}').otherwise('{"outcome":"succeeded","reason":null}')).otherwise('{"note":"plain"}')
    subject = F.col("user_id").cast("string")
    body = F.concat(F.when(k == 10, "").otherwise(F.concat(F.lit('"id":"'), F.col("event_id").cast("string"), F.lit('",'))), F.lit('"subject":"'), subject, F.lit('","type":"'), kind, F.lit('","at":"'), at, F.lit('","data":'), data)
    return e.select(F.when(k == 7, F.concat(F.lit('{"subject":"'), subject, F.lit('", broken'))).when(k == 8, F.concat(F.lit("{"), body, F.lit(',"odd":1}'))).when(k == 12, "   ").otherwise(F.concat(F.lit("{"), body, F.lit("}"))).alias("value"))


@query(
    r"""WITH e AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k, CAST(user_id AS VARCHAR) AS u FROM events), t AS (SELECT *, event_type = 'error' AND k < 50 AS is_label, CASE WHEN event_type = 'purchase' THEN 'payment.attempt' ELSE 'custom.kind' END AS type FROM e WHERE k <> 12),
c AS (SELECT *, CASE WHEN k IN (7, 8) THEN 'bad_json' WHEN k = 9 THEN 'bad_at' WHEN is_label AND k % 10 = 0 THEN 'bad_label_event' WHEN event_type = 'purchase' AND k = 11 THEN 'redact_failed' END AS code FROM t)
SELECT 'activity' AS part, type || CASE WHEN k = 10 THEN ' replay' ELSE '' END AS key, count(*) AS n FROM c WHERE code IS NULL AND NOT is_label GROUP BY ALL UNION ALL SELECT 'label', 'abusive', count(*) FROM c WHERE code IS NULL AND is_label HAVING count(*) > 0
UNION ALL SELECT 'error', code, count(*) FROM c WHERE code IS NOT NULL GROUP BY code UNION ALL SELECT DISTINCT 'tainted', u, 1 FROM c WHERE code IS NOT NULL AND code <> 'bad_label_event' AND (k = 7 OR NOT is_label)"""
)
def event_log_file(spark, sf_dir):
    """An event log written as JSON lines and read again: activity, labels, errors by code, tainted subjects."""
    path = new_path(spark, "log")
    _log_lines(spark, sf_dir).write.text(path)
    activity, labels, errors, tainted = jsonl.read_events(spark, path)
    kind = F.concat("type", F.when(F.col("id").startswith("replay-line-"), " replay").otherwise(""))
    skipped = jsonl.skipped_by_code(errors).select(F.lit("error").alias("part"), F.col("code").alias("key"), "n")
    return _counted("activity", activity, kind).unionByName(_counted("label", labels, F.col("label"))).unionByName(skipped).unionByName(_counted("tainted", tainted, F.col("subject")))


@query("WITH l AS (SELECT *, doc_id // 2 AS s, CASE WHEN doc_id % 9 = 0 THEN 'bad_json' WHEN doc_id % 7 = 0 THEN 'missing_field' END AS code FROM labels), g AS (SELECT s, count(*) FILTER (code IS NULL) AS good FROM l GROUP BY s) SELECT 'good' AS part, 's' || s AS key, CAST(1 AS BIGINT) AS n FROM g WHERE good > 0 UNION ALL SELECT 'error', code, count(*) FROM l WHERE code IS NOT NULL GROUP BY code UNION ALL SELECT 'error', 'duplicate_subject', sum(good - 1) FROM g WHERE good > 1 HAVING count(*) > 0")
def label_file(spark, sf_dir):
    """Labels written as JSON lines, two to a subject, and read again: the first good one of a subject counts."""
    k = F.col("doc_id")
    body = F.concat(F.lit('{"subject":"s'), F.floor(k / 2).cast("string"), F.lit('","label":"'), F.when(k % 7 == 0, "").otherwise("x"), F.lit('","source":"q"'), F.when(k % 9 == 0, ',"odd":1').otherwise(""), F.lit("}"))
    path = new_path(spark, "labels")
    read_table(spark, sf_dir, "labels").select(body.alias("value")).write.text(path)
    good, errors = jsonl.read_labels(spark, path)
    return _counted("good", good, F.col("subject")).unionByName(_counted("error", errors, F.col("code")))


_EXAMPLES = "lab AS (SELECT l.subject, l.id AS point, coalesce((SELECT min(at_ns) FROM ev s WHERE s.subject = l.subject AND s.type = 'content.sent'), l.at_ns) AS now_ns FROM ev l WHERE l.type = 'label'), ex AS (SELECT *, now_ns + 1 AS cutoff_ns FROM lab)"


@query(f"WITH {EVENTS_SQL}, {_EXAMPLES},{_features_sql('ex', False)} SELECT 'corpus_' || ex.point AS id, 'abusive' AS label, {_split_sql(_hmac_sql('ex.subject'))} AS split, coalesce(core__resource_total, 0) AS resources, round(coalesce(core__subject_age_h, 0), 9) AS age, (SELECT count(*) FROM ev e WHERE e.subject = ex.subject AND e.type = 'resource.created' AND e.at_ns <= ex.now_ns) AS n_names FROM ex LEFT JOIN feat ON feat.subject = ex.subject AND feat.point = ex.point")
def corpus_file(spark, sf_dir):
    """Snapshots of all labels, exported as JSON lines and read again."""
    events = mapped_events(spark, sf_dir)
    marks = events.where("type = 'label'").select("tenant", "subject", F.col("id").alias("label_id"), "label", F.col("at_ns").alias("labelled_ns"), F.lit("rule0").alias("rule"))
    examples = replay.corpus_snapshot(marks, events, SECRET)
    stored = examples.drop("label", "slice").withColumns({"example_id": F.col("label_id"), "feature_key_space": F.lit(jsonl.KEY_SPACE)})
    path = new_path(spark, "corpus")
    jsonl.export_corpus(stored, marks.withColumn("source", F.lit("operator"))).write.text(path)
    good, _ = jsonl.read_corpus(spark, path)
    value = lambda f: F.coalesce(F.element_at("features", f), F.lit(0.0))
    return good.select("id", "label", "split", value("core.resource_total").alias("resources"), F.round(value("core.subject_age_h"), 9).alias("age"), F.coalesce(F.size(F.element_at("text", "name_skeleton")), F.lit(0)).cast("long").alias("n_names"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, round(1 / (1 + exp(-(c_acctbal / 5000.0 - 1))), 9) AS risk FROM customer")
def score_file(spark, sf_dir):
    """Feature vectors as JSON lines in, risks as JSON lines out."""
    source, target = new_path(spark, "vectors"), new_path(spark, "risks")
    rows = read_table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.create_map(F.lit("core.bal"), F.col("c_acctbal").cast("double")).alias("features"))).alias("value"))
    rows.write.text(source)
    jsonl.score_files(spark, source, target, lambda df: df.select("id", F.round(scoring.sigmoid(F.element_at("features", "core.bal") / 5000.0 - 1), 9).alias("risk")))
    return spark.read.schema("id string, risk double").json(target)


@query("SELECT 'brand' AS part, n_name AS key, 1 + CAST(n_regionkey < 2 AS INT) AS n FROM nation UNION ALL SELECT DISTINCT 'webmail', lower(r_name) || '.org', 1 FROM region")
def reference_lists(spark, sf_dir):
    """Two brand lists made one, and a list of webmail domains with comments, blank lines and repeats."""
    n = read_table(spark, sf_dir, "nation")
    first = n.select(F.col("n_name").alias("name"), F.array(F.lower("n_name")).alias("aliases"), F.lit(False).alias("case_sensitive"))
    second = n.where("n_regionkey < 2").select(F.col("n_name").alias("name"), F.array(F.lower("n_name"), F.concat("n_name", F.lit("!"))).alias("aliases"), F.lit(None).cast("boolean").alias("case_sensitive"))
    brands = jsonl.read_brands(first.unionByName(second)).select(F.lit("brand").alias("part"), F.col("name").alias("key"), F.size("aliases").alias("n"))
    path = new_path(spark, "webmail")
    read_table(spark, sf_dir, "region").select(F.explode(F.array(F.concat(F.lit(" "), F.col("r_name"), F.lit(".org # as listed")), F.concat(F.lower("r_name"), F.lit(".org")), F.lit(""), F.lit("# end"))).alias("value")).write.text(path)
    return brands.unionByName(jsonl.read_webmail(spark, path).select(F.lit("webmail").alias("part"), F.col("domain").alias("key"), F.lit(1).alias("n")))


@query(
    f"""WITH {EVENTS_SQL}, {_VERDICTS}, o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f FROM orders)
SELECT 'outcome' AS part, CASE WHEN r = 1 THEN 'accepted' WHEN o_orderstatus = f THEN 'duplicate' ELSE 'conflict' END AS key, count(*) AS n FROM o GROUP BY ALL UNION ALL SELECT 'log', strftime(o_orderdate, '%Y-%m'), count(*) FROM o WHERE r = 1 GROUP BY ALL
UNION ALL SELECT 'verdict', rule, 2 * count(*) FROM verdicts GROUP BY rule"""
)
def append_sinks(spark, sf_dir):
    """Events appended with an outcome each, and verdicts appended twice as new rows."""
    rows = read_table(spark, sf_dir, "orders").select(
        F.lit("t").alias("tenant"), F.lit("").alias("producer"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("body_hash"), F.col("o_orderkey").cast("long").alias("received_ns"), F.lit(0).alias("seq"), F.trunc("o_orderdate", "month").cast("timestamp").alias("at"),
    )
    log, table = new_path(spark, "events"), new_path(spark, "verdicts")
    judged = jsonl.append_events(rows, log)
    verdicts = _verdicts(mapped_events(spark, sf_dir))
    for _ in range(2):
        jsonl.append_rows(verdicts, table)
    out = _counted("outcome", judged, F.col("outcome")).unionByName(_counted("log", spark.read.parquet(log), F.date_format("day", "yyyy-MM")))
    return out.unionByName(_counted("verdict", spark.read.parquet(table), F.col("rule")))


@query(f"WITH {_RECORDS} SELECT 'manifest' AS part, 1 AS n UNION ALL SELECT 'verdicts', count(*) FROM rec UNION ALL SELECT 'metrics', 2 FROM rec HAVING count(*) > 0 UNION ALL SELECT 'skipped', count(*) FROM rec WHERE error_code IS NOT NULL")
def run_files(spark, sf_dir):
    """The four tables of a run, written and read again."""
    records = _records(spark, sf_dir)
    folder = new_path(spark, "run")
    manifest = spark.range(1).select(F.lit(scoring.weights_version(LOCAL_WEIGHTS)).alias("weights"), F.lit("full").alias("slice"))
    jsonl.write_run(folder, manifest, records, metrics.confusion(records).select(F.explode(F.array("precision", "recall")).alias("value")), records.where("error_code is not null").select("subject", "error_code"))
    parts = [spark.read.json(f"{folder}/{name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name in ("manifest", "verdicts", "metrics", "skipped")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_PARTS = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {k * 8 + 1}, 8) AS UBIGINT)) AS VARCHAR)" for k in range(8))


@query(f"""WITH d AS (SELECT o_orderkey, sha256('{{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS h FROM orders) SELECT sha256(concat_ws('|', CAST(count(*) AS VARCHAR), {_PARTS})) AS hash FROM d""")
def dataset_hash(spark, sf_dir):
    """One hash of a table, whatever the order of its rows."""
    rows = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return spark.range(1).select(F.lit(jsonl.dataset_hash(rows.repartition(3))).alias("hash"))


# --- scoring -------------------------------------------------------------------------------------------------------

_YOUNG = Rule("young", inputs=FEATURES[:5], labels=("benign", "abusive"), text=("name_skeleton",))
_FIRST = ",".join(f'"{f}"' for f in FEATURES[:5])


def _hash_sql(age: str = "floor(core__subject_age_h)") -> str:
    values = " || ',' || ".join([f"CAST(CAST({age} AS DOUBLE) AS VARCHAR)", *[f"CAST({column(f)} AS VARCHAR)" for f in FEATURES[1:5]]])
    head = '{"rule":"young","scorer":"local","versions":"1|none","benign_label":"benign","labels":["benign","abusive"],"inputs":[' + _FIRST + '],"values":['
    return f"sha256('{head}' || {values} || '],\"texts\":[\"p\",\"' || subject || '\"]}}')"


def _young_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    spine, events = _slices(spark, sf_dir)
    points = features(spine, events).withColumn("features", scoring.feature_map())
    return points.withColumn("text", F.create_map(F.lit("name_skeleton"), F.array(F.lit("p"), F.col("subject")))).select("tenant", "subject", "point", "features", "text")


@query(f"WITH {EVENTS_SQL},{_ACTIVITY},{_features_sql('slices', False)} SELECT subject, point, {_hash_sql()} AS input_hash FROM feat")
def input_hashes(spark, sf_dir):
    """What a score depends on, as a hash: rule, versions, labels, features rounded down, texts."""
    return scoring.plan_calls(_young_points(spark, sf_dir), scoring.rules_table(spark, [_YOUNG])).select("subject", "point", "input_hash")


@query(f"WITH {EVENTS_SQL},{_ACTIVITY},{_features_sql('slices', False)}, h AS (SELECT subject, point, {_hash_sql()} AS hash FROM feat), f AS (SELECT subject, hash FROM h WHERE point = 'full' AND CAST(subject AS INT) % 2 = 0) SELECT h.subject, h.point, CASE WHEN f.hash = h.hash THEN 'input_unchanged' END AS skip_reason, CASE WHEN f.hash = h.hash THEN 0.25 END AS risk FROM h LEFT JOIN f ON f.subject = h.subject")
def unchanged_calls(spark, sf_dir):
    """Calls that a stored hash makes needless take the stored result again."""
    points, rules = _young_points(spark, sf_dir), scoring.rules_table(spark, [_YOUNG])
    last = scoring.plan_calls(points, rules).where("point = 'full' and cast(subject as int) % 2 = 0").select("tenant", "subject", "rule", F.lit(0.3).alias("last_risk"), F.col("input_hash").alias("last_hash"))
    calls = scoring.plan_calls(points, rules, last).withColumn("probs", F.lit(None).cast("map<string,double>"))
    stored = last.select("tenant", "subject", "rule", F.create_map(F.lit("benign"), F.lit(0.75), F.lit("abusive"), F.lit(0.25)).alias("probs"))
    got = scoring.outcomes(scoring.carry_unchanged(calls, stored))
    return got.select("subject", "point", "skip_reason", "risk")


_TABLE = Rule("table", scorer="table", inputs=FEATURES[:1], labels=("benign", "abusive"))
_ABSENT = Rule("absent", scorer="nobody", labels=("benign", "abusive"))


def _table_scorer() -> scoring.Scorer:
    """Answers by a number among the features, some of them wrong."""

    def score(calls: DataFrame) -> DataFrame:
        k = F.element_at("features", "k")
        p = (k % 100) / 100
        probs = F.when(k % 7 == 0, F.create_map(F.lit("benign"), F.lit(0.4), F.lit("abusive"), F.lit(0.4))).when(k % 7 == 1, F.create_map(F.lit("benign"), F.lit(1.0))).when(k % 7 == 2, F.create_map(F.lit("benign"), F.lit(1.5), F.lit("abusive"), F.lit(-0.5))).otherwise(F.create_map(F.lit("benign"), 1 - p, F.lit("abusive"), p))
        return calls.withColumns({"probs": probs, "error_code": F.when(k % 11 == 0, "backoff").when(k % 11 == 1, "deadline_exceeded").when(k % 11 == 2, "adapter_error")})

    return scoring.Scorer("table", "1", score, labels=("abusive", "benign"))


@query(
    """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS subject, r.rule, c_custkey AS k, (c_custkey % 100) / 100.0 AS p FROM customer CROSS JOIN (VALUES ('table'), ('absent')) r(rule)),
s AS (SELECT *, CASE WHEN rule = 'absent' THEN 'unknown_scorer' WHEN k % 11 = 0 THEN 'backoff' WHEN k % 11 = 1 THEN 'deadline_exceeded' WHEN k % 11 = 2 THEN 'adapter_error' WHEN k % 7 < 3 THEN 'invalid_result' END AS code FROM c)
SELECT subject, rule, CASE WHEN code IS NULL THEN 'scored' ELSE 'unscored' END AS status, code AS error_code, CASE WHEN code IS NULL THEN round(CASE WHEN p <= 0.2 THEN 0.1 WHEN p >= 0.7 THEN 0.9 ELSE 0.1 + 0.8 * (p - 0.2) / 0.5 END, 9) END AS risk,
  coalesce(CASE WHEN code IS NULL THEN CASE WHEN p <= 0.2 THEN 0.1 WHEN p >= 0.7 THEN 0.9 ELSE 0.1 + 0.8 * (p - 0.2) / 0.5 END >= 0.6 END, false) AS flagged, CASE WHEN rule = 'table' THEN 'cal_1' ELSE 'none' END AS calibration FROM s"""
)
def plugged_scorer(spark, sf_dir):
    """A scorer of one's own, a rule without one, results that can't be, and a calibration by points."""
    rules = [_TABLE, _ABSENT]
    scorers = [scoring.local_scorer(), _table_scorer()]
    scoring.check_scorers(rules, scorers, calibrated_rules=("table",))
    points = read_table(spark, sf_dir, "customer").select(F.lit("t").alias("tenant"), F.col("c_custkey").cast("string").alias("subject"), F.create_map(F.lit("k"), F.col("c_custkey").cast("double")).alias("features"), F.create_map().cast("map<string,array<string>>").alias("text"))
    calls = scoring.score_calls(scoring.plan_calls(points, scoring.rules_table(spark, rules)), scorers)
    knots = spark.createDataFrame([("table", "table", "", "cal_1", None, None, [(0.7, 0.9), (0.2, 0.1)])], "rule string, scorer string, checkpoint string, id string, slope double, intercept double, knots array<struct<raw:double,risk:double>>")
    got = scoring.outcomes(calls, knots)
    return got.select("subject", "rule", "status", "error_code", F.round("risk", 9).alias("risk"), "flagged", "calibration")


@query(
    f"""WITH {EVENTS_SQL}, {_VERDICTS}, t AS (SELECT *, dense_rank() OVER (PARTITION BY subject ORDER BY scored_ns // {DAY_NS}) AS round FROM verdicts)
SELECT id, subject, rule, status, risk, 'because ' || rule AS reason, round AS dirty_seq_at_start, CAST(CASE WHEN error_code = 'cost_cap' THEN least(scored_ns + {DAY_NS + HOUR_NS}, (scored_ns // {DAY_NS} + 1) * {DAY_NS}) ELSE scored_ns + {DAY_NS + HOUR_NS} END AS BIGINT) AS next_ns
FROM t WHERE round = (SELECT max(round) FROM t o WHERE o.subject = t.subject)"""
)
def standing_rounds(spark, sf_dir):
    """Verdict records of the last round of each subject, with the instant at which it is due again."""
    from pyspark.sql import Window

    day = floor_div(F.col("scored_ns"), DAY_NS)
    rows = _verdicts(mapped_events(spark, sf_dir)).withColumn("round", F.dense_rank().over(Window.partitionBy("tenant", "subject").orderBy(day)).cast("long"))
    rows = rows.withColumns({"flagged": F.lit(False), "probs": F.create_map().cast("map<string,double>"), "calibration": F.lit("none")})
    records = scoring.verdict_records(rows, F.col("scored_ns"), F.col("round"), F.concat(F.lit("because "), "rule")).join(rows.select("tenant", "subject", "rule", "scored_ns", "id").distinct(), ["tenant", "subject", "rule", "scored_ns"])
    standing = subjects.current_round(records)
    later = scoring.next_rescore(F.col("scored_ns") + DAY_NS + HOUR_NS, F.lit(None).cast("long"), F.coalesce(F.col("error_code") == "cost_cap", F.lit(False)), F.col("scored_ns"))
    return standing.select("id", "subject", "rule", "status", "risk", "reason", "dirty_seq_at_start", later.alias("next_ns"))


_NOW = 1_706_500_000_000_000_000


@query(f"WITH {EVENTS_SQL}, s AS (SELECT subject, max(at_ns) AS last_ns, count(*) AS n, CAST(subject AS INT) AS u FROM ev GROUP BY subject) SELECT count(*) FILTER (n > 60 OR last_ns + {HOUR_NS} <= {_NOW}) AS due, CAST({_NOW} - min(last_ns) FILTER (n > 60) AS BIGINT) AS oldest_age_ns FROM s WHERE u % 4 <> 0")
def backlog(spark, sf_dir):
    s = subjects.roll_up(mapped_events(spark, sf_dir))
    u = F.col("subject").cast("int")
    return subjects.backlog(s.withColumns({"scored_seq": F.lit(60), "class": F.when(u % 4 == 0, "internal"), "next_rescore_ns": F.col("last_ns") + HOUR_NS}), _NOW)


@query(
    f"""WITH {EVENTS_SQL}, {_VERDICTS}, paid AS (SELECT strftime(make_timestamp(scored_ns // 1000), '%Y-%m-%d') AS day, * FROM verdicts WHERE scorer <> 'local'),
u AS (SELECT day, 'adapter' AS dim, scorer AS key, count(*) AS n FROM paid GROUP BY ALL UNION ALL SELECT day, 'subject', 't/' || subject, count(*) FROM paid GROUP BY ALL UNION ALL SELECT day, 'tenant', 't', count(*) FROM paid GROUP BY ALL),
c AS (SELECT *, CASE dim WHEN 'adapter' THEN 30 WHEN 'subject' THEN 2 ELSE 0 END AS cap, CASE dim WHEN 'adapter' THEN 23 WHEN 'subject' THEN 2 ELSE 0 END AS open_cap FROM u)
SELECT day, dim, key, n, cap, open_cap, cap > 0 AND n >= open_cap AS open_full, cap > 0 AND n >= cap AS "full" FROM c"""
)
def cap_report(spark, sf_dir):
    used = subjects.usage(_verdicts(mapped_events(spark, sf_dir)))
    return subjects.cap_report(used, adapter_cap=30, subject_cap=2)


# --- runs and replay -----------------------------------------------------------------------------------------------


@query(
    """WITH ev2 AS (SELECT user_id AS u, min(epoch_us(ts)) * 1000 AS first_ns, max(epoch_us(ts)) * 1000 AS last_ns FROM events GROUP BY user_id), c AS (SELECT c_custkey AS u, c_custkey AS k FROM customer),
l AS (SELECT c.u, k, first_ns, last_ns, CASE WHEN k % 5 IN (0, 1, 4) AND k > 0 THEN first_ns + 1000000000 * k END AS early, CASE WHEN k % 5 = 1 THEN first_ns - 1000000000 WHEN k % 5 IN (2, 3, 4) THEN last_ns + 1 END AS f FROM c LEFT JOIN ev2 ON ev2.u = c.u),
x AS (SELECT *, CASE WHEN first_ns IS NULL THEN 'zero_events' WHEN k % 5 = 2 THEN 'empty_decision_at' WHEN k % 5 = 3 THEN 'bad_decision_at' WHEN k % 5 = 1 THEN 'slice_order' END AS code FROM l)
SELECT CAST(u AS VARCHAR) AS subject, code, CAST(CASE WHEN code IS NULL THEN early END AS BIGINT) AS early_ns, CAST(CASE WHEN code IS NULL THEN last_ns + 1 END AS BIGINT) AS full_ns FROM x"""
)
def label_points(spark, sf_dir):
    """Decision points that labels ask for, and why others have none."""
    events = mapped_events(spark, sf_dir).withColumn("type", F.lit("resource.created"))
    bounds = events.groupBy("subject").agg(F.min("at_ns").alias("first_ns"))
    k = F.col("c_custkey")
    rows = read_table(spark, sf_dir, "customer").select(F.lit("t").alias("tenant"), k.cast("string").alias("subject"), (k % 5).alias("m"), k.alias("k")).join(bounds, "subject", "left")
    show = lambda ns: F.date_format(F.timestamp_micros(floor_div(ns, 1000)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    early = show(F.coalesce("first_ns", F.lit(0)) + F.col("k") * 1_000_000_000)
    given = (
        F.when(F.col("m").isin(0, 4), F.create_map(F.lit("early_15m"), early))
        .when(F.col("m") == 1, F.create_map(F.lit("early_15m"), early, F.lit("full"), show(F.coalesce("first_ns", F.lit(0)) - 1_000_000_000)))
        .when(F.col("m") == 3, F.create_map(F.lit("full"), F.lit("soon")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    asked = rows.select("tenant", "subject", given.alias("decision_at"))
    spine, bad = replay.points_from_labels(asked, events)
    at = spine.groupBy("subject").agg(F.max(F.when(F.col("point") == "early_15m", F.col("now_ns"))).alias("early_ns"), F.max(F.when(F.col("point") == "full", F.col("now_ns"))).alias("full_ns"))
    return asked.select("subject").join(bad.select("subject", "code"), "subject", "left").join(at, "subject", "left").select("subject", "code", "early_ns", "full_ns")


@query("SELECT CAST(c_custkey AS VARCHAR) AS subject, CASE WHEN c_custkey % 7 = 0 THEN 'skipped_events' WHEN c_custkey % 3 = 0 THEN 'missing_slice' WHEN c_custkey % 5 = 0 THEN 'backoff' END AS error_code, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN c_custkey / 1e6 END AS risk, c_custkey % 7 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0 AS unscored FROM customer")
def run_at_slice(spark, sf_dir):
    """A run takes one slice of each labelled subject; what is not there is unscored, with its reason."""
    k = F.col("c_custkey")
    c = read_table(spark, sf_dir, "customer")
    people = c.select(k.cast("string").alias("subject"), (k % 7 == 0).alias("has_skipped_events"))
    at = F.explode(F.array(F.lit("early_15m"), F.when(k % 3 != 0, "full").otherwise("first_send")))
    points = c.select(k.cast("string").alias("subject"), at.alias("slice"), (k / 1e6).alias("risk"), F.when(k % 5 == 0, "backoff").alias("error_code"))
    return metrics.run_slice(people, points, "full").select("subject", "error_code", "risk", "unscored")


@query(f"WITH {_RECORDS} SELECT scorer, count(*) FILTER (latency_ms > 3000) AS truncated, CAST(sum(latency_ms * 3) AS BIGINT) AS cost_micro, count(*) AS total FROM rec GROUP BY scorer")
def run_counters(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumns({"truncated": F.col("latency_ms") > 3000, "cost_micro": (F.col("latency_ms") * 3).cast("long")})
    return metrics.confusion(rows, ("scorer",)).select("scorer", "truncated", "cost_micro", "total")


@query(f"WITH {_METRICS}, f AS (SELECT * FROM (VALUES ('a', 'precision', 0.0), ('a', 'recall', 1.0), ('b', 'recall', 0.0), ('b', 'ece', 0.0), ('b', 'none', 0.5)) t(slice, metric, floor)) SELECT f.slice, f.metric, CAST(f.floor AS DOUBLE) AS floor, round(value, 9) AS got, value IS NULL AS undefined FROM f LEFT JOIN met ON met.metric = f.metric WHERE value IS NULL OR CASE WHEN f.metric = 'ece' THEN value > floor ELSE value < floor END")
def gate_by_run(spark, sf_dir):
    """Floors of two runs told apart by rule, scorer and slice."""
    found = metrics.long_metrics(_records(spark, sf_dir))
    both = found.select(F.lit("r").alias("rule"), F.lit("local").alias("scorer"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("slice"), "metric", "value")
    floors = spark.createDataFrame([("r", "local", s, m, v) for s, m, v in (("a", "precision", 0.0), ("a", "recall", 1.0), ("b", "recall", 0.0), ("b", "ece", 0.0), ("b", "none", 0.5))], "rule string, scorer string, slice string, metric string, floor double")
    return metrics.gate(both, floors).select("slice", "metric", "floor", F.round("got", 9).alias("got"), "undefined")


@query("SELECT o_orderkey, round(1 - (o_custkey % 100) / 100.0, 9) AS benign FROM orders")
def recorded_scores(spark, sf_dir):
    """Scores taken from a recording of the same corpus."""
    o = read_table(spark, sf_dir, "orders")
    named = [F.lit("vendor").alias("scorer"), F.lit("1").alias("version"), F.lit("m").alias("model"), F.lit("p").alias("prompt_version"), F.col("o_custkey").cast("string").alias("input_hash")]
    corpus = jsonl.dataset_hash(o.select("o_orderkey", "o_custkey"))
    p = (F.col("o_custkey") % 100) / 100.0
    recorded = o.select(*named, F.create_map(F.lit("benign"), 1 - p).alias("probs"), F.lit(corpus).alias("corpus_hash")).dropDuplicates(["input_hash"])
    return metrics.replay_recorded(o.select("o_orderkey", *named), recorded, corpus).select("o_orderkey", F.round(F.element_at("probs", "benign"), 9).alias("benign"))


_REPLAY = f"""first AS (SELECT subject, min(at_ns) FILTER (type <> 'label') AS first_ns FROM ev GROUP BY subject),
x AS (SELECT DISTINCT subject, t FROM (SELECT subject, at_ns + {HOUR_NS} AS t FROM ev WHERE type IN ('resource.created', 'content.sent') UNION ALL SELECT subject, at_ns + {DAY_NS} FROM ev WHERE type IN ('resource.created', 'content.sent') UNION ALL SELECT subject, first_ns + {DAY_NS} FROM first WHERE first_ns IS NOT NULL)),
y AS (SELECT subject, t, CASE WHEN t % 300000000000 = 0 THEN t ELSE (t // 300000000000 + 1) * 300000000000 END AS step FROM x),
z AS (SELECT y.*, e.at_ns AS next_ns FROM y ASOF LEFT JOIN (SELECT DISTINCT subject, at_ns FROM ev) e ON e.subject = y.subject AND e.at_ns >= y.t),
due AS (SELECT DISTINCT subject, step FROM z WHERE next_ns IS NULL OR step <= next_ns),
p AS (SELECT 'event' AS trigger, subject, '/' || id AS point, at_ns AS now_ns, 1 AS late, id FROM ev UNION ALL SELECT 'timer', subject, 'timer/' || step, step, 0, '' FROM due),
rp AS (SELECT trigger, subject, ltrim(point, '/') AS point, CAST(now_ns AS BIGINT) AS now_ns, CAST(sum(late) OVER (ORDER BY now_ns, late, id, subject ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cutoff_seq FROM p)"""


@query(f"WITH {EVENTS_SQL}, {_REPLAY} SELECT * FROM rp")
def replay_points(spark, sf_dir):
    """Every event and every timer of a replay, with what each may know."""
    spine, _ = replay.replay_points(mapped_events(spark, sf_dir))
    return spine.select("trigger", "subject", F.ltrim(F.col("point"), F.lit("/")).alias("point"), "now_ns", "cutoff_seq")


# The log with each event's place in canonical order; for evidence, the place stands for the instant.
_PLACED = f"""{_REPLAY}, placed AS (SELECT *, row_number() OVER (ORDER BY at_ns, id) AS seq FROM ev),
sp AS (SELECT subject, point, now_ns, cutoff_seq + 1 AS cutoff_ns FROM rp), timed AS (SELECT * REPLACE (seq AS at_ns) FROM placed)"""


def _replayed_features(evidence: bool) -> str:
    return _features_sql("sp", evidence, "e.seq < s.cutoff_ns").replace("JOIN ev e", "JOIN placed e")


# points that no event precedes have no row in ``feat`` and all features zero
_FEATS = f"""feats AS (SELECT rp.subject, rp.point, rp.trigger, rp.now_ns, {', '.join(f'coalesce({column(f)}, 0) AS {column(f)}' for f in FEATURES)}, next_rescore_ns
FROM rp LEFT JOIN feat ON feat.subject = rp.subject AND feat.point = rp.point)"""
_REPLAYED = ",".join((_PLACED, _evidence_sql("sp").replace("FROM ev ", "FROM timed "), _replayed_features(True), _FEATS)) + f", risky AS (SELECT *, 1 / (1 + exp(-({_logit_sql()}))) AS r FROM feats)"


@query(
    f"""WITH {EVENTS_SQL}, {_REPLAYED} SELECT subject, point, trigger, now_ns, {_ROUNDED}, CAST(next_rescore_ns AS VARCHAR) AS next_rescore_ns, round(r, 9) AS score,
CASE WHEN r >= 0.8 THEN 'high' WHEN r >= 0.4 THEN 'medium' ELSE 'low' END AS tier, false AS degraded FROM risky"""
)
def replay_verdicts(spark, sf_dir):
    """All features, evidence among them, and the verdict at every event and timer of the replay."""
    got = risk_of_replay(mapped_events(spark, sf_dir))
    shown = [F.round(column(f), 9).alias(column(f)) for f in FEATURES]
    return got.select("subject", F.ltrim(F.col("point"), F.lit("/")).alias("point"), "trigger", "now_ns", *shown, F.col("next_rescore_ns").cast("string").alias("next_rescore_ns"), F.round("score", 9).alias("score"), "tier", "degraded")


@query(f"WITH {EVENTS_SQL}, {_PLACED}, {_replayed_features(False)}, {_FEATS} SELECT subject, point, {_ROUNDED}, CAST(next_rescore_ns AS VARCHAR) AS next_rescore_ns FROM feats")
def replay_features(spark, sf_dir):
    """A subject's own features at every event and timer of the replay, by one sweep of each subject."""
    spine, events = replay.replay_points(mapped_events(spark, sf_dir))
    got = _shown(features_by_sweep(spine, events))
    return got.withColumn("point", F.ltrim(F.col("point"), F.lit("/")))


# --- streams -------------------------------------------------------------------------------------------------------


#: Rows of a file of a stream that is made from a table.
_FILE_ROWS = 100_000


def _in_turn(spark: SparkSession, parts: list[DataFrame], start: Callable[[DataFrame], StreamingQuery]) -> None:
    """The parts arrive one after the other, each in as many files as its rows need, so that no task has all of it. ``start``
    runs the stream over what is new since its checkpoint: a micro-batch for each part."""
    path, cores = new_path(spark, "stream"), spark.sparkContext.defaultParallelism
    for part in parts:
        n = part.count()
        part.repartition(max(min(cores, n // 1000 + 1), n // _FILE_ROWS)).write.mode("append").parquet(path)
        start(spark.readStream.schema(parts[0].schema).parquet(path)).awaitTermination()


def _appended(spark: SparkSession, parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What a stream of the parts appends."""
    out, state = new_path(spark, "out"), new_path(spark, "state")
    _in_turn(spark, parts, lambda stream: job(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.schema(schema).parquet(out)


_INGEST_SQL = r"""WITH e AS (SELECT *, CAST(regexp_extract(props, '(\d+)', 1) AS INT) AS k FROM events),
c AS (SELECT event_id, CASE WHEN k = 1 THEN 'bad_id' WHEN k = 2 THEN 'bad_subject' WHEN k = 3 THEN 'bad_type' WHEN k IN (4, 6) THEN 'bad_timestamp' WHEN k = 5 THEN 'bad_links'
  WHEN event_type = 'purchase' AND k BETWEEN 50 AND 59 THEN 'redaction_failed' WHEN event_type = 'view' AND k >= 90 AND k % 4 <> 0 THEN 'redaction_failed'
  WHEN event_type NOT IN ('purchase', 'view') AND k < 20 THEN 'redaction_failed' ELSE 'accepted' END AS outcome FROM e)
SELECT outcome, count(*) * CASE WHEN outcome = 'accepted' THEN 1 ELSE 2 END AS n FROM c GROUP BY outcome"""


@query(_INGEST_SQL)
def streamed_ingest(spark, sf_dir):
    """Raw events as a stream in which every row comes twice: good rows are logged once, the others keep their code."""
    raw = _raw_events(spark, sf_dir)
    events, rejects = new_path(spark, "events"), new_path(spark, "rejects")
    state = new_path(spark, "state")
    _in_turn(spark, [raw, raw], lambda stream: jobs.ingest(stream, events, rejects, state))
    logged = spark.read.parquet(events).agg(F.count("*").alias("n")).select(F.lit("accepted").alias("outcome"), "n")
    return logged.unionByName(spark.read.parquet(rejects).groupBy(F.col("code").alias("outcome")).agg(F.count("*").alias("n")))


@query("WITH o AS (SELECT o_custkey, o_orderstatus AS s, o_orderkey, first_value(o_orderstatus) OVER w AS f, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT CASE WHEN r = 1 THEN 'accepted' WHEN s = f THEN 'duplicate' ELSE 'conflict' END AS outcome, count(*) AS n FROM o GROUP BY ALL")
def streamed_outcomes(spark, sf_dir):
    """Idempotency classes of a stream, from state."""
    rows = read_table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant"), F.lit("").alias("producer"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("body_hash"), F.col("o_orderkey").cast("long").alias("received_ns"))
    found = _appended(spark, [rows], jobs.outcomes, "tenant string, producer string, id string, outcome string")
    return found.groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS_SQL}, {_VERDICTS} SELECT subject, CAST(arg_max(scored_ns, scored_ns) // 1000000 + 3600000 AS BIGINT) AS due_ms FROM verdicts GROUP BY subject HAVING max(CASE WHEN subject = 'end' THEN 1 ELSE 0 END) = 0")
def streamed_timers(spark, sf_dir):
    """The timer of each subject's last score, one hour after it; earlier scores' timers are replaced. One score far in
    the future moves time past them all."""
    rows = _verdicts(mapped_events(spark, sf_dir)).select("tenant", "subject", "scored_ns", (floor_div(F.col("scored_ns"), 1_000_000) * 1_000_000 + HOUR_NS).alias("next_rescore_ns"))
    last = rows.agg(F.max("scored_ns").alias("scored_ns")).select(F.lit("t").alias("tenant"), F.lit("end").alias("subject"), (F.col("scored_ns") + 30 * DAY_NS).alias("scored_ns"), F.lit(None).cast("long").alias("next_rescore_ns"))
    parts = [part.withColumn("at", F.timestamp_micros(floor_div(F.col("scored_ns"), 1000))) for part in (rows, last)]
    return _appended(spark, parts, jobs.score_timers, "tenant string, subject string, due_ms long").select("subject", "due_ms")


@query(f"WITH {EVENTS_SQL} SELECT subject, at_ns // 3600000000000 AS hour, count(*) FILTER (type = 'resource.created') AS resources, count(*) FILTER (type = 'content.sent') AS sends FROM ev WHERE type IN ('resource.created', 'content.sent') GROUP BY ALL")
def streamed_velocity(spark, sf_dir):
    """Counts by sliding hour from a stream; shown are the windows on the full hour."""
    own = mapped_events(spark, sf_dir).select("tenant", "subject", "type", "at")
    out = new_path(spark, "velocity")

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    state, half = new_path(spark, "state"), F.pmod(F.xxhash64("subject", "at"), F.lit(2))
    _in_turn(spark, [own.where(half == k) for k in (0, 1)], lambda stream: jobs.velocity(stream).writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start())
    rows = spark.read.parquet(out)
    last = rows.agg(F.max("batch").alias("batch"))
    start = F.unix_seconds("window.start")
    return rows.join(F.broadcast(last), "batch").where(start % 3600 == 0).select("subject", (start / 3600).cast("long").alias("hour"), "resources", "sends")


@query(f"WITH {EVENTS_SQL} SELECT subject, count(*) AS rounds FROM (SELECT DISTINCT subject, k % 2 AS part FROM ev WHERE type = 'content.sent') GROUP BY subject")
def streamed_scores(spark, sf_dir):
    """Each micro-batch scores the subjects it touches; the number of rounds that every subject got."""
    sent = mapped_events(spark, sf_dir).where("type = 'content.sent'").select("tenant", "subject", "type", "mode", "label", ((F.col("recipient_count") - 1) % 5).alias("c"), "recipient_domain", "subject_line", "at_ns", "id")
    k = read_table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 2).alias("part"))
    sent = sent.join(k, "id").select("tenant", "subject", "type", "mode", "label", "part")
    out, state = new_path(spark, "verdicts"), new_path(spark, "state")
    links = spark.createDataFrame([], "tenant string, kind string, hash string, subject string, first_ns long, last_ns long")
    parts = [sent.where(F.col("part") == part).drop("part") for part in (0, 1)]
    _in_turn(spark, parts, lambda stream: jobs.score_stream(stream, lambda who, batch: who.withColumn("risk", F.lit(0.1)), out, lambda: links, state))
    return spark.read.parquet(out).groupBy("subject").agg(F.count("*").alias("rounds"))


_CLUSTERS_SQL = f"""{_touch_sql()}, e AS (SELECT DISTINCT a.subject AS a, b.subject AS b FROM touches a JOIN touches b ON a.kind = b.kind AND a.hash = b.hash),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)"""


def _by_time(events: DataFrame, parts: int) -> list[DataFrame]:
    """The log cut by time into parts of like length."""
    ends = events.agg(F.min("at_ns").alias("low"), F.max("at_ns").alias("high"))
    at = F.least(F.lit(parts - 1), F.floor((F.col("at_ns") - F.col("low")) * parts / (F.col("high") - F.col("low") + 1)))
    rows = events.join(F.broadcast(ends)).withColumn("part", at).drop("low", "high")
    return [rows.where(F.col("part") == k).drop("part") for k in range(parts)]


@query(f"WITH RECURSIVE {EVENTS_SQL},{_CLUSTERS_SQL} SELECT a AS subject, min(b) AS cluster FROM reach GROUP BY a")
def streamed_clusters(spark, sf_dir):
    """Clusters of linked subjects from a stream of three micro-batches, each contracted against those so far."""
    forest, state = new_path(spark, "forest"), new_path(spark, "state")
    _in_turn(spark, _by_time(mapped_events(spark, sf_dir), 3), lambda stream: jobs.cluster_stream(stream, forest, state))
    of = graph.components_of(graph.read_forest(spark, forest)).where("node like 's%'")
    subjects_ = of.select(F.element_at(F.split("node", "\x1f"), -1).alias("subject"), "component")
    names = subjects_.groupBy("component").agg(F.min("subject").alias("cluster"))
    return subjects_.join(names, "component").select("subject", "cluster")


_BATCHES_SQL = f"""ends AS (SELECT min(at_ns) AS low, max(at_ns) AS high FROM ev), cut AS (SELECT ev.*, least(1, CAST(floor(CAST((at_ns - low) * 2 AS DOUBLE) / (high - low + 1)) AS INT)) AS part FROM ev, ends),
until AS (SELECT b.part, max(c.at_ns) + 1 AS cutoff_ns FROM (SELECT DISTINCT part FROM cut) b JOIN cut c ON c.part <= b.part GROUP BY b.part),
changed AS (SELECT DISTINCT c.subject, CAST(c.part AS VARCHAR) AS point, u.cutoff_ns FROM cut c JOIN until u ON u.part = c.part WHERE type IN ('subject.deleted', 'label')),
{_touch_sql()},{_neighbour_sql('near', 'changed', ALL_KINDS)},
due AS (SELECT subject, CAST(part AS VARCHAR) AS point FROM cut UNION SELECT other, point FROM near),
sp AS (SELECT d.subject, d.point, u.cutoff_ns AS now_ns, u.cutoff_ns FROM due d JOIN until u ON CAST(u.part AS VARCHAR) = d.point)"""


@query(f"""WITH {EVENTS_SQL}, {_BATCHES_SQL},{_evidence_sql('sp').replace(_touch_sql() + ',', '', 1)},{_features_sql('sp', True)},
risk AS (SELECT subject, point, 1 / (1 + exp(-({_logit_sql()}))) AS r FROM feat)
SELECT sp.subject, CAST(sp.point AS BIGINT) AS batch, round(coalesce(r, 1 / (1 + exp(-({LOCAL_WEIGHTS.bias})))), 9) AS score FROM sp LEFT JOIN risk ON risk.subject = sp.subject AND risk.point = sp.point""")
def streamed_risk(spark, sf_dir):
    """Scores of a stream in two micro-batches: each scores its own subjects and the neighbours of those that it marks, by
    the links and the log up to it, with all features and evidence."""
    events = mapped_events(spark, sf_dir)
    parts = _by_time(events, 2)
    log = [written(part, "log") for part in parts]
    seen: list[DataFrame] = []

    def so_far() -> DataFrame:
        seen.append(log[len(seen)])
        return link_ops.link_summary(link_ops.link_touches(_union(seen)))

    def score(who: DataFrame, batch: int) -> DataFrame:
        known = _union(seen)
        last = F.broadcast(known.agg((F.max("at_ns") + 1).alias("now_ns")))
        spine = who.join(last).select("tenant", "subject", F.lit(str(batch)).alias("point"), "now_ns", F.col("now_ns").alias("cutoff_ns"))
        return risk_of_points(written(spine, "due"), known).select("tenant", "subject", "score", "tier", F.lit(batch).cast("long").alias("batch"))

    out, state = new_path(spark, "verdicts"), new_path(spark, "state")
    _in_turn(spark, log, lambda stream: jobs.score_stream(stream, score, out, so_far, state))
    return spark.read.parquet(out).select("subject", "batch", F.round("score", 9).alias("score"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return parts[0] if len(parts) == 1 else parts[0].unionByName(_union(parts[1:]))


# --- state with timers and expiry ----------------------------------------------------------------------------------


def _finished(spark: SparkSession, parts: list[DataFrame], job: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """As ``_appended``, from the RocksDB store."""
    with stateful.with_state_store(spark):
        return _appended(spark, parts, job, schema)


@query(f"WITH {EVENTS_SQL}, {_VERDICTS}, l AS (SELECT subject, max(scored_ns) AS last_ns, count(DISTINCT scored_ns) AS n FROM verdicts GROUP BY subject) SELECT subject, CAST(last_ns // 1000000 + 3600000 AS BIGINT) AS due_ms FROM l WHERE CAST(subject AS INT) % 5 <> 0")
def clock_timers(spark, sf_dir):
    """Timers by the clock: every score but a subject's last asks for an instant far ahead, the last one for an hour after
    it, or for none (every fifth subject); then all earlier scores come once more, late, and change nothing."""
    own = _verdicts(mapped_events(spark, sf_dir)).select("tenant", "subject", "scored_ns").distinct()
    last = own.groupBy("tenant", "subject").agg(F.max("scored_ns").alias("scored_ns"))
    soon = F.when(F.col("subject").cast("int") % 5 != 0, floor_div(F.col("scored_ns"), 1_000_000) * 1_000_000 + HOUR_NS)
    early = own.join(last, ["tenant", "subject", "scored_ns"], "left_anti").withColumn("next_rescore_ns", F.col("scored_ns") + 36500 * DAY_NS)
    return _finished(spark, [early, last.withColumn("next_rescore_ns", soon), early], stateful.score_timers, "tenant string, subject string, due_ms long").select("subject", "due_ms")


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT subject, at_ns FROM ev WHERE type IN ('resource.created', 'content.sent')), x AS (SELECT subject, at_ns + {HOUR_NS} AS t FROM w UNION ALL SELECT subject, at_ns + {DAY_NS} FROM w)
SELECT DISTINCT subject, CAST(CASE WHEN t % 300000000000 = 0 THEN t // 1000000 ELSE (t // 300000000000 + 1) * 300000 END AS BIGINT) AS due_ms FROM x""")
def exit_timers(spark, sf_dir):
    """Every step at which a window loses an event, though the second batch holds the earlier half of the log: nothing is
    too late for its timer. A step that both batches ask for is due in each."""
    own = mapped_events(spark, sf_dir).select("tenant", "subject", "type", "at_ns")
    middle = own.agg(F.avg("at_ns").alias("middle"))
    halves = own.join(F.broadcast(middle))
    parts = [halves.where("at_ns >= middle").drop("middle"), halves.where("at_ns < middle").drop("middle")]
    return _finished(spark, parts, stateful.rescore_timers, "tenant string, subject string, due_ms long").select("subject", "due_ms").distinct()


@query("WITH o AS (SELECT o_custkey, o_orderstatus AS s, o_orderkey, first_value(o_orderstatus) OVER w AS f, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey AS received_ns, CASE WHEN r = 1 THEN 'accepted' WHEN s = f THEN 'duplicate' ELSE 'conflict' END AS outcome FROM o")
def expiring_outcomes(spark, sf_dir):
    """Idempotency classes of a stream in two batches, from state that expires."""
    rows = read_table(spark, sf_dir, "orders").select(F.lit("t").alias("tenant"), F.lit("").alias("producer"), F.col("o_custkey").cast("string").alias("id"), F.col("o_orderstatus").alias("body_hash"), F.col("o_orderkey").cast("long").alias("received_ns"))
    middle = F.broadcast(rows.agg(F.avg("received_ns").alias("middle")))
    halves = rows.join(middle)
    parts = [halves.where("received_ns < middle").drop("middle"), halves.where("received_ns >= middle").drop("middle")]
    found = _finished(spark, parts, stateful.outcomes, "tenant string, producer string, id string, received_ns long, outcome string")
    return found.select("id", "received_ns", "outcome")


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT subject, id, at_ns, CASE WHEN type = 'resource.created' THEN 1 ELSE 0 END AS r, CASE WHEN type = 'content.sent' AND NOT own THEN n ELSE 0 END AS s FROM ev WHERE type IN ('resource.created', 'content.sent'))
SELECT a.subject, a.id, CAST(sum(b.r) AS BIGINT) AS resource_1h, CAST(sum(b.s) AS BIGINT) AS sends_1h FROM w a JOIN w b ON b.subject = a.subject AND b.at_ns > a.at_ns - {HOUR_NS} AND (b.at_ns < a.at_ns OR b.at_ns = a.at_ns AND b.id <= a.id) GROUP BY a.subject, a.id""")
def exact_velocity(spark, sf_dir):
    """At each resource and send the resources and recipients of the hour up to it, from recent events in state; the log
    comes in two batches."""
    own = mapped_events(spark, sf_dir).select("tenant", "subject", "producer", "id", "type", "at_ns", "recipient_is_own_identity", "recipient_count")
    halves = own.join(F.broadcast(own.agg(F.avg("at_ns").alias("middle"))))
    parts = [halves.where("at_ns < middle").drop("middle"), halves.where("at_ns >= middle").drop("middle")]
    found = _finished(spark, parts, stateful.velocity, "tenant string, subject string, producer string, id string, at_ns long, resource_1h long, sends_1h long")
    return found.select("subject", "id", "resource_1h", "sends_1h")


@query(_INGEST_SQL)
def stateful_ingest(spark, sf_dir):
    """As ``streamed_ingest``, with what is known of each id in state; the log itself is never read."""
    raw = _raw_events(spark, sf_dir)
    events, rejects = new_path(spark, "events"), new_path(spark, "rejects")
    state = new_path(spark, "state")
    with stateful.with_state_store(spark):
        _in_turn(spark, [raw, raw], lambda stream: stateful.ingest(stream, events, rejects, state))
    logged = spark.read.parquet(events).agg(F.count("*").alias("n")).select(F.lit("accepted").alias("outcome"), "n")
    return logged.unionByName(spark.read.parquet(rejects).groupBy(F.col("code").alias("outcome")).agg(F.count("*").alias("n")))


# --- the engine in SQL ---------------------------------------------------------------------------------------------


@query(f"""WITH {EVENTS_SQL},{_ACTIVITY},{_evidence_sql('slices')},{_features_sql('slices', True)}, now AS (SELECT DISTINCT subject, 'now' AS point, CAST(9e18 AS BIGINT) AS cutoff_ns FROM ev),
{_neighbour_sql('near', 'now', ALL_KINDS)}, risk AS (SELECT subject, point, 1 / (1 + exp(-({_logit_sql()}))) AS r FROM feat)
SELECT r.subject, count(*) AS points, round(max(r), 9) AS worst, (SELECT count(*) FROM near n WHERE n.subject = r.subject) AS n_neighbours, (SELECT max(core__resource_total) FROM feat f WHERE f.subject = r.subject) AS resources
FROM risk r GROUP BY r.subject""")
def sql_surface(spark, sf_dir):
    """A question to the registered views, asked in SQL."""
    from .sql import register

    register(mapped_events(spark, sf_dir), "rl_")
    return spark.sql("""SELECT v.subject, v.points, v.worst, coalesce(n.n, 0) AS n_neighbours, f.resources
FROM (SELECT subject, count(*) AS points, round(max(score), 9) AS worst FROM rl_verdicts GROUP BY subject) v
LEFT JOIN (SELECT subject, count(*) AS n FROM rl_neighbours GROUP BY subject) n ON n.subject = v.subject
JOIN (SELECT subject, max(core__resource_total) AS resources FROM rl_features GROUP BY subject) f ON f.subject = v.subject""")


# --- whole results of single operators -----------------------------------------------------------------------------


@query(f"WITH {EVENTS_SQL} SELECT subject, count(*) FILTER (type <> 'label') AS dirty_before, count(*) AS dirty_after FROM ev GROUP BY subject")
def label_appends(spark, sf_dir):
    """Labels appended to their table make their subjects dirty: the count of each before and after."""
    events = mapped_events(spark, sf_dir)
    own, marks = events.where("type <> 'label'"), events.where("type = 'label'").select("tenant", "subject", "label", F.col("at_ns").alias("labelled_ns"))
    path = new_path(spark, "labels")
    jsonl.append_rows(marks.limit(0), path)
    everyone = events.select("tenant", "subject").distinct()

    def dirty(name: str) -> DataFrame:
        labels = spark.read.schema(marks.schema).parquet(path)
        return subjects.roll_up(own, labels).select("tenant", "subject", F.col("dirty_seq").alias(name))

    before = everyone.join(dirty("dirty_before"), ["tenant", "subject"], "left")
    jsonl.append_rows(marks, path)
    both = before.join(dirty("dirty_after"), ["tenant", "subject"], "left")
    return both.select("subject", F.coalesce("dirty_before", F.lit(0)).alias("dirty_before"), F.coalesce("dirty_after", F.lit(0)).alias("dirty_after"))


def _weights_body(bias: str) -> str:
    """The hashed form of the local weights in SQL, with another bias."""
    pairs = ", ".join(f'["{f}", {w!r}]' for f, w in sorted(LOCAL_WEIGHTS.weights.items()))
    return f"""'["{LOCAL_WEIGHTS.benign_label}", ' || {bias} || ', [{pairs}]]'"""


@query(f"SELECT n_nationkey, substr(sha256({_weights_body("n_nationkey || '.5'")}), 1, 16) AS version FROM nation")
def weight_versions(spark, sf_dir):
    """The version of the local weights with each nation's key and a half as bias: a hash of benign label, bias and weights."""
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()
    made = [(r["n_nationkey"], scoring.weights_version(replace(LOCAL_WEIGHTS, bias=r["n_nationkey"] + 0.5))) for r in rows]
    return read_table(spark, sf_dir, "nation").select("n_nationkey").join(spark.createDataFrame(made, "n_nationkey int, version string"), "n_nationkey")


#: Compatibility characters and what NFKC makes of them (fixed values).
_COMPATIBILITY = (("\ufb01", "fi"), ("\uff21\uff42", "Ab"), ("\u00b2", "2"), ("\u2460", "1"), ("\u2126", "\u03a9"), ("\u3392", "MHz"), ("\u00a0", " "))


@query(f"SELECT doc_id, sha256(CASE doc_id % {len(_COMPATIBILITY)} {' '.join(f"WHEN {k} THEN '{plain}'" for k, (_, plain) in enumerate(_COMPATIBILITY))} END || nfc_normalize(text)) AS nfkc_sha256 FROM documents WHERE text IS NOT NULL")
def compatibility_texts(spark, sf_dir):
    """NFKC of every text behind a compatibility character, which NFC would leave."""
    docs = read_table(spark, sf_dir, "documents").where("text is not null")
    mark = F.element_at(F.array(*[F.lit(c) for c, _ in _COMPATIBILITY]), (F.col("doc_id") % len(_COMPATIBILITY) + 1).cast("int"))
    return docs.select("doc_id", F.sha2(nfkc(F.concat(mark, F.col("text"))), 256).alias("nfkc_sha256"))


@query(f"""WITH {EVENTS_SQL}, touches AS (SELECT 'asn' AS kind, 'as' || (CAST(subject AS INT) % 9) AS hash, subject, at_ns FROM ev WHERE type <> 'label' UNION ALL SELECT 'ua_hash', 'ua' || (CAST(subject AS INT) % 4), subject, at_ns FROM ev WHERE type <> 'label'
  UNION ALL SELECT 'email_hash', email_hash, subject, at_ns FROM ev WHERE type <> 'label'), now AS (SELECT DISTINCT subject, 'now' AS point, CAST(9e18 AS BIGINT) AS cutoff_ns FROM ev),{_neighbour_sql('near', 'now', "'asn', 'ua_hash'", 6, 9)}
SELECT subject, other, truncated FROM near""")
def opt_in_links(spark, sf_dir):
    """Neighbours over kinds of links that count only where they are asked for."""
    u = F.col("subject").cast("int")
    events = mapped_events(spark, sf_dir).withColumns({"asn": F.concat(F.lit("as"), u % 9), "ua_hash": F.concat(F.lit("ua"), u % 4)})
    summary = link_ops.link_summary(link_ops.link_touches(events))
    found = link_ops.neighbours(events.select("tenant", "subject").distinct(), summary, ("asn", "ua_hash"), 6, 9)
    return found.select("subject", "other", "truncated")


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Nation ' || lower((SELECT n_name FROM nation WHERE n_nationkey = c_custkey % 25)) ELSE 'Zz' || c_custkey || 'q' END AS brand FROM customer"""
)
def listed_phrases(spark, sf_dir):
    """Names from a long list (one for each customer, and the nations) found in lines of text by the trie."""
    customers, nations = read_table(spark, sf_dir, "customer"), read_table(spark, sf_dir, "nation")
    spelled = F.concat(F.lit("Zz"), F.col("c_custkey"), F.lit("q"))
    listed = customers.where("c_custkey % 3 <> 0").select(spelled.alias("name"), F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("case_sensitive"))
    listed = listed.unionByName(nations.select(F.concat(F.lit("Nation "), F.lower("n_name")).alias("name"), F.array(F.concat_ws(" ", F.lit("land of"), "n_name")).alias("aliases"), F.lit(False).alias("case_sensitive")))
    lines = customers.join(F.broadcast(nations), F.col("c_custkey") % 25 == F.col("n_nationkey"))
    lines = lines.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("greetings from the land of "), "n_name", F.lit("!"))).otherwise(F.concat(F.lit("to "), spelled, F.lit(" with thanks"))).alias("text"))
    found = match_brands(lines, jsonl.read_brands(listed))
    return lines.join(found, "text").select("c_custkey", F.element_at("name_brands", 1).alias("brand"))

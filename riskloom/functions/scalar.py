"""Scalar column functions: instants, hashes, buckets, logistic helpers, reasons and family keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HASH_QUANTA

RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:\d{2})$"


def floor_div(x: Column, n: int) -> Column:
    """x // n of whole numbers, rounded down. A division by way of doubles is wrong from 2 ** 53 on, as instants are."""
    return F.call_function("div", x - F.pmod(x, F.lit(n)), F.lit(n))


def parse_rfc3339(text: Column) -> Column:
    """struct<at timestamp, at_ns bigint, utc boolean> of an RFC 3339 instant, null where it is none.

    The fraction is read to the nanosecond apart from the timestamp, which keeps microseconds.
    """
    second = F.try_to_timestamp(F.concat(F.substring(text, 1, 19), F.regexp_extract(text, r"(Z|[+-]\d{2}:\d{2})$", 1)), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    fraction = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0").cast("long")
    at_ns = F.unix_seconds(second) * 1_000_000_000 + F.coalesce(fraction, F.lit(0))
    read = F.array(F.when(text.rlike(RFC3339), at_ns))  # read once, as a variable: each use of an expression works it out again
    named = lambda ns: F.when(ns.isNotNull(), F.struct(F.timestamp_micros(floor_div(ns, 1000)).alias("at"), ns.alias("at_ns"), text.rlike(r"(?:Z|[+-]00:00)$").alias("utc")))
    return F.get(F.transform(read, named), F.lit(0))


def sha_bucket(value: Column, buckets: int = 100) -> Column:
    """First 8 bytes of sha256 as an unsigned number, modulo ``buckets``."""
    return _be64(F.sha2(value, 256), buckets)


def _be64(digest: Column, buckets: int) -> Column:
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % buckets).cast("int")


def hmac_sha256(key: bytes, value: Column) -> Column:
    """Lower-case hex HMAC-SHA256 from two hashes over padded keys; the key is a literal of the plan."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def split_for(digest: Column, train: int = 80) -> Column:
    """'train' for ``train`` in a hundred of a hex digest's first 8 bytes, else 'test'."""
    return F.when(_be64(digest, 100) < train, "train").otherwise("test")


def sigmoid(x: Column) -> Column:
    """Logistic function, by the form that cannot overflow."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def quantised(feature: str, x: Column) -> Column:
    step = HASH_QUANTA.get(feature)
    return F.floor(x / step) * step if step else x


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct<low, high> of the Wilson score interval; null without trials."""
    p = hits / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = (z / (1 + z * z / n)) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), middle - half).alias("low"), F.least(F.lit(1.0), middle + half).alias("high")))


def family_keys(category: Column, subject: Column) -> Column:
    """Scenario families of a labelled subject: two categories by name, and churn from the third incarnation of its chain on."""
    number = F.regexp_extract(subject, r"^acct_gen_churn_[a-z0-9]+_\d+_(\d+)$", 1).try_cast("int")
    named = F.when(category.isin("burst", "dormant_then_blast"), category)
    return F.array_compact(F.array(named, F.when(category.startswith("churn_") & (number >= 3), "churn_incarnation_ge3")))


def reason(features: dict[str, Column]) -> Column:
    """One line of the eleven features that say most, counts without decimals."""
    shown = (
        "core.resource_velocity_1h", "core.credential_velocity_1h", "core.declines_before_first_success", "core.first_funding_prepaid", "brand.name_match",
        "brand.name_has_at", "email.self_send_before_external", "core.linked_deleted_n", "core.linked_labelled_abusive_n", "core.fingerprint_seen_on_other_subjects",
        "core.burst_ratio_24h_vs_lifetime",
    )
    template = " ".join(f"{name}=%.{2 if name.endswith('lifetime') else 0}f" for name in shown)
    return F.format_string(template, *[features[name] for name in shown])

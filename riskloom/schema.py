"""The data model: event columns, feature names and the fixed values that rules and checks share."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

HOUR_NS = 3_600_000_000_000
DAY_NS = 24 * HOUR_NS
MINUTE_NS = 60_000_000_000

LINK_KINDS = ("email_hash", "card_fingerprint_hash", "ip24_hash", "asn", "ua_hash", "device_hash")
DEFAULT_NEIGHBOUR_KINDS = ("email_hash", "card_fingerprint_hash", "device_hash")
CARD_KIND = "card_fingerprint_hash"

_S, _D, _B = T.StringType(), T.DoubleType(), T.BooleanType()

#: Fields of an event's data, by event type (fixed values: the event vocabulary). max: bytes kept of a text.
DATA_FIELDS: dict[str, dict[str, dict]] = {
    "subject.created": {"channel": {"max": 64}, "email_domain_class": {"max": 32, "enum": ("webmail", "corporate", "disposable", "unknown")}, "identity_kind": {"max": 64}, "account_created_at": {"format": "rfc3339"}},
    "subject.deleted": {"mode": {"max": 16, "enum": ("trash", "permanent")}},
    "payment.attempt": {
        "outcome": {"max": 32, "enum": ("succeeded", "declined", "blocked")},
        "reason": {"max": 128},
        "funding": {"max": 16, "enum": ("prepaid", "debit", "credit", "unknown")},
        "amount_minor": {"kind": "number"},
        "currency": {"max": 8},
    },
    "subscription.changed": {"plan": {"max": 64}, "status": {"max": 32}, "amount_minor": {"kind": "number"}},
    "resource.created": {"kind": {"max": 32}, "name": {"max": 200, "skeleton": True}, "address_domain": {"max": 253}},
    "resource.deleted": {"kind": {"max": 32}, "name": {"max": 200, "skeleton": True}, "address_domain": {"max": 253}},
    "content.sent": {
        "subject_line": {"max": 200, "skeleton": True, "mask_email": True},
        "recipient_domain": {"max": 253},
        "recipient_count": {"kind": "number", "positive_integer": True},
        "recipient_hash": {"format": "recipient_hash"},
        "recipient_is_own_identity": {"kind": "bool"},
        "first_link_host": {"max": 253},
    },
    "content.verdict": {"source": {"max": 64}, "category": {"max": 64}, "score": {"kind": "number"}},
    "subject.class": {"class": {"max": 32, "enum": ("customer", "internal", "synthetic")}},
}
FIELD_KIND = {name: spec.get("kind", "text") for fields in DATA_FIELDS.values() for name, spec in fields.items()}
DATA_TYPES = {name: {"text": _S, "number": _D, "bool": _B}[kind] for name, kind in FIELD_KIND.items()}

#: Columns of the event log in analytic form; nanoseconds stand beside the timestamp because Spark keeps microseconds.
EVENTS = T.StructType(
    [T.StructField(c, _S) for c in ("tenant", "producer", "id", "subject", "type")]
    + [T.StructField("at", T.TimestampType()), T.StructField("at_ns", T.LongType())]
    + [T.StructField(c, _S) for c in LINK_KINDS]
    + [T.StructField(c, t) for c, t in DATA_TYPES.items()]
    + [T.StructField("label", _S)]
)

#: Feature order (fixed values); sums of weighted features run in this order.
FEATURES = (
    "core.subject_age_h",
    "core.resource_velocity_1h",
    "core.resource_total",
    "core.credential_velocity_1h",
    "core.credential_total",
    "core.upgrade_delay_min",
    "core.upgraded",
    "core.declines_before_first_success",
    "core.first_funding_prepaid",
    "brand.name_match",
    "brand.name_has_at",
    "email.first_day_distinct_domains",
    "email.self_send_before_external",
    "core.linked_deleted_n",
    "core.linked_labelled_abusive_n",
    "core.fingerprint_seen_on_other_subjects",
    "core.neighbors_truncated",
    "core.burst_ratio_24h_vs_lifetime",
    "email.sends_10m_max",
    "email.sends_1h",
    "email.sends_first_day",
    "email.webmail_recipient_share",
    "email.webmail_sends_1h",
    "email.distinct_recipients_1h",
    "email.subject_brand_match",
)
#: Steps to which features are rounded down in input hashes; the others count exactly.
HASH_QUANTA = {"core.subject_age_h": 1.0, "core.upgrade_delay_min": 60.0}


def column(feature: str) -> str:
    """Feature names hold a dot; their columns do not."""
    return feature.replace(".", "__")


FEATURE_COLUMNS = tuple(column(f) for f in FEATURES)


@dataclass(frozen=True)
class WeightSet:
    version: str
    benign_label: str
    bias: float
    weights: dict[str, float]


#: Logistic weights of the local scorer (fixed values).
LOCAL_WEIGHTS = WeightSet(
    "v2",
    "benign",
    -4.5,
    {
        "core.subject_age_h": -0.02,
        "core.resource_velocity_1h": 0.35,
        "core.resource_total": 0.02,
        "core.credential_velocity_1h": 0.35,
        "core.credential_total": 0.02,
        "core.upgrade_delay_min": -0.0005,
        "core.upgraded": 1.3,
        "core.declines_before_first_success": 0.6,
        "core.first_funding_prepaid": 0.9,
        "brand.name_match": 2.0,
        "brand.name_has_at": 0.5,
        "email.first_day_distinct_domains": 0.25,
        "email.self_send_before_external": 0.8,
        "core.linked_deleted_n": 1.3,
        "core.linked_labelled_abusive_n": 1.5,
        "core.fingerprint_seen_on_other_subjects": 1.0,
        "core.neighbors_truncated": 0.3,
        "core.burst_ratio_24h_vs_lifetime": 0.3,
        "email.sends_10m_max": 0.08,
        "email.sends_1h": 0.002,
        "email.sends_first_day": 0.0008,
        "email.webmail_recipient_share": 1.1,
        "email.webmail_sends_1h": 0.006,
        "email.distinct_recipients_1h": 0.0025,
        "email.subject_brand_match": 1.5,
    },
)


@dataclass(frozen=True)
class Rule:
    name: str
    mode: str = "advise"
    scorer: str = "local"
    inputs: tuple[str, ...] = FEATURES
    text: tuple[str, ...] = ()
    labels: tuple[str, ...] = ("benign", "suspicious", "abusive")
    benign_label: str = "benign"
    threshold: float = 0.6
    stage: dict[str, float] = field(default_factory=dict)

    @property
    def text_only(self) -> bool:
        return bool(self.text) and not self.inputs


@dataclass(frozen=True)
class CombineParams:
    medium: float = 0.4
    high: float = 0.8
    min_scored_advise: int = 1
    text_needs_support: bool = True

    @property
    def valid(self) -> bool:
        return 0 < self.medium <= 1 and 0 < self.high <= 1 and self.high > self.medium


NEW_ACCOUNT_RULE = Rule("new_account_velocity")

#: Brands: name, aliases, case-sensitive (fixed values).
BRANDS = (
    ("Bank of America", (), False), ("Binance", (), False), ("Coinbase", (), False), ("PayPal", ("Pay Pal",), False), ("Wells Fargo", (), False),
    ("Amazon", (), False), ("Walmart", (), False), ("DHL", (), False), ("FedEx", (), False), ("USPS", (), False), ("Netflix", (), False),
    ("Apple", (), False), ("Google", (), False), ("Microsoft", (), False), ("Stripe", (), False), ("Depop", (), False), ("eBay", (), False),
    ("Etsy", (), False), ("Mercari", (), False), ("Poshmark", (), False), ("Shopify", (), False), ("Vinted", (), False), ("Facebook", (), False),
    ("Instagram", (), False), ("TikTok", ("Tik Tok",), False), ("WhatsApp", ("What's App",), False), ("Airbnb", (), False), ("Booking.com", (), False),
    ("Australia Post", (), False), ("Canada Post", (), False), ("DPD", (), False), ("Evri", (), False), ("PostNL", ("Post NL",), False),
    ("Royal Mail", (), False), ("UPS", (), True),
)

#: Webmail domains (fixed values).
WEBMAIL = (
    "gmail.com googlemail.com outlook.com outlook.de outlook.fr hotmail.com hotmail.co.uk hotmail.de hotmail.es hotmail.fr hotmail.it live.com live.co.uk "
    "live.fr msn.com yahoo.com yahoo.co.uk yahoo.com.br yahoo.de yahoo.es yahoo.fr yahoo.co.jp ymail.com icloud.com me.com mac.com aol.com protonmail.com "
    "proton.me pm.me gmx.com gmx.net gmx.de t-online.de mail.com zoho.com yandex.com yandex.ru mail.ru qq.com 163.com 126.com naver.com web.de libero.it"
).split()

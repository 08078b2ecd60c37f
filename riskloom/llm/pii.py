"""PII: format-preserving Feistel pseudonyms, in DataFrame expressions only.

Values are found by one pattern, validated by kind, and permuted by a keyed Feistel network over their own symbols: each
round shifts every other symbol, modulo its radix, by a keyed hash of the symbols between. A round can be undone, so the
network is a permutation of the values of that format; equal values have equal pseudonyms in every document and
different values different ones. What the pseudonym keeps:

- card numbers (Luhn-checked): separators, length, first digit; the check digit is recomputed, so it is valid again
- social security numbers: valid area, group and serial
- phone numbers (ten digits in groups, or a plus and 8 to 15 digits): punctuation, country code, and whether the first
  digit, and the fourth of ten, is 2 to 9. The digits behind the country code are permuted as one number, so a number has
  one pseudonym however it is written. Ten digits without any mark are not taken for a phone number
- IBANs (checked modulo 97): country, length, letters and digits in place; the check digits are recomputed. Spaces take no
  part, so an account has one pseudonym however it is spaced
- IPv4 addresses: four octets
- dates (ISO, or day, month and year by '/' or '.'): a calendar day of the years 1800 to 2199 in the same notation
- e-mail addresses: domain, and letters, digits and dots of the name
- access keys and passwords in assignments: the prefix, and letters and digits in place

Checks by kind: Luhn, modulo 97, octets below 256, days of the calendar, areas and serials in use, no empty part in a
mail's name and two letters at the end of its domain. For secrets and phone numbers, whose areas no rule settles, the
pattern is the check. Values that fail are left alone. The key is a parameter; without one it is the session's ``KEY_CONF``, and
where that is unset, too, nothing is masked: it raises. ``EXAMPLE_KEY`` is for queries and tests and keeps nothing secret.

Null text stays null with nothing found; empty and very long texts are as any other (every pattern starts at a boundary
and repeats possessively, so the scan is linear); repeated rows are masked alike; an input column ``found`` is kept as
``in_found``; ids are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let
from .storage import make_room, table

KEY_CONF = "spark.riskloom.pseudonym.key"
EXAMPLE_KEY = "pseudonym-key-1"
ROUNDS = 8

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:(?<![A-Za-z0-9_])(?:password|passwd|secret|token|api_key) ?= ?\"?)[A-Za-z0-9_-]{6,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d(?:[ .-]?\(?\d\)?){7,14}+(?![\d-])|(?<![\d+])(?:\+\d{1,2}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}+(?![\d-]?\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_HINT = "[0-9@=]|AKIA"  # every value of PATTERNS has one of these
_DAYS = 146_097  # of the 400 years from 1800; 189 * 773
_FROM = "1800-01-01"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit undoubled."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, j: let(c.cast("int"), lambda d: F.when(j % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def feistel(values: Column, radices: Column, kind: str, key: str = EXAMPLE_KEY) -> Column:
    """Keyed permutation of array<int> ``values``, each below its radix, over the product of the radices."""

    def one_round(v: Column, r: Column) -> Column:
        others = F.filter(F.transform(v, lambda x, j: F.when(j % 2 != r % 2, x)), lambda x: x.isNotNull())
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), F.size(v).cast("string"), F.array_join(others, ",")), 256)
        shift = lambda d, j: F.conv(F.substring(d, (j % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return let(digest, lambda d: F.transform(v, lambda x, j: F.when(j % 2 == r % 2, (x + shift(d, j) + (j / 16).cast("int") * 7) % F.get(radices, j)).otherwise(x)))

    def alone(v: Column) -> Column:
        ranked = F.transform(F.sequence(F.lit(0), F.array_max(radices) - 1), lambda i: F.struct(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit("one"), i.cast("string")), 256).alias("by"), i.alias("i")))
        return let(F.sort_array(ranked), lambda t: F.transform(v, lambda x, j: F.when(F.get(radices, j) > 1, F.get(t, x)["i"]).otherwise(x)))

    # one symbol has nothing to be shifted by: its values are ranked by their keyed hashes instead
    one = F.size(F.filter(radices, lambda r: r > 1)) == 1
    return F.when(one, alone(values)).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one_round))


def _by_symbol(text: Column, kind: str, key: str, lead: tuple[int, ...] = ()) -> Column:
    """Permute the digits and letters of ``text`` in place. ``lead``: places of digits that keep to 0-1 or 2-9."""
    chars = F.split(text, "")

    def radix(c: Column, j: Column) -> Column:
        digit = F.when(j.isin(*lead), F.when(c >= "2", 8).otherwise(2)).otherwise(10) if lead else F.lit(10)
        return F.when(c.between("0", "9"), digit).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)

    def base(c: Column, j: Column) -> Column:
        digit = F.when(j.isin(*lead) & (c >= "2"), 50).otherwise(48) if lead else F.lit(48)
        return F.when(c.between("0", "9"), digit).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))

    def build(parts: Column) -> Column:
        moved = feistel(F.transform(parts, lambda p: p["value"]), F.transform(parts, lambda p: p["radix"]), kind, key)
        return let(moved, lambda v: F.array_join(F.transform(parts, lambda p, j: F.when(p["radix"] == 1, p["char"]).otherwise(F.char(p["base"] + F.get(v, j)))), ""))

    parts = F.transform(chars, lambda c, j: F.struct(c.alias("char"), radix(c, j).alias("radix"), base(c, j).alias("base"), F.when(radix(c, j) == 1, 0).otherwise(F.ascii(c) - base(c, j)).alias("value")))
    return let(parts, build)


def _refill(pattern: Column, symbols: Column, place=lambda c: c.between("0", "9")) -> Column:
    """Put ``symbols`` in the places of the digits (by default) of ``pattern``."""

    def step(acc: Column, c: Column) -> Column:
        here = place(c)
        return F.struct(F.concat(acc["out"], F.when(here, F.substring(symbols, acc["at"], F.lit(1))).otherwise(c)).alias("out"), (acc["at"] + here.cast("int")).alias("at"))

    return F.aggregate(F.split(pattern, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step)["out"]


def _card(m: Column, key: str) -> Column:
    def build(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _by_symbol(F.substring(d, F.lit(2), F.length(d) - 2), "card", key))
        return let(body, lambda b: _refill(m, F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string"))))

    return let(_digits(m), build)


def _ssn(m: Column, key: str) -> Column:
    p = F.split(m, "-")
    area = F.get(p, 0).cast("int")
    values = F.array(area - 1 - (area > 666).cast("int"), F.get(p, 1).cast("int") - 1, F.get(p, 2).cast("int") - 1)
    moved = feistel(values, F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key)
    return let(moved, lambda v: F.concat(F.lpad((F.get(v, 0) + 1 + (F.get(v, 0) >= 665).cast("int")).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.get(v, 1) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.get(v, 2) + 1).cast("string"), 4, "0")))


def _ip(m: Column, key: str) -> Column:
    values = F.transform(F.split(m, "\\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(feistel(values, F.array(*[F.lit(256)] * 4), "ip", key), lambda x: x.cast("string")), ".")


#: Country codes of one and two digits (fixed values); all others have three.
COUNTRY_CODE = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _national(m: Column) -> Column:
    """A phone number without its country code."""
    return F.regexp_replace(m, rf"^\+{COUNTRY_CODE}[ .-]?", "")


def _phone(m: Column, key: str) -> Column:
    rest = _national(m)
    made = let(_digits(rest), lambda d: _refill(rest, F.when(F.length(d) == 10, _by_symbol(d, "phone", key, lead=(0, 3))).otherwise(_by_symbol(d, "phone", key, lead=(0,)))))
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(rest)), made)


def _email(m: Column, key: str) -> Column:
    return F.concat(_by_symbol(F.substring_index(m, "@", 1), "email", key), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    prefix = F.regexp_extract(m, r'^(?:AKIA|[A-Za-z_]+ ?= ?"?)', 0)
    return F.concat(prefix, _by_symbol(F.substring(m, F.length(prefix) + 1, F.length(m)), "secret", key))


def _iban_rest(country: Column, check: str | Column, account: Column) -> Column:
    """Account, country and check digits as one number, modulo 97; letters count from 10."""
    check = F.lit(check) if isinstance(check, str) else check

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(F.concat(account, country, check), ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    rest = F.substring(m, F.lit(5), F.length(m))

    def build(account: Column) -> Column:
        country = F.substring(m, 1, 2)
        check = F.lpad((98 - _iban_rest(country, "00", account)).cast("string"), 2, "0")
        return F.concat(country, check, _refill(rest, account, lambda c: c != " "))

    return let(_by_symbol(F.replace(rest, F.lit(" "), F.lit("")), "iban", key), build)


def _day(m: Column) -> Column:
    """The date of a match, null if there is none: ISO, or the day first, or the month first if only that is a date."""
    iso = F.try_to_date(m, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    p = F.split(m, "[/.]")
    part = lambda j: F.lpad(F.get(p, j), 2, "0")
    made = lambda a, b: F.try_to_timestamp(F.concat_ws("-", F.get(p, 2), part(a), part(b)), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.length(m) < 8, None).when(m.contains("-"), iso).otherwise(F.coalesce(made(1, 0), F.when(m.contains("/"), made(0, 1))))


def _date(m: Column, key: str) -> Column:
    n = F.datediff(_day(m), F.lit(_FROM).cast("date"))
    moved = feistel(F.array((n / 773).cast("int"), n % 773), F.array(F.lit(189), F.lit(773)), "date", key)

    def show(v: Column) -> Column:
        day = F.date_add(F.lit(_FROM).cast("date"), F.get(v, 0) * 773 + F.get(v, 1))
        separator = F.when(m.contains("/"), "/").otherwise(".")
        padded = F.length(F.regexp_extract(m, r"^\d+", 0)) == 2
        first = F.split(m, "[/.]")
        month_first = F.get(first, 1).cast("int") > 12
        parts = lambda d, mo: F.when(month_first, F.concat_ws("|", mo, d)).otherwise(F.concat_ws("|", d, mo))
        # the day, or the month where only that can be, leads; a leading number of one digit stays unpadded where it can
        lead = F.when(padded, parts(F.date_format(day, "dd"), F.date_format(day, "MM"))).otherwise(parts(F.date_format(day, "d"), F.date_format(day, "M")))
        return F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.replace(lead, F.lit("|"), separator), separator, F.date_format(day, "yyyy")))

    return let(moved, show)


_VALID = {
    "email": lambda m: ~m.rlike(r"^\.|\.\.|\.@") & m.rlike("[A-Za-z]{2}$"),
    "secret": lambda m: F.lit(True),
    "iban": lambda m: let(F.replace(m, F.lit(" "), F.lit("")), lambda x: _iban_rest(F.substring(x, 1, 2), F.substring(x, 3, 2), F.substring(x, F.lit(5), F.length(x))) == 1),
    "ip": lambda m: F.forall(F.split(m, "\\."), lambda x: x.cast("int") < 256),
    "date": lambda m: F.coalesce(_day(m).between("1800-01-01", "2199-12-31"), F.lit(False)),
    "ssn": lambda m: ~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$"),
    "phone": lambda m: F.lit(True),
    "card": lambda m: _luhn(_digits(m)) % 10 == 0,
}
_MAKE = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(text: Column, key: str = EXAMPLE_KEY) -> Column:
    """struct<text string, found array<struct<kind, value, pseudonym>>> of a text."""

    def replaced(m: Column) -> Column:
        out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"), m.alias("pseudonym"))
        for kind in reversed(PATTERNS):
            here = m.rlike(f"^(?:{PATTERNS[kind]})$") & _VALID[kind](m)
            out = F.when(here, F.struct(F.lit(kind).alias("kind"), m.alias("value"), _MAKE[kind](m, key).alias("pseudonym"))).otherwise(out)
        return out

    matches = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)

    def build(found: Column) -> Column:
        pieces = F.split(text, ANY, -1)
        joined = F.array_join(F.transform(pieces, lambda p, j: F.concat(p, F.coalesce(F.get(found, j)["pseudonym"], F.lit("")))), "")
        return F.struct(joined.alias("text"), F.filter(found, lambda x: x["kind"].isNotNull()).alias("found"))

    none = F.struct(text.alias("text"), F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>").alias("found"))
    return F.when(F.coalesce(text.rlike(_HINT), F.lit(False)), let(matches, build)).otherwise(none)


def mask_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with ``text`` pseudonymised under ``key`` and ``found`` (kind, value, pseudonym) added."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, None)
    if not key:
        raise ValueError(f"give a key, or set {KEY_CONF}")
    docs = make_room(docs, "found").withColumn("__pii", pseudonymise(F.col("text"), key))
    return docs.withColumns({"text": F.col("__pii.text"), "found": F.col("__pii.found")}).drop("__pii")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, None) or EXAMPLE_KEY
    masked = mask_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return masked.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("found").cast("long").alias("n_found"),
        *[count(kind).alias(f"n_{kind}") for kind in PATTERNS],
        F.array_join(F.transform("found", lambda x: x["pseudonym"]), "\n").alias("pseudonyms"),
        F.sha2("text", 256).alias("masked_sha256"),
    )

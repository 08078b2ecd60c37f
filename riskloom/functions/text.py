"""Text functions: NFKC, look-alike skeletons, tokens and brand matching.

Spark has no Unicode normalisation, so one Arrow function each for NFKC and for the skeleton runs Python's, and only for
texts that are not ASCII, or hold digits (skeletons). All the rest, brands too, are Spark's own expressions. Brands
match on distinct texts: each text is tokenised once, whatever the number of events that carry it.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import BRANDS
from .words import lookup

#: E-mail shape after NFKC (fixed value).
_LOCAL, _DOMAIN = r"[\p{L}\p{N}._%+\-]", r"@[\p{L}\p{N}.\-]+\.[\p{L}]{2,}"
#: Whether there is one: its last character before the @ will do. A run of them, tried from each of its characters, would
#: take the square of its length.
EMAIL = _LOCAL + _DOMAIN
#: All of it, from the start of its run or where the match before ended.
_WHOLE_EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{_DOMAIN}"
CONTROL = r"\p{Cc}"

#: Look-alikes and the Latin letters that they stand for (fixed values): Cyrillic, Greek, digits and signs.
LOOKALIKES = str.maketrans("аеорсухіѕјԁѡ" + "αορνκ" + "03457" + "$@", "aeopcyxisjdw" + "aopvk" + "oeast" + "sa")
_LEET = set("03457")

#: Words that mark a name as an integration (fixed values).
INTEGRATION_WORDS = ("integration", "webhook", "sync", "relay", "notifier", "tracking", "bot", "connector", "api", "import", "export")
#: Phrases that mark a subject line as a community's (fixed values).
COMMUNITY_PHRASES = ("group meetup", "fan club", "community event")

_DIGITS = re.compile(r"[0-9]+")


def _letters_beside(text: str, start: int, end: int) -> int:
    """Letters directly beside a stretch, of two on either side."""
    before, after = text[max(start - 2, 0) : start][::-1], text[end : end + 2]
    return sum(side[:1].isalpha() + (side[:1].isalpha() and side[1:].isalpha()) for side in (before, after))


class _PerCharacter(dict):
    """A table for ``str.translate`` that is filled as characters come."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, code: int):
        self[code] = self.of(chr(code))
        return self[code]


def _fold(c: str) -> str:
    if c in "Iı":
        return "l"
    low = c.lower() if len(c.lower()) == 1 else unicodedata.normalize("NFD", c.lower())[0]
    return low if low in _LEET else low.translate(LOOKALIKES)


_FOLDED = _PerCharacter(_fold)
_UNMARKED = _PerCharacter(lambda c: None if unicodedata.category(c) == "Mn" else c)
_SPELLED = str.maketrans("103457", "loeast")


def _spell(digits: re.Match) -> str:
    return digits[0].translate(_SPELLED) if _letters_beside(digits.string, *digits.span()) >= 2 else digits[0]


def skeleton_of(text: str) -> str:
    """Latin skeleton of a text: compatibility forms, accents and look-alikes folded, lower-case, single spaces.

    Digits stand for letters only in a run of digits with two letters or more directly beside it. Capital I, dotless i
    and such a 1 become l before lower-casing.
    """
    if not text.isascii():
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)).translate(_UNMARKED)
        text = unicodedata.normalize("NFC", text)
    return " ".join(_DIGITS.sub(_spell, text).translate(_FOLDED).split())


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pa.array((unicodedata.normalize("NFKC", x.as_py()) if x.is_valid else None for x in texts), pa.string(), size=len(texts))


@F.arrow_udf(T.StringType())
def _skeleton(texts: pa.Array) -> pa.Array:
    return pa.array((skeleton_of(x.as_py()) if x.is_valid else None for x in texts), pa.string(), size=len(texts))


def _where_needed(plain: Column, text: Column, folded: Column, function) -> Column:
    """``folded`` where a text is ``plain``, else the Arrow function of it. Spark evaluates such a function for every row, so
    plain texts go to it as nulls."""
    return F.when(plain, folded).otherwise(function(F.when(~plain, text)))


def nfkc(text: Column) -> Column:
    return _where_needed(text.rlike(r"^\p{ASCII}*$"), text, text, _nfkc)


def skeleton(text: Column) -> Column:
    """Skeletons; printable ASCII without digits folds by built-in functions, all else by one Arrow function."""
    plain = F.trim(F.regexp_replace(F.lower(F.translate(text, "I$@", "lsa")), r"\s+", " "))
    return _where_needed(text.rlike(r"^[\x20-\x2F\x3A-\x7E\t\n\x0B\f\r]*$"), text, plain, _skeleton)


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(nfkc(text), _WHOLE_EMAIL, "@")


def looks_like_email(text: Column) -> Column:
    return nfkc(text).rlike(EMAIL)


def truncate_utf8(text: Column, most: int) -> Column:
    """The longest prefix of whole characters in at most ``most`` bytes."""
    head = F.substring(text, 1, most)  # no more characters than bytes
    fits = F.aggregate(
        F.split(head, ""),
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda acc, c: F.struct((acc["bytes"] + F.octet_length(c)).alias("bytes"), (acc["chars"] + (acc["bytes"] + F.octet_length(c) <= most).cast("int")).alias("chars")),
    )["chars"]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(head, F.lit(1), fits))


def canonical(text: Column) -> Column:
    """A skeleton without format characters and with i as l, the form in which words are compared."""
    return F.translate(F.regexp_replace(text, r"\p{Cf}", ""), "i", "l")


_SEPARATOR = r"[\s\p{P}\p{S}]+"


def tokenise(skeleton_text: Column) -> Column:
    return F.filter(F.split(canonical(skeleton_text), _SEPARATOR), lambda x: x != "")


def camel(text: Column) -> Column:
    """A space at each change from lower case or digit to upper case."""
    return F.regexp_replace(text, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", " ")


def _canonical_words(text: str) -> list[str]:
    """Words of a configured text, as ``tokenise`` gives them for a column."""
    folded = "".join(c for c in skeleton_of(text) if unicodedata.category(c) != "Cf").replace("i", "l")
    return "".join(" " if unicodedata.category(c)[0] in "PSZ" else c for c in folded).split()


def brand_words(brands=BRANDS) -> dict[str, list[tuple[str, str | None]]]:
    """Words of every name and alias, to (brand, spelling that a case-sensitive name needs)."""
    out: dict[str, list[tuple[str, str | None]]] = {}
    for name, aliases, sensitive in brands:
        for spelled in (name, *aliases):
            if words := _canonical_words(spelled):
                entry = (name, name if sensitive and spelled == name else None)
                out.setdefault(" ".join(words), []).append(entry)
    return out


def listed_brands(brands: DataFrame) -> list[tuple[str, tuple[str, ...], bool]]:
    """A table (name, aliases, case_sensitive), as ``jsonl.read_brands`` gives it, in the form of ``BRANDS``."""
    return [(r["name"], tuple(r["aliases"] or ()), bool(r["case_sensitive"])) for r in brands.select("name", "aliases", "case_sensitive").orderBy("name").toLocalIterator()]


def _runs(tokens: Column, n: int) -> Column:
    """All runs of n consecutive words; what there is if the text has fewer."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))


#: Phrases that a plan holds as literals.
LITERAL_WORDS = 200
_ENTRY = "struct<brand:string,exact:string>"


def _brand_literals(listed: dict, longest: int):
    known = F.array(*[F.lit(w) for w in listed]).cast("array<string>")
    of = {w: F.array(*[F.struct(F.lit(b).alias("brand"), F.lit(e).cast("string").alias("exact")).cast(_ENTRY) for b, e in entries]) for w, entries in listed.items()}
    named = F.create_map(*[x for w, entries in of.items() for x in (F.lit(w), entries)]).cast(f"map<string,array<{_ENTRY}>>")

    def entries_of(tokens: Column) -> Column:
        runs = F.flatten(F.array(*[_runs(tokens, n) for n in range(1, longest + 1)]))
        return F.flatten(F.transform(F.array_intersect(runs, known), lambda w: F.element_at(named, w)))

    return entries_of


def _brand_trie(spark: SparkSession, listed: dict):
    phrases = [(tuple(words.split(" ")), {"brand": brand, "exact": exact}) for words, each in listed.items() for brand, exact in each]
    return lookup(spark, phrases, _ENTRY, pa.struct([("brand", pa.string()), ("exact", pa.string())]))


def _phrases(brands: DataFrame) -> DataFrame:
    """(run, brand, exact, n) of a table (name, aliases, case_sensitive): its phrases as ``brand_words`` gives those of a list."""
    names = brands.select("name", F.coalesce("case_sensitive", F.lit(False)).alias("sensitive"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelled"))
    words = names.withColumn("words", tokenise(skeleton(F.col("spelled")))).where(F.size("words") > 0)
    exact = F.when(F.col("sensitive") & (F.col("spelled") == F.col("name")), F.col("name"))
    return words.select(F.array_join("words", " ").alias("run"), F.col("name").alias("brand"), exact.alias("exact"), F.size("words").alias("n")).distinct()


def _joined(spelled: DataFrame, brands: DataFrame, readings: tuple[str, ...]) -> DataFrame:
    """``spelled`` with ``<reading>_entries``, the entries of the table's phrases in it. Runs of the texts' words, of the
    lengths that phrases have, are joined with the phrases, so that no process holds the list."""
    phrases = _phrases(brands)
    lengths = sorted(r["n"] for r in phrases.select("n").distinct().collect())
    named = {f"{c}_entries": f"array<{_ENTRY}>" for c in readings}
    if not lengths:
        return spelled.withColumns({c: F.array().cast(t) for c, t in named.items()})
    spelled = spelled.withColumn("__key", F.sha2("text", 256))
    runs = [F.struct(F.lit(f"{c}_entries").alias("reading"), F.array_distinct(F.flatten(F.array(*[_runs(F.col(c), n) for n in lengths]))).alias("runs")) for c in readings]
    met = spelled.select("__key", F.inline(F.array(*runs))).select("__key", "reading", F.explode("runs").alias("run")).join(phrases.drop("n"), "run")
    entry = F.struct("brand", "exact").cast(_ENTRY)
    each = met.groupBy("__key").agg(*[F.collect_set(F.when(F.col("reading") == c, entry)).alias(c) for c in named])
    return spelled.join(each, "__key", "left").withColumns({c: F.coalesce(c, F.array().cast(t)) for c, t in named.items()}).drop("__key")


def match_brands(texts: DataFrame, brands=BRANDS) -> DataFrame:
    """(text, name_brands, subject_brands, has_integration) for each distinct text of column ``text``.

    A text is read as it stands and with camel-case borders as spaces; gates and brands are applied to each reading by
    itself. A text stays one row. Up to ``LITERAL_WORDS`` phrases are literals of the plan, with which the words' runs of
    their lengths are intersected; longer lists are a broadcast trie of checked size, and the plan does not grow with them.
    ``brands``: as ``BRANDS``, or a table of (name, aliases, case_sensitive), which may have any length: it is joined.
    """
    table = isinstance(brands, DataFrame)
    if not table:
        listed = brand_words(brands)
        longest = max((w.count(" ") + 1 for w in listed), default=1)
        entries_of = _brand_trie(texts.sparkSession, listed) if len(listed) > LITERAL_WORDS else _brand_literals(listed, longest)
    gate = F.array(*[F.lit(" ".join(_canonical_words(w))) for w in INTEGRATION_WORDS])
    phrases = [" ".join(_canonical_words(p)) for p in COMMUNITY_PHRASES]
    none = F.array().cast("array<string>")
    # few distinct texts of many rows would be one partition, and one task would match them all
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = texts.select("text").where(F.col("text").isNotNull()).distinct().repartition(parts)
    spelled = distinct.withColumns({"plain": tokenise(skeleton(F.col("text"))), "split": tokenise(skeleton(camel(F.col("text")))), "original": F.split(nfkc(F.col("text")), _SEPARATOR)})

    readings = ("plain", "split")
    spelled = _joined(spelled, brands, readings) if table else spelled.withColumns({f"{c}_entries": entries_of(F.col(c)) for c in readings})

    def found(entries: Column) -> Column:
        return F.transform(F.filter(entries, lambda e: e["exact"].isNull() | F.array_contains(F.col("original"), e["exact"])), lambda e: e["brand"])

    def social(tokens: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
        out = F.lit(False)
        for phrase in phrases:
            out = out | line.contains(f" {phrase} ")
        return out

    spelled = spelled.withColumns({f"{c}_found": found(F.col(f"{c}_entries")) for c in readings})
    both = lambda closed: F.array_sort(F.array_distinct(F.concat(*[F.when(closed(F.col(c)), none).otherwise(F.col(f"{c}_found")) for c in readings])))
    gated = lambda tokens: F.arrays_overlap(tokens, gate)
    return spelled.select("text", both(gated).alias("name_brands"), both(social).alias("subject_brands"), gated(F.col("plain")).alias("has_integration"))

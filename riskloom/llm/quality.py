"""Quality rules: a table of thresholds compiled into projections of built-in functions, without user functions.

A ``Threshold`` bounds one counted part of a text against another count, in thousandths, so that every comparison is made
with whole numbers. ``compile_rules`` turns a table of them into the array of the names of those that a text breaks; the
table may come from Python or from a (small) DataFrame. Counts and verdict are narrow projections on top of the scan:
nothing is shuffled, and a document's counts depend on its own text alone.

Windows of eight words are found by a 128-bit hash of their words: the first half tells whether anything repeats at all,
and only texts in which something does are sorted.

Defined cases: a null or empty text has no words and no line, all its counts are 0 and it fails; parts of nothing pass
every share; a null id stays null and repeated ids are judged row by row; an empty table gives an empty result. ``rate``
keeps the input's columns, renamed to ``in_<name>`` where it adds one of that name; ``keep`` returns the input's columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import let
from .storage import make_room, table

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30
_SPACE = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_MARKS = ".,;:!?\"'()[]"

#: Frequent words by language. A text of a language without a list needs its own, or a table without that rule.
STOP_WORDS = {
    "de": ("der", "die", "das", "und", "in", "den", "von", "zu", "sich", "mit", "auf", "des", "für", "ist", "nicht", "im", "dem", "ein", "eine", "als"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by", "this", "are", "at", "from"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "no", "con", "su", "una", "es", "para", "al", "lo"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui", "dans", "par", "pas", "au", "sur", "avec"),
}


@dataclass(frozen=True)
class Threshold:
    """``part`` must be at least ``least`` and at most ``most`` thousandths of ``of``; None bounds nothing."""

    name: str
    part: str
    of: str
    least: int | None = None
    most: int | None = None


THRESHOLDS = (
    Threshold("word_length", "word_chars", "n_words", 2000, 12000),
    Threshold("symbols", "n_symbols", "n_words", None, 100),
    Threshold("stop_words", "n_stop_words", "n_words", 60, None),
    Threshold("letters", "n_letter_words", "n_words", 700, None),
    Threshold("upper_case", "n_upper", "n_cased", None, 400),
    Threshold("repeated_lines", "n_dup_lines", "n_lines", None, 400),
    Threshold("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
    Threshold("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_upper", "n_cased", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def thresholds_from(rules: DataFrame) -> tuple[Threshold, ...]:
    """A table (name, part, of, least, most) as thresholds, in order of name; at most a thousand rows."""
    rows = rules.select("name", "part", "of", "least", "most").orderBy("name").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a table of thresholds has at most 1000 rows")
    return tuple(Threshold(*r) for r in rows)


def compile_rules(rules: tuple[Threshold, ...] | list[Threshold], counts: tuple[str, ...] = COUNTS) -> Column:
    """Names of the rules that a row of counts breaks, as an array in the order of the table."""
    found = []
    for rule in rules:
        if rule.part not in counts or rule.of not in counts:
            raise ValueError(f"rule {rule.name} names no count: {rule.part}, {rule.of}")
        part, broken = F.col(rule.part) * 1000, F.lit(False)
        if rule.least is not None:
            broken = broken | (part < rule.least * F.col(rule.of))
        if rule.most is not None:
            broken = broken | (part > rule.most * F.col(rule.of))
        found.append(F.when(broken, rule.name))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def _only(text: Column, characters: str) -> Column:
    """Number of the characters of ``text`` in a class."""
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def _covered(words: Column, first: Column) -> Column:
    """Words inside any of the windows whose hash occurs twice; ``first``: the first halves of the hashes, in order."""
    whole = F.transform(first, lambda a, i: F.struct(a.alias("a"), F.xxhash64(F.lit(1), F.slice(words, i + 1, WINDOW)).alias("b"), i.alias("i")))
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
    places = let(F.sort_array(whole), lambda s: F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"])))
    places = F.sort_array(F.filter(places, lambda i: i.isNotNull()))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end"))
    return F.aggregate(places, start, step, lambda acc: acc["n"])


def counted(docs: DataFrame, stop_words=STOP_WORDS) -> DataFrame:
    """``docs`` with ``COUNTS`` of every whole text, as longs."""
    docs = make_room(docs, *COUNTS)
    text = F.coalesce("text", F.lit(""))
    full = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(_SPACE)) != "")
    # always true, but no expression that a filter on the verdict may be rewritten by: else Spark would put the splitting of
    # the text into the filter, and there into the function of each window
    once = F.monotonically_increasing_id() >= 0
    rows = docs.withColumns({"__words": F.when(once, F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), "__lines": full})
    words, lines, n = F.col("__words"), F.col("__lines"), F.size("__words")
    hashes = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    rows = rows.withColumn("__hashes", hashes)
    repeats = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    listed = sorted({w for each in stop_words.values() for w in each})
    values = {
        "n_words": n,
        "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")),
        "n_symbols": _only(text, _SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(repeats, _covered(words, F.col("__hashes"))).otherwise(0),
        "n_stop_words": F.size(F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(_MARKS))).isin(*listed))) if listed else F.lit(0),
        "n_letter_words": F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))),
        "n_upper": _only(text, "A-Z"),
        "n_cased": _only(text, "A-Za-z"),
        "n_lines": F.size(lines),
        "n_bullet_lines": F.size(F.filter(lines, lambda line: line.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda line: line.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))),
    }
    return rows.withColumns({k: v.cast("long") for k, v in values.items()}).drop("__words", "__lines", "__hashes")


def rate(docs: DataFrame, rules=THRESHOLDS, stop_words=STOP_WORDS) -> DataFrame:
    """``docs`` with its counts, ``base_failed`` (under 20 words, or over 30 in a hundred in repeated windows), ``broken``
    (names of the broken rules) and ``kept``."""
    rows = counted(make_room(docs, "base_failed", "broken", "kept"), stop_words)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumns({"base_failed": failed, "broken": compile_rules(rules)})
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep(docs: DataFrame, rules=THRESHOLDS, stop_words=STOP_WORDS) -> DataFrame:
    """The documents that break no rule, with the input's columns."""
    return rate(docs.select(F.struct("*").alias("row"), "text"), rules, stop_words).where("kept").select("row.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, broken rules and verdict of every whole text of ``documents``."""
    rated = rate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


def _sql_list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _broken_sql(rules) -> str:
    """The broken rules' names of a row of counts in SQL, comma-joined."""
    each = []
    for r in rules:
        bounds = [f"1000 * {r.part} < {r.least} * {r.of}"] if r.least is not None else []
        bounds += [f"1000 * {r.part} > {r.most} * {r.of}"] if r.most is not None else []
        each.append(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(each)})"


OP11_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
twice AS (SELECT doc_id, i, run FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, run) > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS place FROM twice) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(words, lambda x: lower(trim(x, '.,;:!?"''()[]')) IN ({_sql_list(sorted({w for each in STOP_WORDS.values() for w in each}))}))) AS n_stop_words,
  len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
  length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS n_cased, len(lines) AS n_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN covered USING (doc_id)),
r AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_broken_sql(THRESHOLDS)} AS broken FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM r
"""

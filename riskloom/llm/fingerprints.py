"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A text is a sequence of tokens: words (runs of letters and digits) of 24 characters at most, and single characters for all
else: ideographs, punctuation, and every character of a longer run. What a token is depends on the characters around it
alone and on no place in the text, with or without spaces. A k-mer of ``K`` tokens is an anchor when the least of its
inner s-mers (``S`` tokens, by hash) is its first or its last. That depends on the k-mer alone, so equal passages have
equal anchors in any context, and of any ``K - S`` consecutive k-mers one at least is an anchor. Sentinel tokens before
and behind the text give the shortest text anchors.

The fingerprint lists the anchors in order as ``hash:position``. The likeness of two fingerprints is the Jaccard
similarity of their anchor hashes; ``shared_anchors`` pairs positions of a query set with a corpus.

Defined cases: null text is empty; an empty text has the one fingerprint of the sentinels; a null id sorts below all ids;
rows of one id each have their own answer, and the next document of an id is the next smaller distinct id, by its text of
the least hash; a single document is its own next; input columns named ``anchors`` or ``fingerprint`` are kept as
``in_anchors`` and ``in_fingerprint``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .native import let
from .storage import make_room, table, written

K = 8
S = 2
_INNER = K - S + 1
_NO_ID = -(1 << 63)


_WORD = r"[\p{L}\p{M}\p{N}&&[^\p{IsIdeographic}]]"
_TOKEN = rf"(?<!{_WORD}){_WORD}{{1,24}}+(?!{_WORD})|\S"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))


def anchors(text: Column) -> Column:
    """array<struct<pos int, hash long>>; ``hash`` has 40 bits, ``pos`` counts from the first k-mer with sentinels."""
    edge = [F.array(*[F.lit(side * 1000 + j).cast("long") for j in range(K - 1)]) for side in (1, 2)]
    hashed = F.concat(edge[0], F.transform(tokens(text), lambda t: F.xxhash64(t)), edge[1])

    def of_hashes(h: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(S)]))

        def of_pairs(g: Column) -> Column:
            def closed(i: Column) -> Column:
                first, last = F.get(g, i), F.get(g, i + (_INNER - 1))
                inner = [F.get(g, i + j) for j in range(1, _INNER - 1)]
                return F.least(first, last) <= F.least(*inner)

            chosen = F.filter(F.sequence(F.lit(0), F.size(h) - K), closed)
            return F.transform(chosen, lambda i: F.struct(i.cast("int").alias("pos"), F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(K)]), 24).alias("hash")))

        return let(pairs, of_pairs)

    return let(hashed, of_hashes)


def fingerprint(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda a: F.concat(F.lower(F.hex(a["hash"])), F.lit(":"), a["pos"].cast("string"))), " ")


def hashes(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda a: a["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 for two empty ones."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``anchors`` and ``fingerprint`` added."""
    return make_room(docs, "anchors", "fingerprint").withColumn("anchors", anchors(F.coalesce("text", F.lit("")))).withColumn("fingerprint", fingerprint(F.col("anchors")))


def shared_anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, offset, n): how many anchors two documents share at one offset of positions.

    Anchors are joined by hash. Hashes that lie in very many documents belong to copies and boilerplate: collapse those
    first (op5, op9), or the pairs grow with their square.
    """
    a, b = (fingerprints(d).select(F.col("doc_id").alias(f"{side}_id"), F.inline("anchors")).withColumnRenamed("pos", f"{side}_pos") for d, side in ((left, "left"), (right, "right")))
    return a.join(b, "hash").groupBy("left_id", "right_id", (F.col("left_pos") - F.col("right_pos")).alias("offset")).agg(F.count("*").alias("n"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, next, *rest as of next): each key's next smaller key, the smallest key's the largest; ``ids`` is (key, need, pick).

    Keys are dealt into ranges of about equal counts, one for every shuffle partition; inside a range a window finds the
    neighbour, across ranges a table of one row per range does.
    """
    ranges = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(ids.repartitionByRange(ranges, "key").withColumn("range", F.spark_partition_id()), "ranges")
    tops = ranged.groupBy("range").agg(F.max(F.struct("key", "pick")).alias("top"))
    everything = Window.partitionBy(F.lit(1))
    tops = tops.select("range", F.coalesce(F.lag("top").over(everything.orderBy("range")), F.max("top").over(everything)).alias("below"))
    here = F.lag(F.struct("key", "pick")).over(Window.partitionBy("range").orderBy("key"))
    return ranged.withColumn("here", here).join(F.broadcast(tops), "range").select("key", "need", F.coalesce("here", "below").alias("next"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text_head, next_hashes): the start of the next document that each text's edit takes, and the next one's anchors."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(docs["doc_id"], F.lit(_NO_ID))
    ids = docs.groupBy(key.alias("key")).agg(F.max(F.expr("length(text) div 2").cast("int")).alias("need"), F.min(F.xxhash64("text")).alias("pick"))
    wanted = next_ids(ids).select(F.col("next.key").alias("next_key"), F.col("next.pick").alias("pick"), F.col("key").alias("for_key"), "need")
    # Both joins shuffle (doc_id, text) by the same key, so the texts are shuffled once and read twice; the choice among
    # the texts of a repeated id is written so that it does not become a second join key.
    given = docs.join(wanted, key == F.col("next_key")).where(F.xxhash64("text").bitwiseXOR(F.col("pick")) == 0)
    given = given.select("for_key", F.substring("text", F.lit(1), F.col("need")).alias("head"), hashes(anchors(F.col("text"))).alias("next_hashes"))
    given = given.groupBy("for_key").agg(F.first("head").alias("head"), F.first("next_hashes").alias("next_hashes"))
    return docs.join(given, key == F.col("for_key"), "left").select("doc_id", "text", "head", "next_hashes")


def op1_fingerprints(spark, sf_dir: str) -> DataFrame:
    pairs = edited_pairs(table(spark, sf_dir, "documents"))
    half = F.expr("cast(length(text) div 2 as int)")
    pairs = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("head", F.lit(1), half)))
    pairs = pairs.withColumns({"own": anchors(F.col("text")), "other": anchors(F.col("edited"))})
    pairs = pairs.withColumns({"own_hashes": hashes(F.col("own")), "other_hashes": hashes(F.col("other"))})
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("other_hashes")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )

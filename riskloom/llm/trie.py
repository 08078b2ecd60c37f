"""Conversation prefix trie by the van Emde Boas recursion.

A conversation is a sequence of turns, a node is a distinct sequence of first turns. The trie is built by halving depths:

1. Turns become small rows (conversation, place, digest, words); texts are read once. Digests of aligned blocks of 2, 4, 8,
   ... turns are made of the digests of their halves, so that no conversation is ever gathered, however long it is.
2. A piece of the recursion is a tree (named by the node it hangs from, at a depth that is a multiple of 2b) and sequences
   of up to 2b turns in it. Cutting all pieces at half depth b names every cut prefix by the digest of tree and block.
   What lies above a cut goes into the upper trie, once for each distinct cut prefix; what lies below into the lower tree
   that hangs from it. All upper tries and lower forests of a round are cut together in the next one, as b halves down to
   1. A group of copies is one row after the first cut that it reaches, but for the rows that tell where each copy ends.
3. The cuts leave pointers: ``up`` from a node at depth d to its ancestor at d - b, where b is the largest power of two that
   divides d, and ``back`` from it to its ancestors at distances b/2, b/4, ..., 1. Totals are grafted along them: first
   into the roots of ever taller pieces by ``up``, then, from the tallest pieces on, those of a whole lower tree onto the
   ancestors of its root by ``back``. Each round touches half as many nodes as the one before or half as many as the one
   after, so all of them together touch each node a fixed number of times.

All rounds are joins on unique keys and grouped sums with map-side combining; nothing is collected but a few numbers for
a node. The lists of the conversations that end at a node are made of chunks of ``CHUNK`` neighbouring ids and streamed
through SHA-256 in order, because that hash has one state: where many copies end at one node, the chunks of that node
pass through one task, one row a chunk.

Defined cases: rows without a conv_id belong to no conversation and are left out; null role or text is empty; turns are in
order of turn (null first), equal ones in order of role and of the text's digest; repeated rows are turns of their own;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import running_sum
from .storage import table, written

GROUP = 20
CHUNK = 4096
#: What is summed over subtrees: members ending at the node, childless nodes, prefix words of members at their ends, words.
_SUMS = ("ends", "leaves", "end_words", "words")


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 0, digest, words) of every turn, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    # the role's length first, so that no two pairs of role and text look alike
    own = _digest(F.encode(F.concat_ws("/", F.length(role).cast("string"), role, text), "UTF-8"))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), own.alias("digest"), words.alias("words"), F.md5(text).alias("text_md5"))
    rows = running_sum(rows, ["conv_id"], ["turn", "role", "text_md5"], F.lit(1), "at")
    return rows.select("conv_id", (F.col("at") - 1).alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, group: int = GROUP) -> DataFrame:
    """(conv_id, length, pos, digest, words): the first h turns of each conversation replaced by those of its group's first,
    h = crc32(conv_id) % 4; a conversation that is left without turns has one row with length 0 and no pos."""
    own = turns.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, "donor": F.col("conv_id") - F.col("conv_id") % group})
    each = own.groupBy("conv_id").agg(F.first("h").alias("h"), F.first("donor").alias("donor"), F.count("*").alias("n"))
    head = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < 3)).select(F.col("conv_id").alias("donor"), "pos", "digest", "words")
    taken = head.groupBy("donor").agg(F.count("*").alias("had"))
    each = each.join(taken, "donor", "left").withColumn("front", F.least("h", F.coalesce("had", F.lit(0))))
    each = each.withColumn("length", F.col("front") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    first = each.where("front > 0").select("conv_id", "length", "donor", "front").join(head, "donor").where("pos < front").select("conv_id", "length", "pos", "digest", "words")
    rest = own.where("pos >= h").join(each.select("conv_id", "length", "front"), "conv_id")
    rest = rest.select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("front")).alias("pos"), "digest", "words")
    none = each.where("length = 0").select("conv_id", "length", *[F.lit(None).cast(t).alias(c) for c, t in (("pos", "long"), ("digest", "binary"), ("words", "long"))])
    return first.unionByName(rest).unionByName(none)


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """For each level j the digests (conv_id, block, digest) of all full aligned blocks of 2**j turns."""
    found = [turns.select("conv_id", F.col("pos").alias("block"), "digest")]
    for _ in range(1, levels):
        half = lambda k: F.max(F.when(F.col("block") % 2 == k, F.col("digest")))
        pairs = found[-1].groupBy("conv_id", F.floor(F.col("block") / 2).alias("pair")).agg(half(0).alias("a"), half(1).alias("b")).where("a is not null and b is not null")
        found.append(written(pairs.select("conv_id", F.col("pair").alias("block"), _digest("a", "b").alias("digest")), "blocks"))
    return found


_ROOT = bytes(16)


def _cut(pieces: DataFrame, blocks: DataFrame, b: int) -> DataFrame:
    """``pieces`` (tree, start, conv_id, size, goal) with the name of their prefix of ``b`` turns, null where they have none."""
    at = blocks.select("conv_id", (F.col("block") * b).alias("start"), "digest")
    named = pieces.where(F.col("size") >= b).join(at, ["conv_id", "start"]).withColumn("name", _digest("tree", "digest")).drop("digest")
    return named.unionByName(pieces.where(F.col("size") < b).withColumn("name", F.lit(None).cast("binary")))


def build(turns: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, ends, levels) of ``rebuilt`` turns.

    nodes: node, depth, up, conv_id of a member, level (the exponent of the largest power of two in its depth) and back (the
    ancestor at distance 2**k for every k below the level, as a map). ends: (node, conv_id) of every conversation's whole
    sequence. The root, ``_ROOT``, is not among the nodes.
    """
    longest = turns.agg(F.max("length")).first()[0]
    levels = max(1, int(longest or 0).bit_length())
    blocks = _blocks(turns.where("pos is not null"), levels)
    whole = turns.where("pos = 0 or pos is null").select("conv_id", "length")
    root = F.lit(_ROOT)
    ends = [whole.where("length = 0").select(root.alias("node"), "conv_id")]
    nodes, back = [], []
    pieces = whole.where("length > 0").select(root.alias("tree"), F.lit(0).cast("long").alias("start"), "conv_id", F.col("length").alias("size"), F.lit(None).cast("binary").alias("goal"))
    for level in range(levels - 1, -1, -1):
        b = 1 << level
        cut = written(_cut(pieces, blocks[level], b), "cut")
        reached = cut.where("name is not null")
        found = reached.groupBy("name").agg(F.first("tree").alias("up"), F.first("start").alias("start"), F.min("conv_id").alias("conv_id"))
        found = written(found.select(F.col("name").alias("node"), (F.col("start") + b).alias("depth"), "up", "conv_id", F.lit(level).alias("level")), "nodes")
        nodes.append(found)
        # a sequence of an upper trie has a goal, the node at its end, which learns its ancestor here
        back.append(reached.where("goal is not null").select(F.col("goal").alias("node"), F.lit(level).alias("at"), F.col("name").alias("to")))
        ends.append(reached.where((F.col("size") == b) & F.col("goal").isNull()).select(F.col("name").alias("node"), "conv_id"))
        lower = reached.where(F.col("size") > b).select(F.col("name").alias("tree"), (F.col("start") + b).alias("start"), "conv_id", (F.col("size") - b).alias("size"), "goal")
        upper = found.select(F.col("up").alias("tree"), (F.col("depth") - b).alias("start"), "conv_id", F.lit(b).cast("long").alias("size"), F.col("node").alias("goal"))
        pieces = cut.where("name is null").drop("name").unionByName(lower).unionByName(upper)
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    kept = union(nodes)
    pointers = union(back).groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("at", "to"))).alias("back"))
    return kept.join(pointers, "node", "left"), union(ends), levels


def graft(nodes: DataFrame, levels: int, sums: tuple[str, ...], lows: tuple[str, ...]) -> DataFrame:
    """``nodes`` (node, level, up, back, values) with ``sums`` added up over each node's subtree, itself included, and the
    least of ``lows``. The root has level ``levels``."""
    keep = ["level", "up", "back"]
    values = [*sums, *lows]

    def gathered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("node").agg(*[F.max_by(c, F.col("level").isNotNull()).alias(c) for c in keep], *[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in lows])

    def sent(rows: DataFrame, to: Column) -> DataFrame:
        nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep]
        return rows.select(to.alias("node"), *nothing, *values)

    columns = ["node", *keep, *values]
    open_, done = written(nodes.select(*columns), "graft"), {}
    for level in range(levels):  # into the roots of pieces of 2, 4, 8, ... turns
        done[level] = open_.where(F.col("level") == level)
        taller = open_.where(F.col("level") > level).unionByName(sent(done[level], F.col("up")))
        open_ = written(gathered(taller).select(*columns), "graft")
    whole = open_  # the root alone
    for level in range(levels - 1, -1, -1):  # from whole lower trees onto the ancestors of their roots
        onto = sent(whole.where(F.col("back").isNotNull()), F.col("back")[level]).where("node is not null")
        more = written(gathered(done[level].unionByName(onto)).select(*columns), "graft")
        whole = whole.unionByName(more)
    return whole


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node from its chunks in order."""
    node, state = None, None

    def told():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != node:
                if node is not None:
                    yield told()
                node, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if node is not None:
        yield told()


def end_hashes(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the ids that end at each node, ascending and comma-joined."""
    chunks = ends.groupBy("node", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("node").sortWithinPartitions("node", "chunk").select("node", "ids").mapInArrow(_stream_hashes, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of
    (conv_id, length, pos, digest, words), one row for each turn (see ``rebuilt``)."""
    turns = written(turns, "turns")
    spark = turns.sparkSession
    if turns.isEmpty():
        return spark.createDataFrame([], _RESULT)
    nodes, ends, levels = build(turns)
    ends = written(ends, "ends")
    # words of a conversation's first turns, at every place
    along = written(running_sum(turns.where("pos is not null").select("conv_id", "pos", "words"), ["conv_id"], ["pos"], F.col("words"), "prefix_words"), "along")
    at = along.select("conv_id", (F.col("pos") + 1).alias("depth"), "words", "prefix_words")
    nodes = nodes.join(at, ["conv_id", "depth"]).drop("conv_id")
    root = spark.createDataFrame([(bytearray(_ROOT), 0, levels, 0, 0)], "node binary, depth long, level int, words long, prefix_words long")
    nodes = nodes.unionByName(root, allowMissingColumns=True)
    # the parent is the ancestor at distance 1: what ``up`` is at odd depths
    nodes = written(nodes.withColumn("parent", F.when(F.col("level") == 0, F.col("up")).otherwise(F.col("back")[0])), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    here = ends.groupBy("node").agg(F.count("*").alias("ends"), F.min("conv_id").alias("least"))
    nodes = nodes.join(children, "node", "left").join(here, "node", "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends": F.coalesce("ends", F.lit(0))})
    nodes = nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "end_words": F.col("ends") * F.col("prefix_words")})
    nodes = written(nodes, "weighed")
    totals = graft(nodes, levels, _SUMS, ("least",))
    own = nodes.select("node", "depth", "parent", "n_children", F.col("words").alias("own_words"), "prefix_words")
    known = written(own.join(totals.select("node", *_SUMS, "least"), "node"), "totals")
    parents = known.where("n_children > 0").select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    # every member of a subtree counts the words from this node on to its end; each node's first copy is not saved
    saved = F.col("end_words") - F.col("ends") * (F.col("prefix_words") - F.col("own_words")) - F.col("words")
    rows = known.join(parents, "parent", "left").join(end_hashes(ends), "node", "left")
    return rows.select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("ends").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


_RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``, rebuilt with the first turns of their group's first conversation."""
    turns = written(turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "own")
    return prefix_trie(rebuilt(turns))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS pos FROM t),
hh AS (SELECT conv_id, xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda c, x: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, x)), CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT hh.conv_id, 0 AS part, o.pos, o.role, o.text FROM hh JOIN o ON o.conv_id = hh.conv_id - hh.conv_id % 20 AND o.pos < hh.h
  UNION ALL SELECT hh.conv_id, 1, o.pos, o.role, o.text FROM hh JOIN o ON o.conv_id = hh.conv_id AND o.pos >= hh.h),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, role, text FROM r),
p AS (SELECT conv_id, d, md5(string_agg(md5(length(role) || '/' || role || '/' || text), '' ) OVER (PARTITION BY conv_id ORDER BY d)) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM n),
m AS (SELECT conv_id, d, key, w FROM p UNION ALL SELECT conv_id, 0, '', 0 FROM hh),
last AS (SELECT conv_id, max(d) AS depth FROM m GROUP BY conv_id),
node AS (SELECT key, d, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (d = depth), '') AS ids
  FROM m JOIN last USING (conv_id) GROUP BY key, d),
up AS (SELECT c.key, c.d, a.key AS parent FROM node c JOIN m a ON a.conv_id = c.conv_id AND a.d = c.d - 1),
kids AS (SELECT parent AS key, count(*) AS k FROM up GROUP BY parent),
below AS (SELECT a.key, sum((c.n_convs - 1) * c.w) AS saved, count(*) FILTER (kc.k IS NULL) AS leaves FROM node c LEFT JOIN kids kc ON kc.key = c.key JOIN m a ON a.conv_id = c.conv_id AND a.d <= c.d GROUP BY a.key)
SELECT node.conv_id, CAST(node.d AS BIGINT) AS depth, pn.conv_id AS parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.k, 0) AS BIGINT) AS n_children,
  CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, sha256(node.ids) AS ends_sha256
FROM node LEFT JOIN up ON up.key = node.key LEFT JOIN node pn ON pn.key = up.parent LEFT JOIN kids ON kids.key = node.key JOIN below ON below.key = node.key
"""

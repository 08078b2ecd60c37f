"""N-gram Jaccard self-join with signature trees.

1. Equal shingle sets collapse into one class, so exact copies cost one row each.
2. Classes meet through min-hash keys: ``BANDS`` keys of ``ROWS`` minima. A pair at the threshold of 0.8 misses all of
   them with probability (1 - 0.8**5)**48 = 5e-9. With ``exact`` the keys are a prefix instead, the floor(n / 5) + 1 least
   hashes of a set of n: two sets of likeness 0.8 share one of these for certain, at the price of more keys and of blocks
   that common passages join. Keys join each class with the smallest class of the key (never all pairs), and the
   connected components of those links are the blocks.
3. A block is a signature tree: leaves of classes sorted by size, inner nodes with OR-combined token bitmaps (in planes,
   so that tokens that share a bit still count) and size ranges. A dual traversal descends pairs of nodes and prunes a
   pair when its largest possible overlap is below the least overlap that its sizes need, or when all its classes are
   linked already. Two leaves meet with all their bounds at once, and what is left is compared exactly.
4. A block of more than ``block`` classes is cut into parts by size; every pair of parts whose sizes allow a link is a
   task of its own, so that no task holds more than two parts.
5. The links' connected components give the answer.

Defined cases: null text or text without words has an empty set and is linked with nothing; fewer words than a shingle
are one shingle; repeated ids are one node of the graph, each row with its own set; a null id answers with itself; ids may
be of any ordered type; only ``doc_id`` and ``text`` are read, and ``one_of_each`` returns the input's columns unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import tokens as tk
from .storage import table, written

SHINGLE = 5
PERCENT = 80
ROWS, BANDS = 5, 48
BLOCK = 512
LEAF = 16
FAN_OUT = 8
PLANES = 2

_RNG = np.random.default_rng(5)
_MULTIPLY = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, ROWS * BANDS, dtype=np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingle hashes of the slice's rows end to end, row offsets)."""
    for row, count, data, offsets in tk.slices(column):
        words = tk.Words(data, offsets, tk.NON_SPACE, lower=True)
        lengths = np.diff(words.rows)
        start = tk.starts_within(words.rows, SHINGLE)
        owners, values = [np.repeat(np.arange(count), np.maximum(lengths - SHINGLE + 1, 0))], [tk.gram_hashes(words.hashes, start, SHINGLE)]
        for size in range(1, SHINGLE):  # whole texts of fewer words
            short = np.flatnonzero(lengths == size)
            owners.append(short)
            values.append(tk.gram_hashes(words.hashes, words.rows[short], size))
        owner, value = np.concatenate(owners), np.concatenate(values)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(value), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        yield row, value[new], np.searchsorted(owner[new], np.arange(count + 1))


def _minima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, ROWS * BANDS) minima; every row must have a shingle."""
    out = np.empty((len(offsets) - 1, len(_ADD)), np.uint64)
    low = 0
    while low < len(offsets) - 1:  # parts that stay in cache
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + 8192, "right")) - 1)
        high = min(high, len(offsets) - 1)
        part, at = values[offsets[low] : offsets[high]], offsets[low:high] - offsets[low]
        for j in range(len(_ADD)):
            out[low:high, j] = np.minimum.reduceat(part * _MULTIPLY[j] + _ADD[j], at)
        low = high
    return out


def _band_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(min-hash keys end to end, number of keys of each row): ``BANDS``, or none for an empty set."""
    size = np.diff(offsets)
    some = np.flatnonzero(size)
    key = np.zeros((len(some), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
    if len(some):
        minima = _minima(values, np.append(offsets[some], offsets[-1])).reshape(len(some), BANDS, ROWS)
        for r in range(ROWS):
            key = tk.mix(key ^ minima[:, :, r])
    return key.ravel(), (size > 0) * BANDS


def _prefix_keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least hashes end to end, number of each row): as many as a set can lack of another and still be like it, and one."""
    size = np.diff(offsets)
    n = (size > 0) * (size * (100 - PERCENT) // 100 + 1)  # rows are sorted
    at = np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return values[at], n


def _sketches(batches: Iterator[pa.RecordBatch], keys_of=_band_keys) -> Iterator[pa.RecordBatch]:
    """Per row: id, set size, 128-bit set hash and the min-hash keys (none for an empty set), each id as it came."""
    for batch in batches:
        for row, values, offsets in shingle_sets(batch.column(1)):
            n, size = len(offsets) - 1, np.diff(offsets)
            first, second = (np.append(np.uint64(0), np.cumsum(tk.mix(values ^ seed), dtype=np.uint64)) for seed in (np.uint64(0), np.uint64(0x5851F42D4C957F2D)))
            h1, h2 = (tk.signed(x[offsets[1:]] - x[offsets[:-1]]) for x in (first, second))
            key, each = keys_of(values, offsets)
            at = np.append(0, np.cumsum(each)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(tk.signed(key)))
            yield pa.RecordBatch.from_arrays([batch.column(0)[row : row + n], pa.array(size), pa.array(h1), pa.array(h2), keys], ["id", "n", "h1", "h2", "keys"])


class _Node:
    __slots__ = ("children", "high", "low", "members", "planes", "spare", "table")

    def __init__(self, members: np.ndarray, children: list[_Node], low: int, high: int, planes: np.ndarray, spare: int):
        self.members, self.children, self.low, self.high, self.planes, self.spare, self.table = members, children, low, high, planes, spare, None

    @property
    def is_leaf(self) -> bool:
        """A node of single sets."""
        return bool(self.children) and not self.children[0].children

    def stacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Planes, sizes and spare tokens of a leaf's sets, as arrays."""
        if self.table is None:
            self.table = (np.stack([c.planes for c in self.children]), np.array([c.low for c in self.children]), np.array([c.spare for c in self.children]))
        return self.table


class SignatureTree:
    """Dual-traversal similarity join of a block of sorted shingle sets, linking no more than connectivity needs."""

    def __init__(self, sets: list[np.ndarray], leaf: int = LEAF, fan_out: int = FAN_OUT):
        self.sets = sets
        self.parent = list(range(len(sets)))
        largest = max((len(s) for s in sets), default=1)
        self.bits = 1 << min(15, max(9, int(largest * 2 - 1).bit_length()))
        size = np.array([len(s) for s in sets])
        order = np.lexsort(([int(s[0]) if len(s) else 0 for s in sets], size))
        level = [self._leaf(order[k : k + leaf]) for k in range(0, len(order), leaf)]
        while len(level) > 1:
            level = [self._inner(level[k : k + fan_out]) for k in range(0, len(level), fan_out)]
        self.root = level[0] if level else None

    def _planes(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        count = np.bincount((s >> np.uint64(40)).astype(np.int64) & (self.bits - 1), minlength=self.bits)
        packed = np.stack([np.packbits(count > t).view(np.uint64) for t in range(PLANES)])
        return packed, int(np.maximum(count - PLANES, 0).sum())

    def _leaf(self, members: np.ndarray) -> _Node:
        planes, spare = zip(*(self._planes(self.sets[m]) for m in members), strict=True)
        sizes = [len(self.sets[m]) for m in members]
        each = [_Node(members[k : k + 1], [], sizes[k], sizes[k], planes[k], spare[k]) for k in range(len(members))]
        return self._inner(each)

    @staticmethod
    def _inner(children: list[_Node]) -> _Node:
        planes = np.bitwise_or.reduce([c.planes for c in children])
        return _Node(np.concatenate([c.members for c in children]), children, min(c.low for c in children), max(c.high for c in children), planes, max(c.spare for c in children))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def _connected(self, a: _Node, b: _Node) -> bool:
        one = self.find(int(a.members[0]))
        return all(self.find(int(m)) == one for m in a.members) and all(self.find(int(m)) == one for m in b.members)

    @staticmethod
    def possible(a: _Node, b: _Node) -> bool:
        """Can any set of a and any of b overlap enough? 100 i >= 80 (x + y - i) is 9 i >= 4 (x + y)."""
        if 100 * a.high < PERCENT * b.low or 100 * b.high < PERCENT * a.low:
            return False
        most = int(np.bitwise_count(a.planes & b.planes).sum()) + min(a.spare, b.spare)
        return (100 + PERCENT) * most >= PERCENT * (a.low + b.low)

    def similar(self, x: int, y: int) -> bool:
        a, b = self.sets[x], self.sets[y]
        if len(a) > len(b):
            a, b = b, a
        if not len(a):
            return False
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int((b[at] == a).sum())
        return 100 * both >= PERCENT * (len(a) + len(b) - both)

    def _candidates(self, a: _Node, b: _Node) -> list[tuple[int, int]]:
        """Pairs of two leaves' sets that may overlap enough, all bounds of both leaves at once."""
        (p, m, s), (q, n, t) = a.stacked(), b.stacked()
        most = np.bitwise_count(p[:, None] & q[None]).sum((2, 3), dtype=np.int64) + np.minimum.outer(s, t)
        fine = (100 + PERCENT) * most >= PERCENT * np.add.outer(m, n)
        fine &= (100 * m[:, None] >= PERCENT * n[None]) & (100 * n[None] >= PERCENT * m[:, None])
        at = np.argwhere(np.triu(fine, 1) if a is b else fine)
        return list(zip(a.members[at[:, 0]].tolist(), b.members[at[:, 1]].tolist(), strict=True))

    def links(self, across: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that connect what the threshold connects. ``across``: part of each set; links inside a part are known and needless."""
        out: list[tuple[int, int]] = []
        stack = [(self.root, self.root)] if self.root else []
        while stack:
            a, b = stack.pop()
            if not self.possible(a, b):
                continue
            if a.is_leaf and b.is_leaf:
                for x, y in self._candidates(a, b):
                    if (across is None or across[x] != across[y]) and (p := self.find(x)) != (q := self.find(y)) and self.similar(x, y):
                        self.parent[p] = q
                        out.append((x, y))
                continue
            if (a is not b or len(a.members) > 1) and self._connected(a, b):
                continue
            if a is b:
                stack += [(a.children[i], a.children[j]) for i in range(len(a.children)) for j in range(i, len(a.children))]
            elif not a.is_leaf and (len(a.members) >= len(b.members) or b.is_leaf):
                stack += [(c, b) for c in a.children]
            else:
                stack += [(a, c) for c in b.children]
        return out


def _join_block(block: pa.Table) -> pa.Table:
    """Links of one task: a part with itself, or two parts with each other."""
    ids, part = block["rep"], block["part"].to_numpy()
    sets: list[np.ndarray] = []
    for chunk in block["text"].chunks:
        for _, values, offsets in shingle_sets(chunk):
            sets += [values[offsets[k] : offsets[k + 1]] for k in range(len(offsets) - 1)]
    found = SignatureTree(sets).links(part if len(np.unique(part)) > 1 else None)
    return pa.table({end: ids.take(pa.array([pair[k] for pair in found], pa.int64())) for k, end in enumerate(("src", "dst"))})


def _parts(members: DataFrame, block: int) -> DataFrame:
    """(component, rep, part, p, q): members (component, rep, n) cut by size into parts of about ``block``, for every pair
    of parts p <= q whose sizes allow a link. Sizes are counted first, so a large block is never sorted as a whole."""
    sizes = members.groupBy("component", "n").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("component").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumns({"base": F.floor(before / block), "spread": F.ceil(F.col("c") / block)})
    placed = members.join(sizes, ["component", "n"]).withColumn("part", (F.col("base") + F.pmod(F.xxhash64("rep"), F.col("spread"))).cast("int"))
    ranges = placed.groupBy("component", "part").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    p, q = (ranges.select("component", *[F.col(c).alias(f"{c}_{side}") for c in ("part", "low", "high")]) for side in "pq")
    pairs = p.join(q, "component").where(f"part_p <= part_q and 100 * high_p >= {PERCENT} * low_q and 100 * high_q >= {PERCENT} * low_p")
    pairs = pairs.select("component", F.col("part_p").alias("p"), F.col("part_q").alias("q"))
    return placed.join(pairs.withColumn("part", F.explode(F.array_distinct(F.array("p", "q")))), ["component", "part"])


def jaccard_components(docs: DataFrame, block: int = BLOCK, exact: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    sketches = partial(_sketches, keys_of=_prefix_keys if exact else _band_keys)
    docs = docs.select(F.col("doc_id").alias("id"), "text")
    kind = docs.schema["id"].dataType.simpleString()
    rows = written(docs.mapInArrow(sketches, f"id {kind}, n long, h1 long, h2 long, keys array<long>"), "sets")
    known = rows.where("id is not null and n > 0")
    classes = written(known.groupBy("h1", "h2").agg(F.min(F.struct("id", "n", "keys")).alias("x")).select("h1", "h2", F.col("x.id").alias("rep"), "x.n", "x.keys"), "classes")
    keys = classes.select("rep", F.explode("keys").alias("key"))
    common = written(keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("low")).where("c > 1").select("key", "low"), "common")
    near = keys.join(common, "key").select("rep", "low").distinct()
    blocks = written(connected_components(near, "rep", "low"), "blocks")
    members = blocks.join(classes.select("rep", "n"), blocks["node"] == F.col("rep")).select("component", "rep", "n")
    texts = docs.where("id is not null").join(blocks.select(F.col("node").alias("id")), "id", "left_semi")
    texts = texts.groupBy("id", F.xxhash64("text").alias("copy")).agg(F.first("text").alias("text"))
    tasks = _parts(members, block).join(texts, F.col("rep") == F.col("id")).select("component", "p", "q", "rep", "part", "text")
    links = written(tasks.groupBy("component", "p", "q").applyInArrow(_join_block, f"src {kind}, dst {kind}").where("src <> dst"), "links")
    # the other documents of a class hang on its representative
    same = known.select("id", "h1", "h2").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    if known.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        grown = connected_components(links)
        copies = same.join(grown, same["dst"] == grown["node"], "left").select(F.col("src").alias("node"), F.coalesce("component", "dst").alias("component"))
        labels = grown.unionByName(copies)
    else:  # an id with several sets joins their classes
        labels = connected_components(links.unionByName(same))
    out = rows.join(labels, rows["id"] == labels["node"], "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of linked documents: the smallest id; documents without words all stay. Columns unchanged."""
    found = jaccard_components(docs).where("n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias("__drop")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__drop"), "left_anti")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_components(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))


#: Pairs of different sets that share a shingle are counted by joining the shingles; copies meet in their set.
OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS size, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
grams AS (SELECT doc_id, size, p, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM words),
shingles AS (SELECT DISTINCT doc_id, md5(g) AS g FROM grams WHERE p <= greatest(size - 4, 1)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '' ORDER BY g)) AS name FROM shingles GROUP BY doc_id),
reps AS (SELECT name, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY name),
slim AS (SELECT s.doc_id AS rep, r.n, s.g FROM shingles s JOIN reps r ON r.rep = s.doc_id),
links AS (SELECT a.rep AS x, b.rep AS y FROM slim a JOIN slim b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT rep AS x, rep AS y FROM reps UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON b.x = r.y),
comps AS (SELECT x AS rep, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.component_id, d.doc_id) AS BIGINT) AS component_id
FROM d LEFT JOIN sets s ON s.doc_id = d.doc_id LEFT JOIN reps r ON r.name = s.name LEFT JOIN comps c ON c.rep = r.rep
"""

"""Benchmark decontamination by winnowing.

Every run of ``GRAM + KEEP - 1`` (10) consecutive words of either side keeps the minimum of its ``KEEP`` hashes of
``GRAM`` words, so two texts that share 10 words in a row share a kept fingerprint (the winnowing guarantee). Document
fingerprints are joined with the benchmark's, and every hit is extended: the document windows that hold the hit are
compared whole with the benchmark's windows, by hash and then by a 128-bit digest of their words. Items of fewer words
than a window are one window of their own length and are looked up at every position.

The benchmark side is the stated query set: it is cut into blocks of about ``block_words`` words. A benchmark of one block
is a broadcast of that size, and documents stream past it without a shuffle. Of a larger one, every block is a pass of its
own over ids and texts whose result, a row for each document with a hit, is written before the next block is sent, so that
one block at most is held at a time.

Defined cases: null or empty text has no words and no hits; an item without words never occurs; repeated documents are
each answered; repeated item ids are one item with all their windows; an item with a null id hits like any other but is
neither counted nor named among the items; item ids of any type are reported as strings; input columns named ``hits`` or ``items`` are kept as ``in_hits`` and ``in_items``
(``decontaminate`` returns the input's columns unchanged).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .storage import make_room, row_name, table, written

WINDOW = 10
GRAM = 5
KEEP = WINDOW - GRAM + 1
BLOCK_WORDS = 2_000_000


def _words(column: pa.Array) -> Iterator[tuple[int, int, tk.Words]]:
    for row, count, data, offsets in tk.slices(column):
        yield row, count, tk.Words(data, offsets, tk.ALPHANUMERIC, lower=True)


def _kept(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed fingerprints."""
    grams = tk.grams(words.hashes, GRAM)
    windows = tk.starts_within(words.rows, WINDOW)
    if not len(windows):
        return windows, grams[:0]
    at = np.unique(tk.sliding_min_at(grams, KEEP)[windows])
    return at, grams[at]


def _digest_of(words: tk.Words, start: int, size: int) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join([words.data[words.starts[k] : words.ends[k]].tobytes() for k in range(start, start + size)]))


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (kind, hash, digest, item) per window and per fingerprint; kind is the window length, 0 for a fingerprint."""
    for batch in batches:
        ids = batch.column(0)
        for row, _, words in _words(batch.column(1)):
            owner, lengths = words.row_of(), np.diff(words.rows)
            out = []
            for size in range(1, WINDOW + 1):
                start = tk.starts_within(words.rows, WINDOW) if size == WINDOW else words.rows[:-1][lengths == size]
                out.append((np.full(len(start), size), tk.gram_hashes(words.hashes, start, size), [_digest_of(words, s, size) for s in start.tolist()], owner[start]))
            at, fingerprint = _kept(words)
            out.append((np.zeros(len(at), int), fingerprint, [b""] * len(at), owner[at]))
            kind, digest, item = (np.concatenate([x[k] for x in out]) for k in (0, 1, 3))
            exact = [d for x in out for d in x[2]]
            yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(tk.signed(digest.astype(np.uint64))), pa.array(exact, pa.binary()), ids.take(pa.array(row + item))], ["kind", "hash", "digest", "item_id"])


class _Block:
    """Sorted lookup arrays of one block of the benchmark (kind, hash, digest, item_id)."""

    def __init__(self, rows: pa.Table):
        kind, hashes = (rows[c].to_numpy() for c in ("kind", "hash"))
        self.lengths = [int(k) for k in np.unique(kind) if 0 < k < WINDOW]
        self.fingerprints = np.unique(hashes[kind == 0])
        self.items = sorted(set(rows["item_id"].to_pylist()) - {None})
        number = {None: -1} | {x: k for k, x in enumerate(self.items)}  # -1: an item without an id
        self.windows = {}
        for k in (*self.lengths, WINDOW):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(hashes[own], kind="stable")]
            digests, items = (rows[c].take(pa.array(own)).to_pylist() for c in ("digest", "item_id"))
            self.windows[k] = (hashes[own], digests, np.array([number[x] for x in items], np.int64))

    def match(self, words: tk.Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, window starts, number of an item each) of all occurrences in the slice."""
        found: list[tuple[int, np.ndarray]] = []
        if len(self.fingerprints):
            at, fingerprint = _kept(words)
            hit = at[self.fingerprints[np.minimum(np.searchsorted(self.fingerprints, tk.signed(fingerprint)), len(self.fingerprints) - 1)] == tk.signed(fingerprint)]
            around = np.unique((hit[:, None] - np.arange(KEEP)[None, :]).ravel())
            found.append((WINDOW, np.intersect1d(around, tk.starts_within(words.rows, WINDOW), assume_unique=True)))
        found += [(k, tk.starts_within(words.rows, k)) for k in self.lengths]
        for length, start in found:
            known, digests, items = self.windows[length]
            own = tk.signed(tk.gram_hashes(words.hashes, start, length))
            low, high = np.searchsorted(known, own, "left"), np.searchsorted(known, own, "right")
            at, item = [], []
            for k in np.flatnonzero(high > low).tolist():
                exact = _digest_of(words, int(start[k]), length)
                for j in range(low[k], high[k]):
                    if digests[j] == exact:
                        at.append(int(start[k]))
                        item.append(int(items[j]))
            yield length, np.array(at, np.int64), np.array(item, np.int64)


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[pa.Table]:
    """Windows and fingerprints of the benchmark, in blocks of about ``block_words`` words by item."""
    items = benchmark.select(F.col("item_id").cast("string"), "text")
    n = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    blocks = 1 + int(n // 2) // block_words  # a word takes two bytes at least
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield own.mapInArrow(_item_rows, "kind int, hash long, digest binary, item_id string").distinct().toArrow()


_HITS, _ITEMS = "array<struct<start:int,end:int>>", "array<string>"


def _overlaps(docs: DataFrame, rows: pa.Table) -> DataFrame:
    """``docs`` with ``__hits`` and ``__items`` of one block added."""
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    names = docs.columns
    hits_kind, items_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(shared.value)
        for batch in batches:
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for row, _, words in _words(batch.column(names.index("text"))):
                owner = words.row_of()
                for length, start, item in block.match(words):
                    line = owner[start]
                    for r in np.unique(line):
                        mine = line == r
                        at = np.unique(start[mine]) - words.rows[r]
                        cut = np.flatnonzero(np.diff(at) > length)
                        first, last = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + length
                        spans[row + r] += [{"start": int(a), "end": int(b)} for a, b in zip(first, last, strict=True)]
                        items[row + r] |= {block.items[k] for k in item[mine].tolist() if k >= 0}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, hits_kind), pa.array([sorted(x) for x in items], items_kind)], names=[*batch.schema.names, "__hits", "__items"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(add, f"{fields}, __hits {_HITS}, __items {_ITEMS}")


def _marked(docs: DataFrame, benchmark: DataFrame, block_words: int) -> DataFrame:
    """``docs`` with ``__hits`` and ``__items`` over all blocks."""
    blocks = benchmark_blocks(benchmark, block_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _overlaps(docs, first)
    docs = docs.withColumn("__row", row_name("doc_id", "text"))  # rows of equal id and text have equal hits
    slim = docs.select("__row", "text")
    found = None
    for rows in (first, second, *blocks):
        part = _overlaps(slim, rows).where(F.size("__hits") > 0).groupBy("__row").agg(F.first("__hits").alias("__hits"), F.first("__items").alias("__items"))
        part = written(part, "block-hits")
        found = part if found is None else found.unionAll(part)
    found = found.groupBy("__row").agg(F.flatten(F.collect_list("__hits")).alias("__hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    out = docs.join(found, "__row", "left").drop("__row")
    return out.withColumns({"__hits": F.coalesce("__hits", F.array().cast(_HITS)), "__items": F.coalesce("__items", F.array().cast(_ITEMS))})


def find_overlaps(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``hits`` (array of word spans [start, end)) and ``items`` (array of item ids as strings) added."""
    docs = make_room(docs, "hits", "items")
    return _marked(docs, benchmark, block_words).withColumnsRenamed({"__hits": "hits", "__items": "items"})


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, items = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        n_words = np.zeros(batch.num_rows, np.int64)
        for row, count, words in _words(batch.column(1)):
            n_words[row : row + count] = np.diff(words.rows)
        n_hit = []
        for own in spans:
            end, total = 0, 0
            for s in sorted((x["start"], x["end"]) for x in own):
                total += max(0, s[1] - max(end, s[0]))
                end = max(end, s[1])
            n_hit.append(total)
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def contamination_report(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    docs = docs.select("doc_id", "text")
    found = _marked(docs, benchmark, block_words).select("doc_id", "text", "__hits", "__items")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(_digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents without any hit, columns unchanged."""
    return _marked(docs, benchmark, block_words).where(F.size("__hits") == 0).select(*docs.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return contamination_report(docs, table(spark, sf_dir, "benchmark"))


#: Enumerates every window of both sides; the same rows as the winnowed search.
OP6_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT k FROM item_windows),
doc_windows AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words, lengths WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM doc_windows d JOIN item_windows b ON d.k = b.k AND d.win = b.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""

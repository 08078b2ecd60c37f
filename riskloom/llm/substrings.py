"""Substring dedup: suffix automata of reference shards, and matching statistics of the documents streamed past them.

The reference of a corpus' own repeats is the corpus, which has no size bound; so the reference is sharded by anchor (see
``repeats``) and each automaton meets only the runs that could match it, instead of a broadcast to every document. An
automaton knows how often each of its states occurs; a document's matching statistic at a word is the longest ending
there that occurs twice. Where it reaches ``WINDOW`` words, the maximal span is removed.

``dedup_against`` is the same with a given reference set: its shards are broadcast one after the other, each bounded by
``SHARD_WORDS``.

Defined cases: null text has no words; a text without words is kept empty; repeated rows are repeats of each other;
texts shorter than a window are never touched; ids may be of any type; an input column ``spans`` of ``dedup_against`` is kept
as ``in_spans``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .repeats import Items, covered, repeated_windows, unique_keys
from .storage import make_room, row_name, table, written

WINDOW = 35
ITEMS = Items(window=WINDOW, gram=5, words=True)
SHARD_WORDS = 200_000


class SuffixAutomaton:
    """Suffix automaton of several sequences, with the number of occurrences of every state."""

    def __init__(self, sequences: list[list[int]], copies: list[int] | None = None):
        """``copies``: how often each sequence occurs, once by default."""
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for sequence, times in zip(sequences, copies or [1] * len(sequences), strict=True):
            last = 0
            for item in sequence:
                last = self._extend(last, item)
                self.count[last] += times
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.next) - 1

    def _split(self, p: int, item: int, q: int) -> int:
        """The state of p's strings followed by the item, cut out of q if q also holds longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(item) == q:
            self.next[p][item] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, item: int) -> int:
        if item in self.next[last]:
            return self._split(last, item, self.next[last][item])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and item not in self.next[p]:
            self.next[p][item] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, item, self.next[p][item])
        return new

    def matching(self, sequence: list[int], least: int) -> list[int]:
        """For each item the length of the longest string that ends there and occurs ``least`` times or more."""
        state = length = 0
        out = []
        nexts, link, lengths, count = self.next, self.link, self.length, self.count
        for item in sequence:
            while state and item not in nexts[state]:
                state = link[state]
                length = lengths[state]
            if item in nexts[state]:
                state = nexts[state][item]
                length += 1
                while state and count[state] < least:
                    state = link[state]
                    length = lengths[state]
            out.append(length)
        return out


def _match(bodies: list[np.ndarray], groups: list[int], copies: list[int]) -> list[np.ndarray]:
    """Repeated windows of each body, among the bodies of its group."""
    out: list[np.ndarray] = []
    low = 0
    for high in range(1, len(bodies) + 1):
        if high < len(bodies) and groups[high] == groups[low]:
            continue
        own = [b.tolist() for b in bodies[low:high]]
        automaton = SuffixAutomaton(own, copies[low:high])
        out += [np.array(automaton.matching(s, 2)[WINDOW - 1 :]) >= WINDOW for s in own]
        low = high
    return out


def repeated_words(keyed: DataFrame) -> DataFrame:
    return repeated_windows(keyed, ITEMS, _match, SHARD_WORDS)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, sha = [], [], []
        spans = batch.column(2)
        for k, text in enumerate(batch.column(1)):
            words = text.as_py().encode().split()
            gone = covered(spans[k].as_py(), WINDOW, len(words))
            total.append(len(words))
            removed.append(int(gone.sum()))
            sha.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if removed[-1] else b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def dedup_against(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with ``spans`` (array of word spans [start, end)) of all runs of ``window`` words or more that occur in
    ``reference`` (doc_id, text). Every shard of about ``shard_words`` words (a longer document is a shard of its own) is a
    pass of its own over ids and texts: its automaton is broadcast, and the spans found are written before the next one is."""
    size = reference.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + int(size // 4 // shard_words)
    docs = make_room(docs, "spans").withColumn("__row", row_name("doc_id", "text"))
    slim, kind = docs.select("__row", "text"), "array<struct<start:int,end:int>>"
    found = None
    for shard in range(shards):
        own = reference.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)) == shard).select("text").toArrow()["text"]
        sequences = [words.hashes[a:b].tolist() for c in own.chunks for _, _, data, at in tk.slices(c) for words in [tk.Words(data, at, tk.NON_SPACE, lower=False)] for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)]
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(sequences))

        def mark(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
                for row, _, data, at in tk.slices(batch.column(1)):
                    words = tk.Words(data, at, tk.NON_SPACE, lower=False)
                    for k, (a, b) in enumerate(zip(words.rows[:-1], words.rows[1:], strict=True)):
                        stats = np.array(shared.value.matching(words.hashes[a:b].tolist(), 1), np.int64)
                        ends = np.flatnonzero(stats >= window) + 1
                        hit = tk.cover(ends - window, ends, int(b - a))
                        step = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                        spans[row + k] = [{"start": int(x), "end": int(y)} for x, y in zip(step[::2], step[1::2], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, spans_kind)], names=["__row", "spans"])

        part = slim.mapInArrow(mark, f"__row string, spans {kind}").where(F.size("spans") > 0)
        part = written(part.groupBy("__row").agg(F.first("spans").alias("spans")), "shard-spans")
        shared.unpersist()
        found = part if found is None else found.unionAll(part)
    found = found.groupBy("__row").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return docs.join(found, "__row", "left").drop("__row").withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    keyed = unique_keys(table(spark, sf_dir, "documents"))
    marked = keyed.join(repeated_words(keyed), "key", "left").select("doc_id", "text", "spans")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(_digest, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


#: Every window of every text, counted.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
windows AS (SELECT doc_id, p, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h, count(*) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM words),
whole AS (SELECT doc_id, p, h FROM windows WHERE n = 35),
hits AS (SELECT doc_id, p FROM whole SEMI JOIN (SELECT h FROM whole GROUP BY h HAVING count(*) > 1) r USING (h)),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS p FROM hits),
kept AS (SELECT w.doc_id, count(g.p) AS n_removed, string_agg(w.word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS text FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

"""Suffix-array dedup with a run-length index.

A shard (see ``repeats``) is the contents of its anchors end to end, each closed by a separator. Its suffixes are sorted by
prefix doubling and its Burrows-Wheeler transform is cut into runs. Only the two ends of every run are kept: the text
positions of the suffixes there, with how far each agrees with its neighbour across the border (both ends have that
length in common). Inside a run a suffix agrees with its neighbour in one byte less than the position before does, so the
matching statistics of all positions follow by streaming over the text from sample to sample. Sorted suffixes, ranks and
text are dropped once the samples are taken. A content that occurs more than once lies in the index as one copy with a
sample at its start that reaches to its end. Repetitive shards have few runs, and so few samples.

Windows are 200 bytes of UTF-8; matches never cross documents. Defined cases: null text is empty; texts shorter than a
window are never touched; repeated rows are repeats of each other; cuts may fall inside a character, so digests are of
bytes; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens as tk
from .repeats import Items, covered, repeated_windows, unique_keys
from .storage import table

WINDOW = 200
ITEMS = Items(window=WINDOW, gram=32, words=False)
SHARD_BYTES = 1 << 19


SEPARATOR = 0xFF  # no byte of UTF-8


def _classes(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a class of equal keys starts."""
    return np.append(True, sorted_keys[1:] != sorted_keys[:-1])


class SuffixOrder:
    """Suffixes of a text in order, by prefix doubling; each round sorts the suffixes that are still tied.

    ``levels`` are the ranks by the first 8, 16, 32, ... bytes, from which common prefixes are read off exactly.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.words = np.append(tk.byte_words(text, ">"), np.uint64(0))  # the eight bytes from each position
        order = np.argsort(self.words[:n])
        slots = np.arange(n)
        start = _classes(self.words[order])
        first = np.maximum.accumulate(np.where(start, slots, 0))
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = first
        self.levels = [rank.copy()]
        tied = np.flatnonzero(~(start & np.append(start[1:], True)))
        depth = 8
        while len(tied):
            at = order[tied]
            keys = first[tied] << 32 | rank[np.minimum(at + depth, n)] + 1
            by = np.argsort(keys)
            order[tied] = at = at[by]
            start = _classes(keys[by])
            first[tied] = rank[at] = np.maximum.accumulate(np.where(start, tied, 0))
            tied = tied[~(start & np.append(start[1:], True))]
            depth *= 2
            if len(tied):
                self.levels.append(rank.copy())
        self.order = order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and at b (never the same)."""
        length = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            length += (rank[a + length] == rank[b + length]) * (8 << k)
        rest = self.words[a + length] ^ self.words[b + length]
        for j in range(8):
            length += (rest >> np.uint64(56 - 8 * j)) == 0
        return length


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of byte strings: for each end of a run its position and its reach.

    ``copies``: how often each string occurs, once by default; more often is a repeat of its own.
    """

    def __init__(self, bodies: list[np.ndarray], copies: list[int] | None = None):
        stop = np.array([SEPARATOR], np.uint8)
        text = np.concatenate([x for body in bodies for x in (body, stop)])
        lengths = np.array([len(b) for b in bodies])
        self.starts = np.cumsum(lengths + 1) - lengths - 1
        self.ends, self.size = self.starts + lengths, len(text)
        suffixes = SuffixOrder(text)
        before = text[suffixes.order - 1].astype(np.int16)
        before[suffixes.order == 0] = -1  # nothing stands before the first suffix
        border = np.flatnonzero(before[1:] != before[:-1])  # a run ends here, the next one starts after it
        self.runs = len(border) + 1
        tails, heads = suffixes.order[border], suffixes.order[border + 1]
        both = suffixes.common(tails, heads)
        twice = np.array(copies or [1] * len(bodies)) > 1
        at = np.concatenate([tails, heads, self.starts[twice]])
        reach = np.concatenate([tails + both, heads + both, self.ends[twice]])
        by = np.argsort(at, kind="stable")
        self.samples, self.reach = at[by], np.maximum.accumulate(reach[by])

    def matching(self) -> np.ndarray:
        """For each position the length of the longest prefix of what follows it in its string that starts elsewhere too."""
        known = np.zeros(self.size, np.int64)
        known[self.samples] = self.reach  # of several samples at a position the last reaches farthest
        own = np.repeat(self.ends, self.ends - self.starts + 1)
        return np.maximum(np.minimum(np.maximum.accumulate(known), own) - np.arange(self.size), 0)


def _match(bodies: list[np.ndarray], groups: list[int], copies: list[int]) -> list[np.ndarray]:
    index = RunIndex(bodies, copies)
    long = index.matching() >= WINDOW
    return [long[s : s + max(0, len(b) - WINDOW + 1)] for s, b in zip(index.starts.tolist(), bodies, strict=True)]


def repeated_bytes(keyed: DataFrame) -> DataFrame:
    return repeated_windows(keyed, ITEMS, _match, SHARD_BYTES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, pieces, sha = [], [], [], []
        spans = batch.column(2)
        for k, text in enumerate(batch.column(1)):
            raw = text.as_py().encode()
            gone = covered(spans[k].as_py(), WINDOW, len(raw))
            total.append(len(raw))
            removed.append(int(gone.sum()))
            pieces.append(int(np.count_nonzero(np.diff(np.append(0, gone.view(np.int8))) == 1)))
            sha.append(hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes() if removed[-1] else raw).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(pieces, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op10_run_index(spark, sf_dir: str) -> DataFrame:
    keyed = unique_keys(table(spark, sf_dir, "documents"))
    marked = keyed.join(repeated_bytes(keyed), "key", "left").select("doc_id", "text", "spans")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


#: Every window of every text, counted; bytes as hex digits, in pieces so that no window is cut out of a long text.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), sized AS (SELECT *, len(x) // 2 AS n FROM d),
pieces AS (SELECT doc_id, b * 1000 AS start, substr(x, b * 2000 + 1, 2400) AS x FROM (SELECT doc_id, x, unnest(range(0, n // 1000 + 1)) AS b FROM sized)),
windows AS (SELECT doc_id, start + i AS p, md5(substr(x, i * 2 + 1, 400)) AS h FROM (SELECT doc_id, start, x, unnest(range(0, least(1000, len(x) // 2 - 199))) AS i FROM pieces)),
hits AS (SELECT doc_id, p FROM windows SEMI JOIN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1) r USING (h)),
steps AS (SELECT doc_id, p, p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1000) > 200 AS new FROM hits),
numbered AS (SELECT doc_id, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM steps),
spans AS (SELECT doc_id, span, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY doc_id, span),
between_ AS (SELECT doc_id, a AS upto, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans UNION ALL SELECT s.doc_id, s.n, max(b) FROM sized s JOIN spans USING (doc_id) GROUP BY s.doc_id, s.n),
kept AS (SELECT k.doc_id, string_agg(substr(d.x, CAST(since * 2 + 1 AS BIGINT), CAST((upto - since) * 2 AS BIGINT)), '' ORDER BY since) AS x FROM between_ k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_bytes, CAST(coalesce(u.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(u.n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.x, s.x))) AS kept_sha256
FROM sized s LEFT JOIN sums u ON u.doc_id = s.doc_id LEFT JOIN kept k ON k.doc_id = s.doc_id
"""

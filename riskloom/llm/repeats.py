"""Finding every window of L items that also starts elsewhere in the corpus, exactly and without an all-pairs step.

Items are words (op7) or bytes (op10). The common part of both:

1. Each window's anchor is the leftmost least hash of its Q-grams, which depends on the window's content alone: equal
   windows have equal anchors. Consecutive windows with one anchor form a run. A run is one small row (anchor hash,
   content hash, place), about one for every (L - Q) / 2 items.
2. Anchors are counted with map-side combining. A run whose anchor is unique has no repeat. Of the others, equal rows
   (same anchor and content hash) collapse into one content with the number of its rows, and nothing else is decided here.
3. One copy of every content is fetched from the texts and sent to its anchor's shard, a reference of bounded size
   (``CROWD`` contents to an anchor). There an index of the shard, built by the caller (a suffix automaton or a
   run-compressed Burrows-Wheeler transform) that knows which contents occur more than once, gives the matching
   statistics of every content, and they alone say which windows are repeats.
4. An anchor of more contents than a shard takes (a passage in very many contexts) is halved: the windows reaching far
   to its right get a longer anchor there, the others one to the left, and step 3 goes on with both. Every halving
   leaves at most two rows per content, and a whole window is an anchor with one content, so it ends.
5. The spans found in a content are joined back to its rows. Contents with more than one in ``HOT`` of all rows, fewer
   than ``HOT`` by that, are broadcast; of the others none can fill a task.

A text of a short period is as cheap as another: its equal runs that follow each other are one row with a count, and one span.

Rows are named by document id, or by a 128-bit hash of id and text where ids repeat, are null or are no numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as tk
from .storage import row_name, written

CROWD = 1000
HOT = 1000
BROADCAST_ANCHORS = 200_000


@dataclass(frozen=True)
class Items:
    """What windows are made of."""

    window: int
    gram: int
    words: bool

    def read(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, row offsets in items, items) of each slice."""
        for row, _, data, offsets in tk.slices(column):
            if self.words:
                words = tk.Words(data, offsets, tk.NON_SPACE, lower=False)
                yield row, words.rows, words.hashes
            else:
                yield row, offsets, data

    def grams(self, items: np.ndarray) -> np.ndarray:
        return (tk.grams if self.words else tk.byte_grams)(items, self.gram)

    def runs(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """From (key, text) to the runs (key, start, n, times, a, c). In a text with a short period each period is a run
        of its own; ``times`` equal runs that follow each other at once are one row."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(0)
                for row, rows, values in self.read(batch.column(1)):
                    starts = tk.starts_within(rows, self.window)
                    if not len(starts):
                        continue
                    grams = self.grams(values)
                    at = tk.sliding_min_at(grams, self.window - self.gram + 1)[starts]
                    new = np.ones(len(starts), bool)
                    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
                    first = np.flatnonzero(new)
                    n = np.diff(np.append(first, len(starts)))
                    begin = starts[first]
                    owner = np.searchsorted(rows, begin, "right") - 1
                    content = tk.content_hashes(values, begin, begin + n + self.window - 1)
                    again = np.zeros(len(begin), bool)
                    again[1:] = (content[1:] == content[:-1]) & (n[1:] == n[:-1]) & (owner[1:] == owner[:-1]) & (begin[1:] == begin[:-1] + n[:-1])
                    kept = np.flatnonzero(~again)
                    times = np.diff(np.append(kept, len(begin)))
                    begin, n, owner, a, content = begin[kept], n[kept], owner[kept], grams[at[first[kept]]], content[kept]
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(row + owner)), *[pa.array(x.astype(np.int32)) for x in (begin - rows[owner], n, times)], pa.array(tk.signed(a)), pa.array(tk.signed(content))],
                        ["key", "start", "n", "times", "a", "c"],
                    )

        return run

    def contents(self) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """From (text, parts array<struct<start, n, a, c, rows, crowded>>) to one row with its items for every part."""
        names = ["a", "c", "rows", "crowded"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1)
                for row, rows, values in self.read(batch.column(0)):
                    n_rows = len(rows) - 1
                    part = lists[row : row + n_rows].flatten()
                    if not len(part):
                        continue
                    counts = np.array([len(x) if x.is_valid else 0 for x in lists[row : row + n_rows]])
                    base = np.repeat(rows[:-1], counts)
                    begin = base + part.field("start").to_numpy()
                    end = begin + part.field("n").to_numpy() + self.window - 1
                    body = pa.array([values[b:e].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.field(name) for name in names] + [body], [*names, "body"])

        return run


def unique_keys(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text), text not null; the key is the id, or a 128-bit hash of id and text where ids do not name rows or
    are no numbers."""
    integral = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id") if integral else "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    named = integral and docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").isEmpty()
    return docs.withColumn("key", F.col("doc_id") if named else row_name("doc_id", "text"))


def _halve(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cut each content of a crowded anchor in two: the windows that hold half of their free items right of the anchor,
    and the others, which hold as many left of it. The longer stretch that the windows of a half have in common is
    their new anchor. As before it depends on a window's content alone."""

    def pieces(body: np.ndarray, low: int, high: int) -> Iterator[tuple[int, np.ndarray, int, int]]:
        n = len(body) - items.window + 1
        if low < 0:  # the anchor that the runs were cut by
            low = int(tk.sliding_min_at(items.grams(body[: items.window]), items.window - items.gram + 1)[0])
            high = low + items.gram
        half = (items.window - (high - low) + 1) // 2
        cut = high + half - items.window
        if n > cut:
            first = max(0, cut)
            yield first, body[first:], low - first, high + half - first
        if cut > 0:
            yield 0, body[: min(n, cut) + items.window - 1], cut - 1, high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, c, rows, body, low, high in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                for first, part, begin, end in pieces(np.frombuffer(body, np.uint64 if items.words else np.uint8), low, high):
                    digest = [xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in (part[begin:end], part)]
                    out.append((a, c, first, *digest, rows, begin, end, part.tobytes()))
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["of_a", "of_c", "first", "a", "c", "rows", "low", "high", "body"])

    return run


def _with_crowds(contents: DataFrame, crowd: int) -> DataFrame:
    """``contents`` with ``crowded``: do more than ``crowd`` of them share the anchor? Such anchors are few; they are
    broadcast while there are at most ``BROADCAST_ANCHORS``."""
    crowds = written(contents.groupBy("a").agg(F.count("*").alias("d")).where(F.col("d") > crowd).select("a", F.lit(True).alias("crowded")), "crowds")
    side = F.broadcast(crowds) if crowds.count() <= BROADCAST_ANCHORS else crowds
    return contents.join(side, "a", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))


def _spread(crowded: DataFrame, items: Items, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One halving of crowded contents (a, c, rows, low, high, body): (where each new content lies in the old ones, in how
    many places each does, the new contents with ``crowded``)."""
    schema = "of_a long, of_c long, first int, a long, c long, rows long, low int, high int, body binary"
    halves = written(crowded.select("a", "c", "rows", "body", "low", "high").mapInArrow(_halve(items), schema), "halves")
    contents = halves.groupBy("a", "c").agg(F.sum("rows").alias("rows"), F.count("*").alias("n"), F.first(F.struct("low", "high", "body")).alias("one"))
    contents = written(contents.select("a", "c", "rows", "n", "one.*"), "half-contents")
    return halves.select("of_a", "of_c", "first", "a", "c"), contents.select("a", "c", "n"), _with_crowds(contents, crowd)


#: Marks the repeated windows of a shard: (bodies, group of each, how often each occurs) -> for each a mask of its windows.
#: Bodies of one anchor are of one group; those of different groups need not be compared.
Matcher = Callable[[list[np.ndarray], list[int], list[int]], list[np.ndarray]]


def _shards(items: Items, matcher: Matcher, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stream contents sorted by anchor; index whole anchors, several to a shard of about ``size`` items, and match them."""

    def close(held: list[tuple[int, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchors = np.array([x[0] for x in held])
        group = np.cumsum(np.append(0, anchors[1:] != anchors[:-1])).tolist()
        masks = matcher([x[3] for x in held], group, [x[2] for x in held])
        found = []
        for (a, c, _, _), mask in zip(held, masks, strict=True):
            if mask.any():
                step = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                found += [(a, c, x, y - x) for x, y in zip(step[::2].tolist(), step[1::2].tolist(), strict=True)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["a", "c", "at", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        total = 0
        for batch in batches:
            for a, c, rows, body in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if total >= size and held[-1][0] != a:
                    yield from close(held)
                    held, total = [], 0
                x = np.frombuffer(body, np.uint64 if items.words else np.uint8)
                held.append((a, c, rows, x))
                total += len(x)
        if held:
            yield from close(held)

    return run


def _in_rows(rows: DataFrame, hits: DataFrame, sizes: DataFrame, hot: int) -> DataFrame:
    """``rows`` (a, c, ...) joined with the ``spans`` found in their content; ``sizes`` (a, c, n) counts the rows."""
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = sizes.where(F.col("n") * hot > total).select("a", "c")  # fewer than ``hot`` contents
    spans = hits.groupBy("a", "c").agg(F.collect_list(F.struct("at", "m")).alias("spans"))
    often = rows.join(F.broadcast(heavy.join(spans, ["a", "c"])), ["a", "c"])
    return often.unionAll(rows.join(F.broadcast(heavy), ["a", "c"], "left_anti").join(spans, ["a", "c"]))


def repeated_windows(keyed: DataFrame, items: Items, matcher: Matcher, shard: int, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """(key, spans array<struct<start int, n int>>): the starts of all repeated windows of each row, as runs of n starts."""
    texts = keyed.select("key", "text")
    kind = keyed.schema["key"].dataType.simpleString()
    runs = written(texts.mapInArrow(items.runs(), f"key {kind}, start int, n int, times int, a long, c long"), "runs")
    anchors = written(runs.groupBy("a").agg(F.sum("times").alias("rows")).where("rows > 1").select("a"), "anchors")
    found = written(runs.join(anchors, "a", "left_semi"), "repeated-anchors")
    contents = found.groupBy("a", "c").agg(F.sum("times").alias("rows"), F.min(F.struct("key", "start", "n")).alias("one"))
    contents = written(contents.select("a", "c", "rows", "one.*"), "contents")
    parts = _with_crowds(contents, crowd).select("key", F.struct("start", "n", "a", "c", "rows", "crowded").alias("part")).groupBy("key").agg(F.collect_list("part").alias("parts"))
    bodies = texts.join(parts, "key").groupBy("key", F.xxhash64("text")).agg(F.first("text").alias("text"), F.first("parts").alias("parts"))
    bodies = written(bodies.select("text", "parts").mapInArrow(items.contents(), "a long, c long, rows long, crowded boolean, body binary"), "bodies")
    slim = ["a", "c", "rows", "body"]
    levels: list[tuple[DataFrame, DataFrame]] = []  # where the contents of a halving lie in those before it
    fitting = bodies.where("not crowded").select(*slim)
    crowded = bodies.where("crowded").withColumns({"low": F.lit(-1), "high": F.lit(-1)})
    while not crowded.isEmpty():  # at most log2(window) times: a window whole is its own anchor
        places, sizes, halves = _spread(crowded, items, crowd)
        levels.append((places, sizes))
        fitting = fitting.unionAll(halves.where("not crowded").select(*slim))
        crowded = halves.where("crowded")
    sharded = fitting.repartition("a").sortWithinPartitions("a")
    hits = written(sharded.mapInArrow(_shards(items, matcher, shard), "a long, c long, at int, m int"), "hits")
    for places, sizes in reversed(levels):
        up = _in_rows(places, hits, sizes, hot).select(F.col("of_a").alias("a"), F.col("of_c").alias("c"), "first", F.inline("spans"))
        hits = written(hits.unionAll(up.select("a", "c", F.col("first") + F.col("at"), "m")), "hits")
    once = found.where("times = 1").drop("n", "times")
    spans = _in_rows(once, hits, contents.select("a", "c", F.col("rows").alias("n")), hot).select("key", "start", F.inline("spans"))
    # each window of a run that follows itself starts elsewhere, too: all of them are one span
    periodic = found.where("times > 1").select("key", "start", F.lit(0).alias("at"), (F.col("n") * F.col("times")).alias("m"))
    spans = spans.select("key", "start", "at", "m").unionByName(periodic)
    return spans.groupBy("key").agg(F.collect_list(F.struct((F.col("start") + F.col("at")).alias("start"), F.col("m").alias("n"))).alias("spans"))


def covered(spans: list[dict] | None, window: int, size: int) -> np.ndarray:
    """Mask of the items of one row that lie in a repeated window."""
    if not spans:
        return np.zeros(size, bool)
    start = np.array([s["start"] for s in spans])
    return tk.cover(start, start + np.array([s["n"] for s in spans]) + window - 1, size)

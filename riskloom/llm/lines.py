"""Line dedup: range-partitioned line hashes, secondary sort, compressed keep bitmaps.

Each line becomes one small row (128-bit key hash, document, position); texts stay where they are. The rows are
range-partitioned by (hash, document) and sorted by hash, document and position, so a task streams runs of a key and holds
``HELD`` rows and a batch at most. Sorting by document inside the range key splits a key that holds much of the corpus over
many tasks. Runs that touch a partition's border, and pieces of runs longer than ``HELD``, are decided together from one
summary row each: two per partition and one for every ``HELD`` rows at most, which is the bound of that broadcast. The
result is a zlib-compressed bitmap of kept lines per document.

A key is the line with ``[\\x20\\x09-\\x0D]`` stripped and A-Z lower-cased. Keys of at least ``min_chars`` code points in
at least ``min_docs`` documents stay only in the largest document id.

Defined cases: null or empty text is one empty line; a null document id sorts below all others and counts as one
document; repeated document ids are one document for counting, and all their lines are judged alike; empty tables give
empty results; ids must be whole numbers, as the largest one keeps a line; ``dedup_lines`` returns the input's columns
unchanged but for ``text``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import table, written

MIN_CHARS = 20
MIN_DOCS = 3
HELD = 1 << 17
_NO_ID = -(1 << 63)
_SPACE = " \t\n\v\f\r"


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low in range(0, batch.num_rows, 256):  # a bounded number of Python strings at a time
                high, low_, doc, pos = [], [], [], []
                for doc_id, text in zip(ids[low : low + 256].to_pylist(), batch.column(1)[low : low + 256].to_pylist(), strict=True):
                    for k, line in enumerate((text or "").split("\n")):
                        if len(line) < min_chars or len(key := line.strip(_SPACE)) < min_chars:
                            continue
                        h = xxhash.xxh3_128_intdigest(key.encode().lower())
                        high.append((h >> 64) - (1 << 63))
                        low_.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        doc.append(doc_id)
                        pos.append(k)
                yield pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low_, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int32())], ["h1", "h2", "doc", "pos"])

    return rows


def _stream(min_docs: int, most: int):
    """Decide every run of equal hashes that ends inside the partition; pass on the rows of its first and last run, and of
    runs of more than ``most`` rows, in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = 0, 0
        held: list[tuple] = []  # arrays of the run that may go on in the next batch
        first, cut = True, None  # cut: the key whose run was passed on in part

        def out(h1, h2, doc, pos, edge, docs, top):
            n = len(doc)
            return pa.RecordBatch.from_arrays(
                [pa.array(h1), pa.array(h2), pa.array(doc), pa.array(pos), pa.array(np.full(n, edge)), pa.array(np.full(n, (part << 24) + piece, np.int64)), pa.array(np.full(n, docs, np.int64)), pa.array(np.full(n, top, np.int64))],
                ["h1", "h2", "doc", "pos", "edge", "part", "docs", "top"],
            )

        def close(edge: bool) -> Iterator[pa.RecordBatch]:
            h1, h2, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            docs, top = 1 + int(np.count_nonzero(np.diff(doc))), int(doc[-1])
            if edge:
                yield out(h1, h2, doc, pos, True, docs, top)
            elif docs >= min_docs:
                drop = doc != top
                yield out(h1[drop], h2[drop], doc[drop], pos[drop], False, docs, top)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(4)[0].as_py()
            h1, h2, doc, pos = (batch.column(k).to_numpy() for k in range(4))
            new = np.flatnonzero((np.diff(h1) != 0) | (np.diff(h2) != 0)) + 1
            key = (h1[0], h2[0])
            if held and (held[-1][0][-1], held[-1][1][-1]) != key:
                yield from close(first or cut is not None)
                first, cut, held = False, None, []
            elif not held and cut is not None and cut != key:
                first, cut = False, None
            bounds = np.concatenate([[0], new, [len(h1)]])
            # whole runs inside the batch, all at once
            held.append(tuple(x[: bounds[1]] for x in (h1, h2, doc, pos)))
            if len(bounds) > 2:
                yield from close(first or cut is not None)
                first, cut = False, None
                a, b = bounds[1:-2], bounds[2:-1]
                if len(a):
                    step = np.zeros(len(doc), np.int64)
                    step[1:] = np.diff(doc) != 0
                    step[a] = 1
                    docs = np.add.reduceat(step[: b[-1]], a)
                    keep = np.repeat(docs >= min_docs, b - a) & (doc[a[0] : b[-1]] != np.repeat(doc[b - 1], b - a))
                    at = np.flatnonzero(keep) + a[0]
                    if len(at):
                        yield out(h1[at], h2[at], doc[at], pos[at], False, 0, 0)
                held = [tuple(x[bounds[-2] :] for x in (h1, h2, doc, pos))]
            if sum(len(x[0]) for x in held) > most:
                cut = (held[-1][0][-1], held[-1][1][-1])
                yield from close(True)
                held, piece = [], piece + 1
        if held:
            yield from close(True)

    return run


def _bitmap(lines: np.ndarray, size: int) -> bytes:
    bits = np.ones(-(-size // 8) * 8, bool)
    bits[lines] = False
    return zlib.compress(np.packbits(bits).tobytes())


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """(doc_id, pos) of every line to drop, doc_id null as the smallest long."""
    spark = docs.sparkSession
    lines = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "text").mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc long, pos int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos").withColumn("part", F.spark_partition_id())
    judged = written(ranged.mapInArrow(_stream(min_docs, held), "h1 long, h2 long, doc long, pos int, edge boolean, part long, docs long, top long"), "lines")
    sure = judged.where(~F.col("edge")).select("doc", "pos")
    # A border run's documents are sorted too: a document cut by the border is counted on both sides, so counted again by its ends.
    edges = judged.where("edge")
    runs = edges.groupBy("h1", "h2", "part").agg(F.max("docs").alias("docs"), F.min("doc").alias("low"), F.max("top").alias("top"))
    before = F.lag("top").over(_by_key())
    totals = runs.withColumn("docs", F.col("docs") - F.when(before == F.col("low"), 1).otherwise(0)).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.max("top").alias("keep"))
    late = edges.join(F.broadcast(totals.where(F.col("n") >= min_docs)), ["h1", "h2"]).where(F.col("doc") != F.col("keep")).select("doc", "pos")
    return sure.unionAll(late).select(F.col("doc").alias("doc_id"), "pos")


def _by_key():
    from pyspark.sql import Window

    return Window.partitionBy("h1", "h2").orderBy("low", "top")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, held: int = HELD) -> DataFrame:
    """(doc_id, keep): one compressed bitmap per document that loses a line; bits past the last dropped line are 1."""

    @F.pandas_udf("binary")
    def pack(lines):
        return lines.map(lambda x: _bitmap(np.asarray(x, np.int64), int(max(x)) + 1))

    return dropped_lines(docs, min_chars, min_docs, held).groupBy("doc_id").agg(pack(F.collect_set("pos")).alias("keep"))


def kept_mask(bitmap: bytes | None, lines: int) -> np.ndarray:
    """Which of ``lines`` lines a bitmap keeps; no bitmap keeps all."""
    out = np.ones(lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).astype(bool)[:lines]
        out[: len(bits)] = bits
    return out


def _with_bitmaps(docs: DataFrame, **options) -> DataFrame:
    marks = keep_bitmaps(docs, **options).withColumnsRenamed({"doc_id": "__doc", "keep": "__keep"})
    return docs.join(marks, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)) == F.col("__doc"), "left").drop("__doc")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = batch.column(at).to_pylist()
        for k, bitmap in enumerate(batch.column("__keep").to_pylist()):
            if bitmap is not None and texts[k]:
                lines = texts[k].split("\n")
                texts[k] = "\n".join([x for x, kept in zip(lines, kept_mask(bitmap, len(lines)), strict=True) if kept])
        arrays = [pa.array(texts, batch.schema.field("text").type) if i == at else batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).drop_columns(["__keep"])


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """The documents with repeated lines removed; columns as given. A text left without lines becomes empty."""
    return _with_bitmaps(docs, **options).select(*docs.columns, "__keep").mapInArrow(_apply, docs.schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, sha = [], [], []
        for text, bitmap in zip(batch.column(1), batch.column(2), strict=True):
            text, bitmap = text.as_py() or "", bitmap.as_py()
            if bitmap is None:
                total.append(text.count("\n") + 1)
                dropped.append(0)
            else:
                lines = text.split("\n")
                keep = kept_mask(bitmap, len(lines))
                total.append(len(lines))
                dropped.append(len(lines) - int(keep.sum()))
                text = "\n".join([x for x, kept in zip(lines, keep, strict=True) if kept])
            sha.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_bitmaps(docs).select("doc_id", "text", "__keep").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
drops AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.doc_id, k.line, k.pos, d.key IS NOT NULL AND k.doc_id <> d.keeper AS dropped FROM keyed k LEFT JOIN drops d ON k.key = d.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

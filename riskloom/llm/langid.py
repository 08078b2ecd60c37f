"""Language identification by nearest centroid.

Texts become TF-IDF vectors of letter n-grams (1 to 3 bytes of the lower-cased text, hashed to ``DIM`` buckets,
sub-linear counts, unit length). Each language is several spherical k-means centroids; a text takes the language of the
centroid of highest cosine. It is rejected when even that one is much farther than training texts of the language and of
its own length (powers of two of bytes) are: a few words share few n-grams with a centroid and are let be, a long text
that does so is of no known language, or no prose.

Every language of the labelled rows is learnt, each from a bounded sample of its own: about ``sample_per_lang`` of its
rows that have a letter, picked by a hash of the document id, and one at least; where ids repeat, ``MOST_TIMES`` as many
at most. Vectors are fitted in one task a language; only centroids reach the driver, of ``MOST_LANGUAGES`` at most: more
values of the column raise, as 64 KiB of each are broadcast. Prediction reads every whole text and nothing but the text.

Defined cases: null text and text without a letter are ``und`` with score 0 and count as rejected; null languages and
null ids are never learnt from; with nothing to learn from every text is ``und``; ties go to the first language in order;
input columns named ``lang_pred``, ``score`` or ``rejected`` are kept as ``in_lang_pred`` and so on (``accepted`` returns
the input's columns unchanged).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as tk
from .storage import make_room, table, written

DIM = 1 << 12
CENTROIDS = 4
SAMPLE_PER_LANG = 400
MOST_TIMES = 2
MOST_LANGUAGES = 2000
#: A text is rejected below the median cosine of its language's training texts of like length, less this many robust
#: deviations, and less this share of the median at least. Lengths with fewer than LEAST_ROWS different ones take in texts
#: of up to NEAR_LENGTHS lengths; where they are still fewer, LEAST_COSINE alone or the floor of the shorter texts holds.
REJECT_DEVIATIONS = 6
REJECT_SHARE = 0.3
LEAST_ROWS = 20
NEAR_LENGTHS = 4
LEAST_COSINE = 0.05
LENGTHS = 32

_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_MAP = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)


def _codes(data: np.ndarray) -> np.ndarray:
    """Bucket of the 3-, 2- and 1-byte gram that starts at every byte; -1 where it is all space."""
    x = _MAP[data].astype(np.uint32)
    padded = np.append(x, np.array([32, 32], np.uint32))
    y, z = padded[1:-1], padded[2:]
    three = ((x | y << np.uint32(8) | z << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(20)
    two = ((x | y << np.uint32(8) | np.uint32(1 << 24)) * np.uint32(2246822519)) >> np.uint32(20)
    return np.concatenate([three[y != 32], two[x != 32]]).astype(np.int64)


def _counts(text: np.ndarray) -> np.ndarray:
    out = np.bincount(_codes(text), minlength=DIM).astype(np.float32)
    return np.log1p(out)


def _length(text: np.ndarray) -> int:
    return min(LENGTHS - 1, len(text).bit_length())


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def _has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def _sample_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors, sizes, keep = [], [], []
        letters = _has_letter(batch.column(1))
        for row, count, data, offsets in tk.slices(_lowered(batch.column(1))):
            for k in range(count):
                if letters[row + k]:
                    text = data[offsets[k] : offsets[k + 1]]
                    vectors.append(_counts(text).astype(np.float16).tobytes())
                    sizes.append(_length(text))
                    keep.append(row + k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(vectors, pa.binary()), pa.array(sizes, pa.int32())], ["lang", "hash", "vector", "size"])


def _rows_with_gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task: the number of vectors, and of those with each bucket."""
    n, found = 0, np.zeros(DIM, np.int64)
    for batch in batches:
        n += batch.num_rows
        for vector in batch.column(0):
            found += np.frombuffer(vector.as_buffer(), np.float16) != 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([found.tobytes()], pa.binary())], ["n", "found"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Deterministic: seeds are the row nearest the mean, then each time the row least like any seed."""
    k = min(k, len(x))
    seeds = [int(np.argmax(x @ x.mean(0)))]
    for _ in range(k - 1):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    centres = x[seeds]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, 1)
        centres = _unit(np.stack([x[own == j].mean(0) if (own == j).any() else centres[j] for j in range(k)]))
    return centres


@dataclass
class LanguageModel:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray  # least cosine accepted, by centroid and length


def _floors(cosine: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least cosine accepted of each length, from texts of that length and, where they are few, of the next shorter ones."""
    out = np.full(LENGTHS, LEAST_COSINE, np.float32)
    for length in range(LENGTHS):
        for shortest in range(length, max(-1, length - NEAR_LENGTHS), -1):
            own = np.unique(cosine[(size >= shortest) & (size <= length)])  # copies count once
            if len(own) >= LEAST_ROWS:
                middle = float(np.median(own))
                spread = 1.4826 * float(np.median(np.abs(own - middle)))
                out[length] = max(LEAST_COSINE, middle - max(REJECT_DEVIATIONS * spread, REJECT_SHARE * middle))
                break
    return np.maximum.accumulate(out)  # a longer text shares more


def labelled(docs: DataFrame) -> DataFrame:
    """Documents that may be learnt from: crc32 of the id as text, modulo 4, is not 2."""
    return docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(train: DataFrame, sample_per_lang: float) -> DataFrame:
    """(lang, hash, vector, size) of about ``sample_per_lang`` rows of each language: hashes below its share of all 64 bits, and
    the least; rows of one id share a hash, so the sample is cut at ``MOST_TIMES`` its size, in order of hash and text."""
    rows = train.where(F.col("text").rlike(r"\p{L}")).withColumn("hash", F.xxhash64(F.lit("langid"), F.col("doc_id")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("__n"), F.min("hash").alias("__least"))
    below = F.lit(2.0**64) * sample_per_lang / F.col("__n") - 2.0**63
    picked = (F.col("__n") <= sample_per_lang) | (F.col("hash").cast("double") < below) | (F.col("hash") == F.col("__least"))
    if sizes.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = Window.partitionBy("lang").orderBy("hash", F.xxhash64("text"))
    sample = rows.join(F.broadcast(sizes), "lang").where(picked).withColumn("__rank", F.row_number().over(place)).where(F.col("__rank") <= max(1, int(MOST_TIMES * sample_per_lang)))
    return sample.select("lang", "text", "hash").mapInArrow(_sample_vectors, "lang string, hash long, vector binary, size int")


def fit(train: DataFrame, sample_per_lang: float = SAMPLE_PER_LANG, centroids: int = CENTROIDS) -> LanguageModel:
    """Fit every language of ``train`` on a hash sample of about ``sample_per_lang`` of its rows."""
    sample = written(_sample(train, sample_per_lang), "language_sample")
    n, found = 0, np.zeros(DIM, np.int64)
    for part in sample.select("vector").mapInArrow(_rows_with_gram, "n long, found binary").toArrow().to_pylist():
        n, found = n + part["n"], found + np.frombuffer(part["found"], np.int64)
    idf = np.log((1 + n) / (1 + found)).astype(np.float32) + 1

    def fit_one(own: pa.Table) -> pa.Table:
        rows = sorted(zip(own["hash"].to_pylist(), own["vector"].to_pylist(), own["size"].to_pylist(), strict=True))  # the order of arrival varies
        x = _unit(np.stack([np.frombuffer(v, np.float16).astype(np.float32) for _, v, _ in rows]) * idf)
        c = _spherical_kmeans(x, centroids)
        floors = _floors(np.round((x @ c.T).max(1), 6), np.array([size for _, _, size in rows]))
        k = len(c)
        return pa.table({"lang": own["lang"][:1].to_pylist() * k, "k": pa.array(range(k), pa.int32()), "floors": [floors.tobytes()] * k, "centroid": [v.tobytes() for v in c.astype(np.float32)]})

    got = sample.groupBy("lang").applyInArrow(fit_one, "lang string, k int, floors binary, centroid binary").toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])
    centres, floors = (np.array([np.frombuffer(v.as_buffer(), np.float32) for v in got[c]], np.float32).reshape(got.num_rows, n) for c, n in (("centroid", DIM), ("floors", LENGTHS)))
    return LanguageModel(got["lang"].to_pylist(), idf, centres, floors)


def _predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``__lang``, ``__score`` and ``__rejected`` added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at)
            n = batch.num_rows
            lang, score, rejected = ["und"] * n, np.zeros(n), np.ones(n, bool)
            letters = _has_letter(texts)
            for row, count, data, offsets in tk.slices(_lowered(texts)):
                rows = [k for k in range(count) if letters[row + k]] if len(m.langs) else []
                for low in range(0, len(rows), 256):
                    part = rows[low : low + 256]
                    own = [data[offsets[k] : offsets[k + 1]] for k in part]
                    like = _unit(np.stack([_counts(x) for x in own]) * m.idf) @ m.centroids.T
                    best = np.argmax(like, 1)
                    for k, x, b, s in zip(part, own, best, like[np.arange(len(part)), best], strict=True):
                        lang[row + k], score[row + k], rejected[row + k] = m.langs[b], min(1.0, max(0.0, float(s))), s < m.floors[b, _length(x)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang), pa.array(score), pa.array(rejected)], names=[*batch.schema.names, "__lang", "__score", "__rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, __lang string, __score double, __rejected boolean")


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected`` added."""
    names = {"__lang": "lang_pred", "__score": "score", "__rejected": "rejected"}
    return _predicted(make_room(docs, *names.values()), model).withColumnsRenamed(names)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The documents that are not rejected, columns unchanged."""
    return _predicted(docs, model).where("not __rejected").select(*docs.columns)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled(docs))
    return predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")

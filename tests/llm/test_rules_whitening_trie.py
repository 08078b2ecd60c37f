"""Quality rules, whitening and the prefix trie on awkward rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality, trie, whitening
from riskloom.llm.storage import table

SPACE = r"[^\x20\x09-\x0D]+"


# --- op11 ---


def base(text):
    """The contract's counts by plain Python."""
    text = text or ""
    words, lines = re.findall(SPACE, text), [x for x in text.split("\n") if re.search(SPACE, x)]
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


PROSE = " ".join(f"the word{k} of a thing{k * 7 % 31}" for k in range(40))
TEXTS = [
    None, "", " \n\t", "x", PROSE, PROSE + "\n" + PROSE, "a b c d e f g h " * 5, "a b c d e f g h", "one two three four five six seven eight nine one two three four five six seven eight",
    "z " * 30_000, "\n".join(["the same line of text"] * 9), "é你😀 " * 30, "#*$%&|<> " * 30, "THE LOUD WORD OF A SHOUT " * 6, "\v\f\r the of", "x" * 100_000,
    "- the item of a list\n" * 30, "the end of it ...\n" * 30,
]


def test_quality_counts(spark):
    docs = spark.createDataFrame([(k if k else None, t, "mine") for k, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    rated = quality.rate(docs)
    assert rated.columns[:3] == ["doc_id", "text", "in_n_words"]
    rows = rated.collect()
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert got == base(r["text"]), (r["text"] or "")[:40]
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert r["kept"] == (not r["base_failed"] and not r["broken"])
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and [r["text"] for r in kept.collect()] == [PROSE]
    assert quality.rate(docs.limit(0)).count() == 0


def test_thresholds_are_a_table(spark):
    rules = spark.createDataFrame([("b", "n_lines", "n_words", None, 10), ("a", "n_upper", "n_cased", 500, None)], "name string, part string, of string, least int, most int")
    docs = spark.createDataFrame([(1, PROSE), (2, PROSE.upper()), (3, "\n".join(PROSE.split()))], "doc_id long, text string")
    got = {r["doc_id"]: r["broken"] for r in quality.rate(docs, quality.thresholds_from(rules)).collect()}
    assert got == {1: ["a"], 2: [], 3: ["a", "b"]}
    assert {r["doc_id"] for r in quality.rate(docs, (), {}).where("size(broken) = 0").collect()} == {1, 2, 3}
    with pytest.raises(ValueError, match="names no count"):
        quality.compile_rules([quality.Threshold("x", "n_none", "n_words")])


def test_quality_keeps_clean_documents(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    rated = quality.rate(table(spark, sf_dir, "documents").join(labels, "doc_id")).where("not base_failed")
    assert rated.count() > 30 and rated.where("not kept").count() == 0


def test_quality_is_one_projection(spark, sf_dir):
    plan = quality.op11_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan.replace("ArrowEval", "Arrow")


# --- op12 ---


def test_eigen_of_matrices():
    rng = np.random.default_rng(4)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (33, 33)):
        a = rng.normal(size=(rank, d)) * rng.uniform(0.01, 100, size=(rank, 1))
        v = a.T @ a
        u, e = whitening.eigen(v)
        want = np.linalg.eigvalsh(v)[::-1][:rank]
        assert len(e) == rank and np.allclose(e, want, rtol=1e-9, atol=1e-12 * want[0])
        assert np.abs(u.T @ u - np.eye(rank)).max() < 1e-13 and np.abs(v @ u - u * e).max() < 1e-12 * want[0]
    assert whitening.eigen(np.zeros((3, 3)))[0].shape == (3, 0)


def check_whitened(rows, vectors, k):
    """``rows`` of op12 against numpy."""
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64).astype(object) + 100000
    n, total = len(x), x.sum(0)
    y = (n * x - total).astype(object)
    centred = (y / n).astype(float)
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    got = np.array([r["whitened"] for r in rows], float)
    want = centred @ u / np.sqrt(e)
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6
    assert [int(r["deviation"]) for r in rows] == [int(sum(z * z for z in row)) for row in y]
    assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-9


def test_whitening_of_awkward_rows(spark):
    rng = np.random.default_rng(2)
    good = [[float(v) for v in rng.normal(size=4) * (9, 5, 2, 1)] for _ in range(50)]
    rows = [(k, v) for k, v in enumerate([*good, good[0], good[0]])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [float("nan")] * 4), (93, [1.0, 2.0, float("inf"), 1.0]), (94, []), (95, [1.0, 2.0]), (None, good[1])]
    data = spark.createDataFrame([(*r, "own") for r in rows + bad], "vec_id long, embedding array<double>, whitened string").repartition(5)
    model = whitening.fit(data)
    assert model.n == 53
    out = whitening.whiten(data, model, 3)
    assert out.columns == ["vec_id", "embedding", "in_whitened", "whitened", "deviation"]
    got = sorted(out.collect(), key=lambda r: (r["vec_id"] is None, r["vec_id"]))
    check_whitened(got, [v for _, v in rows] + [good[1]], 3)
    assert got[0]["whitened"] == got[50]["whitened"] == got[51]["whitened"] and got[-1]["vec_id"] is None
    assert whitening.identity_error(out, 3) < 1e-9
    assert whitening.fit(data.where("vec_id >= 90")) is None  # one usable vector
    assert whitening.fit(data.limit(0)) is None and whitening.fit(data.where("vec_id in (0, 50, 51)")) is None
    large = spark.createDataFrame([(k, [v[0] * 1e8, v[1] * 1e8]) for k, v in enumerate(good)], "vec_id long, embedding array<double>")
    check_whitened(sorted(whitening.whiten(large, whitening.fit(large), 2).collect(), key=lambda r: r["vec_id"]), [[v[0] * 1e8, v[1] * 1e8] for v in good], 2)


def test_whitening_query(spark, sf_dir, tmp_path):
    got = whitening.op12_whitening(spark, sf_dir).toPandas()
    source = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-4
    assert sorted(got.component.unique()) == list(range(1, 9)) and len(got) == 8 * len(source)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index()
    deviation = got[got.component == 1].set_index("vec_id").deviation
    check_whitened([{"whitened": w, "deviation": deviation[i]} for i, w in zip(wide.index, wide.to_numpy(), strict=True)], [r["embedding"] for r in source], 8)
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert whitening.op12_whitening(spark, str(tmp_path)).count() == 0


# --- op13 ---


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(v[2], v[4]) for v in sorted(vs)] for c, vs in turns.items()}
    members = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        sequence = own.get(donor, [])[:h] + own[c][h:]
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append((c, len(sequence) == d))
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, v in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(v) - 1) * len(re.findall(SPACE, k[-1][1])) if k else 0
    sha = lambda v: hashlib.sha256(",".join(str(c) for c, e in sorted(v) if e).encode()).hexdigest()
    return sorted((min(v)[0], len(k), min(members[k[:-1]])[0] if k else -1, len(v), children[k], leaves[k], saved[k], sha(v)) for k, v in members.items())


def trie_rows(spark, rows):
    data = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = trie.prefix_trie(trie.rebuilt(trie.turns_of(data))).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *r[3:]) for r in got)


def test_prefix_trie_of_awkward_rows(spark):
    rows = [(None, 1, "u", "lost"), (0, 2, "u", "c d"), (0, None, None, None), (0, 1, "u", "b"), (1, 1, "u", "b"), (1, 1, "u", "b"), (1, 1, "a", "b"), (2, 1, "u", "")]
    rows += [(c, t, "u", f"x{t}") for c in range(20, 40) for t in range(c % 7 + 1)]  # copies and prefixes
    rows += [(c, 5, "ab", "c") for c in (41, 42)] + [(43, 5, "a", "bc"), (-3, 1, "u", "q r"), (-20, 1, "u", "p"), (9000, 0, "u", "y")]
    rows += [(60, t, "u", f"long {t % 3}") for t in range(70)] + [(80, t, "u", f"long {t % 3}") for t in range(64)]
    assert trie_rows(spark, rows) == brute_trie(rows)
    assert trie.prefix_trie(trie.rebuilt(trie.turns_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))).count() == 0


def test_ends_are_hashed_in_chunks(spark):
    ids = [*range(-9000, 9000, 7), 10**15]
    ends = spark.createDataFrame([(bytearray(b"a" * 16), i) for i in ids] + [(bytearray(b"b" * 16), 5)], "node binary, conv_id long").repartition(6)
    got = {bytes(r["node"])[:1]: r["ends_sha256"] for r in trie.end_hashes(ends).collect()}
    assert got == {b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), b"b": hashlib.sha256(b"5").hexdigest()}


def test_totals_are_grafted_over_whole_subtrees(spark, sf_dir):
    got = trie.op13_prefix_trie(spark, sf_dir)
    assert got.where("depth = 0").select("n_convs").first()[0] == table(spark, sf_dir, "conversations").select("conv_id").distinct().count()
    inner = got.groupBy("parent_conv_id", (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("sum_leaves"), F.count("*").alias("n")).withColumnRenamed("parent_conv_id", "conv_id")
    joined = got.join(inner, ["conv_id", "depth"])
    assert joined.count() and joined.where("n_leaves <> sum_leaves or n <> n_children").count() == 0

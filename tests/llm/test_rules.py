"""Operators without SQL against brute force, and the rules of hashes, ids and names of columns."""

import datetime
import hashlib
import random

import numpy as np
import pytest
import regex
import xxhash
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import decontaminate, fingerprints, jaccard, langid, licenses, lines, mixing, pii, queries, repeats, substrings
from riskloom.llm.storage import make_room, table

TEXT = "doc_id long, text string"


def thue_morse(first, second, n=10):
    a, b = first, second
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


# --- hashes ---


def test_words_built_to_collide_modulo_a_power_of_two_differ(spark):
    one, two = thue_morse("a", "b")
    assert len(one) == len(two) == 1024 and one != two
    docs = spark.createDataFrame([(1, one), (2, " ".join([one] * 40))], TEXT)
    bench = spark.createDataFrame([(1, two), (2, " ".join([two] * 12))], "item_id long, text string")
    assert {tuple(r)[2:4] for r in decontaminate.contamination_report(docs, bench).collect()} == {(0, 0)}
    pair = spark.createDataFrame([(1, f"{one} x y z v w"), (2, f"{two} x y z v w"), (3, one), (4, two)], TEXT)
    assert all(r["doc_id"] == r["component_id"] for r in jaccard.jaccard_components(pair).collect())
    rows = [(k, " ".join([w, *[f"q{j}" for j in range(34)]])) for k, w in enumerate((one, two))]
    assert substrings.repeated_words(repeats.unique_keys(spark.createDataFrame(rows, TEXT))).count() == 0


def test_exact_keys_of_the_join(spark, documents):
    pick = lambda **o: sorted(map(tuple, jaccard.jaccard_components(documents, **o).collect()))
    found = pick(exact=True)
    assert found == pick() and any(i != c for i, _, c in found)
    rng = random.Random(5)
    for _ in range(200):  # sets just at the threshold share a key
        n = rng.randrange(5, 80)
        both = [rng.getrandbits(64) for _ in range(-(-8 * n // 9) if n % 9 else 8 * n // 9)]
        a, b = (sorted({*both, *[rng.getrandbits(64) for _ in range(n - len(both))]}) for _ in range(2))
        if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)):
            values = np.array(a + b, np.uint64)
            keys, each = jaccard._prefix_keys(values, np.array([0, len(a), len(a) + len(b)]))
            assert set(keys[: each[0]].tolist()) & set(keys[each[0] :].tolist())


# --- ids and columns ---


def test_ids_of_text(spark):
    body = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([("b2", body), ("b1", body), ("c", "other words here"), (None, None)], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert got == {"b1": "b1", "b2": "b1", "c": "c", None: None}
    bench = spark.createDataFrame([("i1", body), ("i2", "words here")], "item_id string, text string")
    for options in ({}, {"block_words": 5}):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate.contamination_report(docs, bench, **options).collect()}
        assert got == {"b1": (60, 1), "b2": (60, 1), "c": (2, 1), None: (0, 0)}
    assert substrings.repeated_words(repeats.unique_keys(docs)).count() == 2


CLASH = ("score", "lang_pred", "rejected", "hits", "items", "domain", "tokens", "epoch", "n_tokens", "licenses", "found", "keep", "pos", "key", "id", "n", "a", "c", "rep", "spans", "anchors", "fingerprint")


def test_columns_of_the_input_stay(spark, sf_dir, documents):
    docs = documents.withColumns({c: F.concat(F.lit(f"{c}-"), "doc_id") for c in CLASH})
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "mixing":
            assert out.columns == docs.columns, name
        for r in out.collect():
            for c in CLASH:
                own = f"in_{c}" if name == "mixing" and f"in_{c}" in out.columns else c
                assert r[own] == before[r["doc_id"]][c], (name, c)
    operators = {
        "lang": (lambda d: langid.predict(d, langid.fit(langid.labelled(d))), ("lang_pred", "score", "rejected")),
        "hits": (lambda d: decontaminate.find_overlaps(d, table(spark, sf_dir, "benchmark")), ("hits", "items")),
        "licenses": (licenses.scan_licenses, ("licenses",)),
        "found": (lambda d: pii.mask_documents(d, pii.EXAMPLE_KEY), ("found",)),
        "anchors": (fingerprints.fingerprints, ("anchors", "fingerprint")),
        "spans": (lambda d: substrings.dedup_against(d, d.limit(1)), ("spans",)),
    }
    few = docs.where("doc_id < 20").select("doc_id", "text", "lang", "source", *CLASH)
    for run, added in operators.values():
        out = run(few)
        assert set(out.columns) == {*few.columns, *added, *[f"in_{c}" for c in added]}
        assert all(r[f"in_{added[0]}"] == f"{added[0]}-{r['doc_id']}" for r in out.collect())
    assert make_room(few.withColumn("in_hits", F.lit(1)), "hits").columns[-1] == "in_hits"


# --- op1 ---


def anchors_of(text):
    tokens = regex.findall(r"(?V1)(?<![[\p{L}\p{M}\p{N}]--\p{Ideographic}])[[\p{L}\p{M}\p{N}]--\p{Ideographic}]{1,24}+(?![[\p{L}\p{M}\p{N}]--\p{Ideographic}])|[^ \t\n\x0B\f\r]", text)
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def chain(values):
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed)
        return seed

    k, s = fingerprints.K, fingerprints.S
    h = [*range(1000, 1000 + k - 1), *[signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens], *range(2000, 2000 + k - 1)]
    inner = [signed(chain(h[i : i + s])) for i in range(len(h) - s + 1)]
    out = []
    for i in range(len(h) - k + 1):
        own = inner[i : i + k - s + 1]
        if min(own) in (own[0], own[-1]):
            out.append((i, chain(h[i : i + k]) >> 24))
    return out


def test_fingerprints_of_documents(spark, sf_dir, documents):
    rows = dict(texts(documents))
    order = sorted(rows, reverse=True)
    got = {r["doc_id"]: r for r in queries.queries()["op1_fingerprints"](spark, sf_dir).collect()}
    assert set(got) == set(rows)
    found = {i: anchors_of(t) for i, t in rows.items()}
    show = lambda a: " ".join(f"{h:x}:{p}" for p, h in a)
    like = lambda a, b: len({h for _, h in a} & {h for _, h in b}) / len({h for _, h in a} | {h for _, h in b})
    for k, i in enumerate(order):
        text, after = rows[i], order[(k + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[after][:half]
        other = anchors_of(edited)
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), show(found[i]), show(other), like(found[i], other), like(found[i], found[after]))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == want[:4]
        assert abs(r["near_edited"] - want[4]) < 1e-12 and abs(r["near_next"] - want[5]) < 1e-12


def test_anchors_need_no_spaces(spark):
    rng = random.Random(1)
    han = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(3000))
    kana = "".join(chr(0x30A1 + rng.randrange(80)) for _ in range(3000))
    code = "".join(rng.choice("0123456789abcdef") for _ in range(3000))
    df = spark.createDataFrame([(k, t) for k, text in enumerate((han, kana, code)) for t in (text, text[7] + text)], TEXT)
    got = df.select("doc_id", fingerprints.hashes(fingerprints.anchors(F.col("text"))).alias("h")).collect()
    for k in range(3):
        a, b = (set(r["h"]) for r in got if r["doc_id"] == k)
        assert len(a & b) > 0.95 * len(a)


# --- op3 ---


def words_of(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def licenses_of(text):
    """By trying every place."""
    w, out = words_of(text), set()
    for name, template in licenses.TEMPLATES.items():
        t = words_of(template)
        size, slack = min(licenses.SHINGLE, len(t)), len(t) // 4
        own = {tuple(t[k : k + size]) for k in range(len(t) - size + 1)}
        here = [k if tuple(w[k : k + size]) in own else None for k in range(len(w) - size + 1)]
        for start in [k for k in here if k is not None]:
            part = {tuple(w[k : k + size]) for k in here[max(0, start - slack) : start + len(t) + slack - size + 1] if k is not None}
            if len(part) >= licenses.CONTAINMENT * len(own):
                out.add(name)
                break
    return out


def test_licenses_of_documents(spark, sf_dir, documents):
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in queries.queries()["op3_license_scan"](spark, sf_dir).collect()}
    want = {i: licenses_of(t) for i, t in texts(documents)}
    assert got == want and any(want.values())


def test_license_recall(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for name, template in licenses.TEMPLATES.items():
        for k in range(30):
            w = template.split()
            for _ in range(k % 6 * len(w) // 150):
                w[rng.randrange(len(w))] = "changed"
            around = [" ".join(f"n{rng.randrange(500)}" for _ in range(40)) for _ in range(2)]
            rows.append((len(rows), f"{around[0]}\n{' '.join(w)} {around[1]}"))
            want[len(rows) - 1] = licenses_of(rows[-1][1])
    got = {r["doc_id"]: {x["license"] for x in r["licenses"]} for r in licenses.scan_licenses(spark.createDataFrame(rows, TEXT)).collect()}
    total = sum(map(len, want.values()))
    assert total > 300 and sum(len(got[k] & want[k]) for k in want) >= 0.99 * total and all(got[k] <= want[k] for k in want)


# --- op4 ---


def test_rejection(spark, documents):
    model = langid.fit(langid.labelled(table(spark, "/root/testdata/sf0.01", "documents")))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 5
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 5
    odd = [(1, "Wher. " * 300), (2, "Und " * 500), (3, polish), (4, finnish), (5, "Съешь же ещё этих мягких булок " * 30), (6, "xqzt " * 400), (7, "0x1f " * 900)]
    rejected = {r["doc_id"] for r in langid.predict(spark.createDataFrame(odd, TEXT), model).where("rejected").collect()}
    assert rejected == {k for k, _ in odd}
    prose = {i for i, t in texts(documents) if len(w := t.split()) < 20 or len(set(w)) > 0.3 * len(w)}
    kept = {r["doc_id"] for r in langid.accepted(documents, model).collect()}
    assert len(prose & kept) >= 0.99 * len(prose) and len(kept) < documents.count()


# --- op2, op9 ---


def test_levels_of_the_mix(spark):
    rows = [(k, "one two three four", "en" if k % 3 else "de", f"s{k % 4}", "web" if k % 2 else "books") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain string")
    mix = mixing.select_mix(docs, {"domain": {"web": 3}}, epochs=1)
    by = {r["domain"]: r["n"] for r in mix.groupBy("domain").agg(F.sum("n_tokens").alias("n")).collect()}
    assert set(by) == {"web", "books"} and by["web"] > 2.5 * by["books"] and mix.where("domain <> in_domain").isEmpty()
    flat = mixing.select_mix(docs, {"topic": {"s1": 2}}, levels={"topic": F.col("source")})
    assert flat.select("topic").distinct().count() == 4
    pick = lambda **o: sorted((r["doc_id"], r["epoch"]) for r in mixing.select_mix(docs, **o).collect())
    assert pick() == pick(edge_rows=1)


def test_lines_held_in_pieces(spark):
    rows = [(k % 90, "\n".join(["A frequent line of some length", f"a line of document {k % 7} or so", "short"] * (1 + k % 3))) for k in range(300)]
    df = spark.createDataFrame(rows, TEXT)
    whole, pieces = (sorted(map(tuple, lines.dropped_lines(df, held=h).distinct().collect())) for h in (lines.HELD, 2))
    assert whole == pieces and len(whole) > 100


# --- the pipeline ---


def test_stages_against_brute_force(spark, sf_dir, documents, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r for r in documents.collect()}
    key = lambda line: line.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, r in rows.items():
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    drops = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    want = {i: "\n".join(line for line in (r["text"] or "").split("\n") if drops.get(key(line), i) == i) for i, r in rows.items()}
    got = {r["doc_id"]: r["text"] or "" for r in stages["line_dedup"](spark, documents, sf_dir).collect()}
    assert got == want and drops

    bench = [words_of(t) for _, t in texts(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))]
    windows = {tuple(w[k : k + 10]) for w in bench if w for k in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in windows}
    bad = {i for i, r in rows.items() for w in [words_of(r["text"] or "")] if any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in stages["decontamination"](spark, documents, sf_dir).collect()} == set(rows) - bad and bad

    import duckdb

    few = documents.where("length(text) % 3 > 0")
    few.write.parquet(str(tmp_path / "few"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/few/*.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, epoch FROM ({mixing.OP2_SQL})").fetchall())
    got = sorted((r["doc_id"], r["epoch"]) for r in stages["mixing"](spark, few, sf_dir).collect())
    assert got == want and got


# --- op8 ---


def feistel(values, radices, kind, key):
    values = list(values)
    if sum(x > 1 for x in radices) == 1:
        ranked = sorted(range(max(radices)), key=lambda i: hashlib.sha256(f"{key}|{kind}|one|{i}".encode()).hexdigest())
        return [ranked[v] if x > 1 else v for v, x in zip(values, radices)]
    for r in range(pii.ROUNDS):
        others = [v for j, v in enumerate(values) if j % 2 != r % 2]
        digest = hashlib.sha256("|".join([key, kind, str(r), str(len(values)), ",".join(map(str, others))]).encode()).hexdigest()
        values = [(v + int(digest[j % 16 * 4 : j % 16 * 4 + 4], 16) + j // 16 * 7) % radices[j] if j % 2 == r % 2 else v for j, v in enumerate(values)]
    return values


def by_symbol(text, kind, key, lead=()):
    def symbol(j, c):
        if "0" <= c <= "9":
            return ((50, 8) if c >= "2" else (48, 2)) if j in lead else (48, 10)
        return (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)

    of = [symbol(j, c) for j, c in enumerate(text)]
    moved = feistel([ord(c) - b for c, (b, _) in zip(text, of)], [r for _, r in of], kind, key)
    return "".join(chr(b + v) for (b, _), v in zip(of, moved))


def refill(pattern, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10


def day(m):
    if len(m) < 8:
        return None
    tries = [m.split("-")] if "-" in m else [(p := regex.split("[/.]", m))[::-1], *([[p[2], p[0], p[1]]] if "/" in m else [])]
    for y, mo, d in tries:
        try:
            return datetime.date(int(y), int(mo), int(d))
        except ValueError:
            pass


def pseudonym(kind, m, key):
    """None where the check fails."""
    digits = regex.sub("[^0-9]", "", m)
    if kind == "email":
        name, at = m.split("@")
        return None if regex.search(r"^\.|\.\.|\.@", m) or not regex.search("[A-Za-z]{2}$", m) else f"{by_symbol(name, kind, key)}@{at}"
    if kind == "secret":
        prefix = regex.match(r'AKIA|[A-Za-z_]+ ?= ?"?', m).group()
        return prefix + by_symbol(m[len(prefix) :], kind, key)
    if kind == "iban":
        rest = lambda account, check: int("".join(str(int(c, 36)) for c in account.replace(" ", "") + m[:2] + check)) % 97
        made = by_symbol(m[4:].replace(" ", ""), kind, key)
        left = iter(made)
        return f"{m[:2]}{98 - rest(made, '00'):02d}" + "".join(c if c == " " else next(left) for c in m[4:]) if rest(m[4:], m[2:4]) == 1 else None
    if kind == "ip":
        parts = [int(x) for x in m.split(".")]
        return ".".join(map(str, feistel(parts, [256] * 4, kind, key))) if max(parts) < 256 else None
    if kind == "ssn":
        a, b, c = (int(x) for x in m.split("-"))
        if a in (0, 666) or a > 899 or not b or not c:
            return None
        a, b, c = feistel([a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999], kind, key)
        return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"
    if kind == "phone":
        rest = regex.sub(rf"^\+{pii.COUNTRY_CODE}[ .-]?", "", m)
        national = regex.sub("[^0-9]", "", rest)
        return m[: len(m) - len(rest)] + refill(rest, by_symbol(national, kind, key, (0, 3) if len(national) == 10 else (0,)))
    if kind == "card":
        if luhn(digits):
            return None
        body = digits[0] + by_symbol(digits[1:-1], kind, key)
        return refill(m, body + str((10 - luhn(body + "0")) % 10))
    d = day(m)
    if d is None or not 1800 <= d.year <= 2199:
        return None
    n = (d - datetime.date(1800, 1, 1)).days
    hi, lo = feistel([n // 773, n % 773], [189, 773], kind, key)
    d = datetime.date(1800, 1, 1) + datetime.timedelta(hi * 773 + lo)
    if "-" in m:
        return d.isoformat()
    sep = "/" if "/" in m else "."
    first, second = regex.split("[/.]", m)[:2]
    two = (lambda x: f"{x:02d}") if len(first) == 2 else str
    pair = (two(d.month), two(d.day)) if int(second) > 12 else (two(d.day), two(d.month))
    return sep.join([*pair, str(d.year)])


def masked(text, key):
    found, out, at = [], [], 0
    for m in regex.finditer(pii.ANY, text):
        made = None
        for kind, pattern in pii.PATTERNS.items():
            if regex.fullmatch(pattern, m.group()) and (made := pseudonym(kind, m.group(), key)) is not None:
                found.append((kind, m.group(), made))
                break
        out += [text[at : m.start()], m.group() if made is None else made]
        at = m.end()
    return "".join([*out, text[at:]]), found


def test_pii_of_documents(spark, documents):
    extra = ["call 212-555-0100, (212) 555-0100 or +1 212 555 0100", "GB82 WEST 1234 5698 7654 32, DE89370400440532013000, GB82 WEST 1234 5698 7654 33", "a..b@x.com ok@x.com x@y.c1", '4111 1111 1111 1111 API_KEY = "abc_def-123" 29/02/2024 02/29/2024 1.12.1999 9.9.99999 078-05-1120 000-12-3456']
    df = documents.select("doc_id", "text").union(spark.createDataFrame([(10_000 + k, t) for k, t in enumerate(extra)], TEXT))
    want = {i: masked(t, "a key") for i, t in texts(df)}
    got = {r["doc_id"]: (r["text"] or "", [tuple(x) for x in r["found"]]) for r in pii.mask_documents(df, "a key").collect()}
    assert got == want and {k for _, f in want.values() for k, _, _ in f} == set(pii.PATTERNS)
    phones = [p for _, _, p in want[10_000][1]]
    assert len({regex.sub("[^0-9]", "", p)[-10:] for p in phones}) == 1 and len(phones) == 3
    other = {r["doc_id"]: r["text"] for r in pii.mask_documents(df, "another").collect()}
    assert other[10_000] != want[10_000][0]


def test_equal_values_are_linked_however_written(spark):
    rows = [
        "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "+1 212 555 0100", "+12125550100", "(212) 555-0100", "+49 30 1234567", "+49301234567", "+351 21 234 5678", "+351212345678",
    ]
    df = spark.createDataFrame([(k, f"see {t}; {t}, x") for k, t in enumerate(rows)], TEXT)
    got = {r["doc_id"]: [tuple(f) for f in r["found"]] for r in pii.mask_documents(df, "a key").collect()}
    plain = {k: regex.sub("[^0-9A-Z]", "", v[0][2]) for k, v in got.items()}
    assert all(len(v) == 2 and v[0] == v[1] and v[0][0] == ("iban" if k < 2 else "phone") for k, v in got.items())
    assert plain[0] == plain[1] and plain[2] == plain[3] and plain[2][1:] == plain[4] and plain[5] == plain[6] and plain[7] == plain[8]
    assert plain[5].startswith("49") and plain[7].startswith("351")
    names = spark.createDataFrame([(k, f"{c}@x.com") for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")], TEXT)
    made = [r["text"][0] for r in pii.mask_documents(names, "a key").orderBy("doc_id").collect()]
    assert sorted(made) == list("abcdefghijklmnopqrstuvwxyz") and len({(ord(m) - k) % 26 for k, m in enumerate(made)}) > 5
    with pytest.raises(ValueError, match="give a key"):
        pii.mask_documents(names)


# --- op4: the nearest centroid by plain Python ---


def test_nearest_centroid(spark, documents):
    model = langid.fit(langid.labelled(documents))
    got = {r["doc_id"]: r for r in langid.predict(documents.select("doc_id", "text").union(spark.createDataFrame([(9999, None), (9998, "123 ?!")], TEXT)), model).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for doc_id, r in sorted(got.items())[::9] + [(k, got[k]) for k in (9998, 9999)]:
        if not regex.search(r"\p{L}", r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        raw = r["text"].lower().encode()
        letters = [c if 97 <= c <= 122 or c >= 128 else 32 for c in raw] + [32, 32]
        counts = [0] * langid.DIM
        for i in range(len(raw)):
            x, y, z = letters[i : i + 3]
            if y != 32:
                counts[((x | y << 8 | z << 16) * 2654435761 & 0xFFFFFFFF) >> 20] += 1
            if x != 32:
                counts[((x | y << 8 | 1 << 24) * 2246822519 & 0xFFFFFFFF) >> 20] += 1
        vector = [np.log1p(c) * w if c else 0.0 for c, w in zip(counts, model.idf.tolist())]
        norm = dot(vector, vector) ** 0.5
        like = [dot(vector, c) / norm for c in model.centroids.tolist()]
        best = max(range(len(like)), key=like.__getitem__)
        assert abs(r["score"] - like[best]) < 1e-4 and (r["lang_pred"] == model.langs[best] or sorted(like)[-1] - sorted(like)[-2] < 1e-4), doc_id


def test_sample_is_bounded_where_ids_repeat(spark):
    rows = spark.range(4000).select(F.lit(4).cast("long").alias("doc_id"), F.format_string("some words number %d", "id").alias("text"), F.lit("xx").alias("lang"))
    assert langid._sample(rows, 50).count() == 100
    many = spark.range(langid.MOST_LANGUAGES + 1).select("id", F.lit("a text").alias("text"), F.col("id").cast("string").alias("lang")).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError, match="languages"):
        langid.fit(many)


# --- op3: templates of a folder ---


def test_templates_of_a_folder(spark, tmp_path):
    rng = random.Random(12)
    words = [f"term{k}" for k in range(400)]
    whole = {name: " ".join(rng.choice(words) for _ in range(n)) for name, n in (("Long-License-2.0", 2500), ("Other 1.1", 1800))}
    for name, text in whole.items():
        (tmp_path / f"{name}.txt").write_text(text)
    (tmp_path / "empty.txt").write_text(" \n")
    templates = licenses.read_templates(spark, str(tmp_path))
    assert {k: v.strip() for k, v in templates.items()} == whole
    edited = whole["Long-License-2.0"].split()
    for k in range(100, 2500, 400):
        edited[k] = "changed"
    docs = spark.createDataFrame([(1, "before " * 50 + " ".join(edited) + " after" * 50), (2, whole["Other 1.1"]), (3, " ".join(rng.choice(words) for _ in range(3000))), (4, None)], TEXT)
    got = {r["doc_id"]: sorted(x["license"] if "license" in x.asDict() else x[0] for x in r["licenses"]) for r in licenses.scan_licenses(docs, templates).collect()}
    assert got == {1: ["Long-License-2.0"], 2: ["Other 1.1"], 3: [], 4: []}
    with pytest.raises(ValueError, match="at most"):
        licenses.read_templates(spark, str(tmp_path), most_bytes=1000)

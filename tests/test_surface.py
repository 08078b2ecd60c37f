"""Quantiles by ranges, long brand lists, and the engine in SQL."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_features import START, event, frame

from riskloom.functions.text import match_brands
from riskloom.functions.words import WordTrie, lookup
from riskloom.operators import metrics
from riskloom.plans import sql
from riskloom.schema import BRANDS, HOUR_NS


def test_quantiles_equal_percentile(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, 2.5, float(rng.randrange(50))])) for _ in range(300)] + [("c", None), ("d", 7.0)]
    records = spark.createDataFrame(rows, "scorer string, x double")
    at = (0.0, 0.25, 0.5, 0.9, 0.95, 1.0)
    want = {r["scorer"]: r["q"] for r in records.groupBy("scorer").agg(F.percentile("x", F.array(*[F.lit(a) for a in at])).alias("q")).collect()}
    got = {r["scorer"]: r["q"] for r in metrics.quantiles(records, ("scorer",), "x", at).collect()}
    assert got.keys() == want.keys()
    for k, q in want.items():
        assert got[k] == [None] * len(at) if q is None else all(math.isclose(a, b) for a, b in zip(got[k], q, strict=True))
    assert metrics.quantiles(records, (), "x", (0.5,)).first()["q"] == [records.agg(F.percentile("x", F.lit(0.5))).first()[0]]
    assert metrics.quantiles(records.where("x > 1000"), (), "x", (0.5,)).first()["q"] == [None]


def test_a_trie_finds_what_literals_find(spark, monkeypatch):
    words = ["Pay Pal now", "mypaypal", "PayPalSupport desk", "Royal Mail and UPS", "ups and downs", "tik tok, What's App", "paypal webhook", "Netflix fan club", "n3tfl1x", "Bank of America of", "", "of america", None, "Canada  Post"]
    texts = spark.createDataFrame([(w,) for w in words], "text string")
    plain = sorted(map(tuple, match_brands(texts).collect()))
    monkeypatch.setattr("riskloom.functions.text.LITERAL_WORDS", 0)
    assert sorted(map(tuple, match_brands(texts).collect())) == plain
    table = spark.createDataFrame([(n, list(a), s) for n, a, s in BRANDS], "name string, aliases array<string>, case_sensitive boolean")
    assert sorted(map(tuple, match_brands(texts, table).collect())) == plain
    assert set(match_brands(texts, table.limit(0)).select(F.size("name_brands")).collect()) == {(0,)}


def test_a_table_of_brands_is_not_held(spark, monkeypatch):
    """A table's phrases stay with Spark: neither the driver nor a worker's trie gets them."""
    monkeypatch.setattr("riskloom.functions.text.lookup", None)
    monkeypatch.setattr("riskloom.functions.text.brand_words", None)
    table = spark.range(1000).select(F.concat(F.lit("Zz"), "id", F.lit("q")).alias("name"), F.array(F.concat_ws(" ", F.lit("alias of"), "id")).alias("aliases"), (F.col("id") == 7).alias("case_sensitive"))
    texts = spark.createDataFrame([("to Zz5q, alias of 6",), ("to zz7q",), ("to Zz7q",), ("alias of",), ("zz5Q",), ("",)], "text string")
    got = {r["text"]: r["name_brands"] for r in match_brands(texts, table).collect()}
    assert got == {"to Zz5q, alias of 6": ["Zz5q", "Zz6q"], "to zz7q": [], "to Zz7q": ["Zz7q"], "alias of": [], "zz5Q": ["Zz5q"], "": []}


def test_plans_do_not_grow_with_the_list(spark):
    size = lambda n: len(match_brands(spark.createDataFrame([("brand 7 x",)], "text string"), [(f"brand {k} x{k}", (f"alias{k} of",), False) for k in range(n)])._jdf.queryExecution().optimizedPlan().toString())
    assert size(20_000) == size(300)
    trie = WordTrie([(("a", "b"), 1), (("a",), 2), (("b", "c"), 3), ((), 4), (("a", "b"), 5)])
    assert trie.found(["a", "b", "c", "a"]) == [2, 1, 5, 3] and trie.found([]) == []
    with pytest.raises(ValueError, match="are sent at most"):
        lookup(spark, [((str(k),), {"k": k}) for k in range(1000)], "struct<k:int>", None, most=100)


def test_views_and_functions(spark):
    rows = [event(START + k * HOUR_NS, "resource.created", subject=s, id=f"{s}{k}", card_fingerprint_hash="c") for k in range(3) for s in ("a", "b")]
    names = sql.register(frame(spark, rows), "sq_")
    assert "sq_features" in names and "sq_neighbours_of" in names
    tenant = rows[0]["tenant"] if isinstance(rows[0], dict) else spark.table("sq_events").first()["tenant"]
    assert [r["other"] for r in spark.sql(f"SELECT other FROM sq_neighbours_of('{tenant}', 'a')").collect()] == ["b"]
    assert spark.sql(f"SELECT max(core__resource_total) FROM sq_features_of('{tenant}', 'b')").first()[0] == 3
    assert spark.sql("SELECT count(*) FROM sq_subjects_of_key('card_fingerprint_hash', 'c')").first()[0] == 2
    assert {r["tier"] for r in spark.sql(f"SELECT tier FROM sq_verdict_of('{tenant}', 'a')").collect()} <= {"low", "medium", "high"}

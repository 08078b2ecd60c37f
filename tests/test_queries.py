"""Every registered query against its SQL on the smallest tables."""

import pytest
from conftest import canonical

from riskloom.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_mapped_texts_are_whole(spark, sf_dir):
    from riskloom.sources.mapped import mapped_events

    events = mapped_events(spark, sf_dir, texts=True).selectExpr("id", "coalesce(name, subject_line) text").where("text is not null")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("text")
    assert events.where("length(text) > 48").count() and events.join(docs, "text", "left_anti").count() == 0

"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from moodweave import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def ordered(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False)
    return columns, sorted(repr(tuple(v.tolist() if hasattr(v, "tolist") else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, sf, duck, name):
    ours = plans.QUERIES[name](spark, sf).toPandas()
    assert ordered(ours) == ordered(duck.execute(plans.SQL[name]).df())


@pytest.mark.parametrize("name", ["train_lexicon_lr", "embedding_hybrid", "error_samples", "saved_evaluation"])
def test_rows_only(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

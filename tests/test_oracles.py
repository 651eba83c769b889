"""Every registered query with SQL gives the same rows as DuckDB."""

import math

import duckdb
import pytest

from __spark_entry__ import entry
from registry.oracles import oracles
from registry.queries import registered

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registered(), oracles()


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}" if float(x) else "0"
    return str(x)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert {n for n in QUERIES if n not in SQL} == {
        "ranker_fit_score", "ranker_oof", "ranker_oof_map", "ranker_top30",
    }


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, folder, duck):
    ours = QUERIES[name](spark, folder)
    theirs = duck.sql(SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours.columns, ours.collect()) == bag(theirs.columns, theirs.fetchall())


def test_entry_gives_lists_of_twelve(spark):
    rows = entry(spark).collect()
    assert rows and all(len(r["prediction"].split(" ")) == 12 for r in rows)

"""Registered queries against SQL, and the pipeline against its operators' brute force."""

from collections import Counter

import duckdb
from pyspark.sql import functions as F
import pytest

import corpus_pipeline as P
from shelfrank.llm.oracles import oracles
from shelfrank.llm.queries import registered
from test_oracles import NAMES, bag


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def test_one_query_each():
    names = set(registered())
    assert "pipeline" in names and {n.split("_")[0] for n in names - {"pipeline"}} == {f"op{i}" for i in range(1, 14)}
    assert set(oracles()) <= names


@pytest.mark.parametrize("name", sorted(oracles()))
def test_same_rows_as_sql(name, spark, folder, duck):
    ours, theirs = registered()[name](spark, folder), duck.sql(oracles()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours.columns, ours.collect()) == bag(theirs.columns, theirs.fetchall())


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("key", F.when(F.col("doc_id").isNotNull(), "clash"))
    extra = spark.createDataFrame([(None, None, None, None, None, None), (-5, "", "en", None, 0, "x"), (0, "a b", "en", "src0", 3, "x")], docs.schema)
    docs = docs.union(extra)
    from test_jaccard_join import brute as classes

    kept = docs
    for name, stage in P.STAGES[:-1]:
        before = kept.collect()
        after = stage(spark, kept, folder)
        assert after.columns == docs.columns, name
        rows = after.collect()
        if name == "line_dedup":
            assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in before)
            assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"])
        else:
            assert Counter(map(tuple, rows)) <= Counter(map(tuple, before))
        if name == "jaccard_join":
            told = classes([(r["doc_id"], r["text"]) for r in before])
            assert len(rows) == len({c for _, c, n in told if n}) + sum(not n for *_, n in told)
            assert all(n == 0 for *_, n in classes([(r["doc_id"], r["text"]) for r in rows]))
        if name == "benchmark_decontamination":
            items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            clean = [r for r in before if not any(i in " ".join((r["text"] or "").split()) for i in items)]
            assert Counter(map(tuple, rows)) == Counter(map(tuple, clean))
        kept = spark.createDataFrame(rows, docs.schema)
    last = P.STAGES[-1][1](spark, kept, folder)
    assert last.count() == kept.count()


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_run(spark, folder):
    got = P.run(spark, folder)
    assert got.count() == got.select("doc_id").distinct().count() > 0

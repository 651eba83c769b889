"""Packed entries against a plain dictionary, and the plans that carry them."""

import random

from pyspark.sql import functions as F
import pytest

from conftest import plan_of
from registry.queries import registered
from shelfrank.operators.packed import entry_at, pack


def test_lookups_equal_a_dictionary(spark):
    rng = random.Random(3)
    numbers = [0, 1, 62, 63, 64, 127, 128, 6999]
    rows = {(h, k, n): rng.randrange(100) for h in range(6) for k in "ab" for n in numbers + [rng.randrange(300) for _ in range(20)] if rng.random() < 0.6}
    rows |= {(7, "a", 63): 5}
    schema = "home int, kind string, nr int, x int"
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()] + [(0, "a", None, 1), (8, "b", None, 1)], schema)
    own = pack(df, ["home"], "kind", "nr", ["x"], ["a", "b"])
    asked = spark.range(9).select(F.col("id").cast("int").alias("home"), F.explode(F.sequence(F.lit(-1), F.lit(330))).alias("nr"))
    asked = asked.union(asked.select("home", F.lit(6999)).distinct()).union(asked.select("home", F.lit(None).cast("int")).distinct())
    got = asked.join(own, "home", "left").select("home", "nr", *[entry_at(F.col(f"own_{k}"), F.col("nr"))["x"].alias(k) for k in "ab"])
    for r in got.collect():
        assert r["a"] == rows.get((r["home"], "a", r["nr"])) and r["b"] == rows.get((r["home"], "b", r["nr"]))
    assert pack(df.limit(0), ["home"], "kind", "nr", ["x"], ["a", "b"]).count() == 0


@pytest.mark.parametrize("name", ["training_features", "candidate_features_assembled"])
def test_no_map_is_carried(name, spark, folder):
    schemas = []

    def walk(node):
        schemas.append(node.schema().toDDL())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(registered()[name](spark, folder)._jdf.queryExecution().optimizedPlan())
    assert schemas and not any("MAP<" in s.upper() for s in schemas)
    assert "Exchange" in plan_of(registered()[name](spark, folder))

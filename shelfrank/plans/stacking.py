"""Second stage: many models' score tables become one wide, labelled feature table."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.scalars import padded_id, split_ids
from shelfrank.operators.joins import lookup
from shelfrank.operators.pivots import pivot_scores, with_score_stats
from shelfrank.operators.topk import top_k, with_rank_and_z
from shelfrank.params import RecoParams
from shelfrank.plans.catalogue import stack_policy
from shelfrank.plans.clean import enrich
from shelfrank.plans.metrics import best_first


@dataclass(frozen=True)
class ScoreFormat:
    """How one model stores its scores."""

    model: str
    score: str = "pred"
    drop: tuple[str, ...] = ()
    not_scored: float | None = None  # score that stands for "no score"


def normalise(table: DataFrame, fmt: ScoreFormat) -> DataFrame:
    """One canonical table: customer, padded article id, ``pred`` and ``model``."""
    rows = table.drop(*fmt.drop).withColumnRenamed(fmt.score, "pred")
    if fmt.not_scored is not None:
        # a missing score is kept, as is any other value
        rows = rows.where(~F.col("pred").eqNullSafe(F.lit(fmt.not_scored)))
    return rows.select(
        "customer_id",
        padded_id("article_id").alias("article_id"),
        F.col("pred").cast("double").alias("pred"),
        F.lit(fmt.model).alias("model"),
    )


def normalise_all(tables: dict[str, DataFrame], formats: list[ScoreFormat]) -> DataFrame:
    parts = [normalise(tables[f.model], f) for f in formats]
    return reduce(DataFrame.unionByName, parts)


def from_lists(table: DataFrame, listed: str, model: str) -> DataFrame:
    """Scores from space-joined ranked lists: the first article scores 0, the next -1, ..."""
    each = table.select("customer_id", F.posexplode(split_ids(listed)).alias("place", "article_id"))
    return each.select(
        "customer_id",
        padded_id("article_id").alias("article_id"),
        (-F.col("place")).cast("double").alias("pred"),
        F.lit(model).alias("model"),
    )


def long_stack(scores: DataFrame, params: RecoParams) -> DataFrame:
    """Best rows per model and customer with rank and z-score. All models go through the same
    two windows on one partitioning."""
    by = ["model", "customer_id"]
    return with_rank_and_z(top_k(scores, by, best_first(), params.stack_top), by, "pred")


def wide_stack(stack: DataFrame, models: list[str]) -> DataFrame:
    return with_score_stats(pivot_scores(stack, models), models)


def with_article_counts(wide: DataFrame, by_article: DataFrame, params: RecoParams) -> DataFrame:
    """Article counts beside each row, then the fill rules (rank fills come after the row-wise
    statistics, so those see missing ranks as missing)."""
    return stack_policy(params).apply(lookup(wide, by_article, "article_id"))


def stack_features(
    wide: DataFrame,
    by_article: DataFrame,
    articles: DataFrame,
    customers: DataFrame,
    params: RecoParams,
) -> DataFrame:
    """Attributes and counts; article keys on both sides are padded text."""
    rows = enrich(wide, articles, customers, bins=True)
    return with_article_counts(rows, by_article, params)


def with_stack_label(rows: DataFrame, bought: DataFrame) -> DataFrame:
    """``target`` 1 where the customer bought the article in the label week. Purchases are made
    distinct first, so no row is doubled."""
    hits = bought.select("customer_id", "article_id").distinct().withColumn("target", F.lit(1))
    return lookup(rows, hits, ["customer_id", "article_id"]).fillna(0, subset=["target"])

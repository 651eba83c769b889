"""Popular articles, candidates, labels and the training set."""

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.lookback import label_period, popular_period, replay
from shelfrank.functions.scalars import label_weight
from shelfrank.operators.dedup import positive_wins
from shelfrank.operators.joins import bounded, dealt_for, keep_keys, longest, pair_with_list
from shelfrank.operators.sample import draw_places
from shelfrank.operators.topk import top_k, top_n
from shelfrank.params import RecoParams


def _by_count() -> list:
    return [F.desc("cnt"), F.asc("article_id")]


def popular_articles(
    trans: DataFrame, ds: date, params: RecoParams, include_label_week: bool = False
) -> DataFrame:
    """The most bought articles of the popularity window with their position from 1."""
    seen = popular_period(trans, ds, params, include_label_week)
    counts = seen.groupBy("article_id").agg(F.count("*").alias("cnt"))
    return top_n(counts, params.n_popular, _by_count(), "position")


def popular_by_week(trans: DataFrame, after_last: date, params: RecoParams) -> DataFrame:
    """The same for every replayed week, the label week included. Purchases are counted per
    article and day before a day is handed to the weeks that see it."""
    daily = trans.groupBy("article_id", "t_dat").agg(F.count("*").alias("_n"))
    weekly = replay(daily, after_last, params, 1 - params.label_days, params.popular_lead_days)
    counts = weekly.groupBy("week", "article_id").agg(F.sum("_n").alias("cnt"))
    return top_k(counts, ["week"], _by_count(), params.n_popular, "position")


def label_customers(trans: DataFrame, ds: date, params: RecoParams) -> DataFrame:
    return label_period(trans, ds, params).select("customer_id").distinct()


def customers_by_articles(
    customers: DataFrame, listed: DataFrame, params: RecoParams
) -> DataFrame:
    """Candidates stay where their customer is dealt to; customers are few and small, so the number of
    parts follows the candidates."""
    n_listed = longest(listed, "position")
    dealt = dealt_for(customers, ["customer_id"], n_listed)
    return pair_with_list(dealt, listed, "position", params.block, "customer_id", n_listed=n_listed)


def _listed(popular: DataFrame, params: RecoParams) -> DataFrame:
    return bounded(popular, params.n_popular * params.n_weeks)


def positives(
    trans: DataFrame, popular: DataFrame, after_last: date, params: RecoParams
) -> DataFrame:
    """Label-week purchases of popular articles, one per customer and article and week."""
    bought = replay(trans, after_last, params, 1 - params.label_days, 0)
    kept = keep_keys(bought, _listed(popular.select("week", "article_id"), params), ["week", "article_id"])
    pairs = kept.select("week", "customer_id", "article_id").distinct()
    return pairs.withColumn("target", label_weight("week", params.label_decay))


def negatives(positive: DataFrame, popular: DataFrame, params: RecoParams) -> DataFrame:
    """Popular articles drawn without replacement for every customer who bought that week."""
    buyers = positive.select("week", "customer_id").distinct()
    sizes = popular.groupBy("week").agg(F.max("position").alias("_size"))
    drawn = draw_places(
        buyers.join(bounded(sizes, params.n_weeks), "week"),
        "customer_id", "week", "_size", params.n_negatives, params.seed, "position",
    )
    places = _listed(popular.select("week", "position", "article_id"), params)
    return drawn.join(places, ["week", "position"]).select(
        "week", "customer_id", "article_id", F.lit(0.0).alias("target")
    )


def training_set(
    trans: DataFrame, popular: DataFrame, after_last: date, params: RecoParams
) -> DataFrame:
    """Labelled rows of all weeks; the newest week is held out for validation."""
    bought = positives(trans, popular, after_last, params)
    rows = positive_wins(bought, negatives(bought, popular, params), ["week", "customer_id", "article_id"])
    return rows.withColumn("part", F.when(F.col("week") == 0, "validation").otherwise("train"))

"""From transactions to ranked lists."""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.lookback import history, label_period, purchases_after, replay, replayed_span, window_lengths
from shelfrank.functions.scalars import padded_id
from shelfrank.operators.joins import bounded, keep_keys, lookup, pair_with_list
from shelfrank.operators.topk import top_k, top_n
from shelfrank.params import RecoParams
from shelfrank.plans.assembly import Inputs, given_candidates
from shelfrank.plans.features import pair_activity
from shelfrank.plans.metrics import best_first

PAIR = ["customer_id", "article_id"]


def inputs_at(
    trans: DataFrame, articles: DataFrame, customers: DataFrame, targets: DataFrame,
    listed: DataFrame, ds: date, params: RecoParams, extra_day: int = 0,
    pairs: DataFrame | None = None,
) -> Inputs:
    """Feature inputs at one reference day."""
    lengths = window_lengths(params, extra_day)
    hist = history(trans, ds, lengths["hist"])
    if pairs is None:
        pairs = pair_activity(hist, lengths, [])
    return Inputs(
        hist, pairs, targets, listed, articles, customers, lengths, params, [], params.n_popular
    )


def weekly_pairs(trans: DataFrame, after_last: date, params: RecoParams) -> DataFrame:
    """Purchases per customer and article within the history of every replayed week."""
    lengths = window_lengths(params)
    return pair_activity(replay(trans, after_last, params, 1, lengths["hist"], PAIR), lengths, ["week"])


def training_features(
    trans: DataFrame, articles: DataFrame, customers: DataFrame, labelled: DataFrame,
    popular: DataFrame, after_last: date, params: RecoParams,
) -> DataFrame:
    """The labelled rows of all replayed weeks with the features known at each week's start."""
    lengths = window_lengths(params)
    replayed = lambda rows, keys, only: replay(rows, after_last, params, 1, lengths["hist"], keys, only)
    x = Inputs(
        replayed_span(trans, after_last, params, 1, lengths["hist"]),
        None,
        labelled.select("week", "customer_id").distinct(),
        popular, articles, customers, lengths, params, ["week"],
        params.n_popular * params.n_weeks, replayed,
    )
    return given_candidates(x, labelled)


def additive_top_k(
    customers: DataFrame, articles: DataFrame, pairs: DataFrame, k: int, n_listed: int
) -> DataFrame:
    """Top k of ``base(article) + bonus(customer, article)`` over all listed articles, without
    scoring all of them.

    ``articles`` has ``base`` and at most ``n_listed`` rows, ``pairs`` has ``bonus >= 0`` where
    it is not 0. An article outside the k best bases can only make the list through a bonus:
    otherwise k articles are at least as good, and win ties by the same rule. So the k best
    bases and the customer's own pairs hold the whole answer."""
    order = [F.desc("base"), F.asc("article_id")]
    head = top_n(articles.select("article_id", "base"), k, order, "position")
    shown = pair_with_list(customers, head, "position", k, "customer_id", n_listed=k).select(
        *PAIR, "base", F.lit(0.0).alias("bonus")
    )
    own = pairs.join(bounded(articles.select("article_id", "base"), n_listed), "article_id").select(
        *PAIR, "base", "bonus"
    )
    scored = shown.unionByName(own).groupBy(*PAIR).agg(
        (F.max("base") + F.max("bonus")).alias("pred")
    )
    return top_k(scored, ["customer_id"], best_first(), k, "place")


def popularity_with_history(
    trans: DataFrame, customers: DataFrame, listed: DataFrame, ds: date,
    params: RecoParams, repeat_weight: float, k: int,
) -> DataFrame:
    """Flagship list: a listed article scores its purchases in the history plus a weight for
    each purchase by the customer."""
    hist = history(trans, ds, params.hist_days)
    bought = keep_keys(hist, bounded(listed.select("article_id"), params.n_popular), "article_id")
    counts = bought.groupBy("article_id").agg(F.count("*").cast("double").alias("base"))
    articles = lookup(listed.select("article_id"), counts, "article_id").fillna(0.0, subset=["base"])
    pairs = keep_keys(bought, customers, "customer_id").groupBy(*PAIR).agg(
        (F.count("*") * F.lit(repeat_weight)).alias("bonus")
    )
    return additive_top_k(customers, articles, pairs, k, params.n_popular)


def ranked_lists(ranked: DataFrame, sep: str = " ") -> DataFrame:
    """One row per customer with the padded ids joined in order; lists hold k ids at most."""
    entry = F.struct("place", padded_id("article_id").alias("id"))
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["id"])
    return ranked.groupBy("customer_id").agg(F.array_join(ordered, sep).alias("prediction"))


def ground_truth(trans: DataFrame, ds: date, params: RecoParams) -> DataFrame:
    """Label-week purchases, one row per customer, article and day."""
    return label_period(trans, ds, params).select("customer_id", "article_id", "t_dat")


def stack_truth(trans: DataFrame, ds: date) -> DataFrame:
    """Labels of the second stage: one row per customer, article and day from ``ds`` on, however late."""
    return purchases_after(trans, ds - timedelta(days=1)).select("customer_id", "article_id", "t_dat")


def ground_truth_lists(trans: DataFrame, ds: date, params: RecoParams) -> DataFrame:
    """The same as one list per customer; an article bought on two days appears twice. Metrics
    use the row form; this is for writing out."""
    rows = ground_truth(trans, ds, params)
    ids = F.sort_array(F.collect_list(padded_id("article_id")))
    lists = rows.groupBy("customer_id").agg(ids.alias("articles"))
    return lists.where(F.size("articles") > 0)


def published(scored: DataFrame, k: int, *tie_break: Column) -> DataFrame:
    """Top k per customer as strings, in customer order."""
    ranked = top_k(scored, ["customer_id"], best_first(*tie_break), k, "place")
    return ranked_lists(ranked).orderBy("customer_id")

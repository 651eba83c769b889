"""Feature tables per key-set.

``pairs`` is the history merged to one row per customer and article (see ``operators.activity``).
It is shuffled once, and every other key-set is rolled up from it; medians and modal days need
the purchases themselves (``hist``). ``ref`` is ``["week"]`` in a replay and empty otherwise.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions.scalars import ratio, weekly_decay
from shelfrank.operators import activity
from shelfrank.operators.joins import bounded
from shelfrank.operators.ordering import Cuts, exact_median, modal_day_age
from shelfrank.operators.packed import pack
from shelfrank.plans.catalogue import (
    AGE_ARTICLE_COUNTS, ARTICLE_COUNTS, ATTRIBUTE_KEYS, CODE_COUNTS, CUSTOMER_COUNTS, PAIR,
    AttributeKey,
)
from shelfrank.params import RecoParams


def pair_activity(hist: DataFrame, lengths: dict[str, int], ref: list[str]) -> DataFrame:
    keys = [*ref, "customer_id", "article_id"]
    return activity.roll_up(activity.measures(hist, lengths, keys), keys)


def named(names: dict[str, str]) -> list[Column]:
    return [F.col(measure).alias(name) for name, measure in names.items()]


def channel_rates(prefix: str) -> list[Column]:
    return [
        ratio("channel_hist", "n_hist").alias(f"{prefix}rate_sales_channel_hist"),
        ratio("channel_recent", "n_recent").alias(f"{prefix}rate_sales_channel_recent"),
    ]


def price_stats(prefix: str, median: bool = True) -> list[Column]:
    stats = [
        ratio("price_sum", "n_hist").alias(f"{prefix}_mean"),
        F.col("price_max").alias(f"{prefix}_max"),
        F.col("price_min").alias(f"{prefix}_min"),
    ]
    return stats + ([F.col(f"{prefix}_median")] if median else [])


def age_stats_aggregates() -> list[Column]:
    """Buyers' ages weighted by purchases. Ages are whole years, so the median keeps at most one
    counter per year of age."""
    counted = F.when(F.col("age").isNotNull(), F.col("n_hist"))
    return [
        (F.sum(F.col("age") * F.col("n_hist")) / F.sum(counted)).alias("art_age_hist_mean"),
        F.percentile("age", F.lit(0.5), F.col("n_hist")).alias("art_age_hist_median"),
        F.max("age").cast("double").alias("art_age_hist_max"),
        F.min("age").cast("double").alias("art_age_hist_min"),
    ]


def article_features(
    pairs: DataFrame, hist: DataFrame, customers: DataFrame, params: RecoParams, ref: list[str],
    cuts: Cuts | None = None, by_day: DataFrame | None = None,
) -> DataFrame:
    """``by_day`` is the history dealt for counts per day, where that differs from ``hist``."""
    keys = [*ref, "article_id"]
    aged = pairs.join(customers.select("customer_id", "age"), "customer_id", "left")
    base = aged.groupBy(*keys).agg(
        *activity.merged(),
        activity.repeat_rate_of_pairs(params.smoothing).alias("rebuy_rate"),
        *age_stats_aggregates(),
    )
    medians = exact_median(hist, keys, "price", "art_price_hist_median", cuts)
    modes = modal_day_age(hist if by_day is None else by_day, keys, "age_days", "art_days_from_mode_buy", "t_dat")
    return base.join(medians, keys, "left").join(modes, keys, "left").select(
        *keys,
        *named(ARTICLE_COUNTS),
        F.col("last_age").alias("art_days_after_buy"),
        F.col("first_age").alias("art_days_from_oldest_buy"),
        "art_days_from_mode_buy",
        *channel_rates("art_"),
        "rebuy_rate",
        *price_stats("art_price_hist"),
        *[f"art_age_hist_{s}" for s in ("mean", "median", "max", "min")],
    )


def code_features(
    pairs: DataFrame, articles: DataFrame, params: RecoParams, ref: list[str]
) -> DataFrame:
    """``pairs`` may be measures of purchases that have the article's code already."""
    keys = [*ref, "product_code"]
    codes = articles.select("article_id", "product_code")
    coded = pairs if "product_code" in pairs.columns else pairs.join(codes, "article_id", "left")
    counts = list(CODE_COUNTS.values())
    per_customer = activity.roll_up(coded, [*keys, "customer_id"], counts)
    rate = activity.repeat_rate_of_pairs(params.smoothing).alias("code_rebuy_rate")
    merged = per_customer.groupBy(*keys).agg(*activity.merged(counts), rate)
    return merged.select(*keys, *named(CODE_COUNTS), "code_rebuy_rate")


def age_group_features(
    pairs: DataFrame, hist: DataFrame, customers: DataFrame, ref: list[str],
    cuts: Cuts | None = None,
) -> DataFrame:
    """A few very large groups: partial sums per task, and the bucketed median. ``hist``, and
    ``pairs`` or measures of purchases, may have the buyers' age_id already."""
    keys = [*ref, "age_id"]
    groups = customers.select("customer_id", "age_id")
    base = activity.roll_up(pairs if "age_id" in pairs.columns else pairs.join(groups, "customer_id", "left"), keys)
    aged = hist if "age_id" in hist.columns else hist.join(groups, "customer_id")
    medians = exact_median(aged, keys, "price", "age_id_price_hist_median", cuts)
    return base.join(medians, keys, "left").select(
        *keys,
        channel_rates("age_id_")[0],
        *price_stats("age_id_price_hist"),
        F.col("n_hist").alias("age_id_n_buy_hist_all"),
    )


def age_group_article_features(
    pairs: DataFrame, customers: DataFrame, ref: list[str]
) -> DataFrame:
    keys = [*ref, "age_id", "article_id"]
    groups = customers.select("customer_id", "age_id")
    counts = list(AGE_ARTICLE_COUNTS.values())
    merged = activity.roll_up(pairs.join(groups, "customer_id", "left"), keys, counts)
    return merged.select(*keys, *named(AGE_ARTICLE_COUNTS))


def customer_features(
    pairs: DataFrame, hist: DataFrame, params: RecoParams, ref: list[str],
    cuts: Cuts | None = None,
) -> DataFrame:
    keys = [*ref, "customer_id"]
    base = pairs.groupBy(*keys).agg(
        *activity.merged(),
        activity.repeat_rate_of_pairs(params.smoothing).alias("cust_rebuy_rate"),
    )
    medians = exact_median(hist, keys, "price", "user_price_hist_median", cuts)
    return base.join(medians, keys, "left").select(
        *keys,
        *channel_rates(""),
        *price_stats("user_price_hist"),
        *named(CUSTOMER_COUNTS),
        "cust_rebuy_rate",
        F.col("last_age").alias("days_after_buy_all"),
        F.col("first_age").alias("days_from_oldest_buy_all"),
    )


def attribute_features(
    act: DataFrame, articles: DataFrame, key: AttributeKey, ref: list[str]
) -> DataFrame:
    """One customer-and-attribute key-set, from purchases or pairs."""
    keys = [*ref, "customer_id", *key.columns]
    if key is not PAIR:
        act = act.join(articles.select("article_id", *key.columns), "article_id", "left")
    merged = activity.roll_up(act, keys, [*key.counts.values(), "last_age"])
    return merged.select(*keys, *named(key.counts), F.col("last_age").alias(key.recency))


def decayed_article_features(
    trans_hist: DataFrame, lengths: dict[str, int]
) -> DataFrame:
    """Counts per article and the weekly decayed count, its age counted from the newest
    purchase in the history."""
    newest = trans_hist.agg(F.max("t_dat")).scalar()
    delay = F.datediff(newest, F.col("t_dat"))
    weighed = trans_hist.withColumn("_weight", weekly_decay(delay))
    age = F.col("age_days")
    return weighed.groupBy("article_id").agg(
        F.count("*").alias("art_buy_hist"),
        F.count_if(age <= lengths["recent"]).alias("art_buy_recent"),
        F.count_if(age <= lengths["yesterday"]).alias("art_buy_yesterday"),
        F.sum("_weight").alias("art_buy_hist_decay"),
    )


# --- lookup tables for the assembled candidate row -------------------------------------------

_ENTRY = ("n_hist", "n_recent", "n_short", "n_mid", "last_age")


def key_text(key: AttributeKey) -> Column:
    """The key as one text, NULL if a part is missing. In two-part keys the first part is a
    number, so the separator cannot occur in it."""
    parts = [F.col(c).cast("string") for c in key.columns]
    return parts[0] if len(parts) == 1 else F.concat(parts[0], F.lit("|"), parts[1])


def article_numbers(articles: DataFrame, listed: DataFrame, max_listed: int) -> DataFrame:
    """One row per article with its number in each key-set, ``nr_<suffix>``; the article itself is the set
    ``art``. Keys are numbered among those of the listed articles, in order; other keys are never
    looked up and have no number. The listed keys are bounded by ``max_listed``, so one task can number a set."""
    sets = {"art": F.col("article_id").cast("string"), **{k.suffix: key_text(k) for k in ATTRIBUTE_KEYS}}
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("set"), key.alias("key")) for s, key in sets.items()]))
    entries = articles.select("article_id", each.alias("entry")).select("article_id", "entry.*").where(F.col("key").isNotNull())
    ids = listed.select("article_id").distinct()
    wanted = entries.join(bounded(ids, max_listed), "article_id", "left_semi").select("set", "key").distinct()
    numbered = wanted.withColumn("nr", F.row_number().over(Window.partitionBy("set").orderBy("key")) - 1)
    kept = entries.join(bounded(numbered, max_listed * len(sets)), ["set", "key"])
    return kept.groupBy("article_id").agg(
        *[F.max(F.when(F.col("set") == s, F.col("nr"))).alias(f"nr_{s}") for s in sets]
    )


def customer_entries(pairs: DataFrame, numbers: DataFrame, ref: list[str]) -> DataFrame:
    """One row per customer with packed entries per key-set (``operators.packed``): number of the key ->
    merged measures.

    Pairs move once, to their customer; the key-sets are then grouped in place. What is held
    per customer is at most one entry per attribute value of the listed articles."""
    home = [*ref, "customer_id"]
    suffixes = ["art", *[k.suffix for k in ATTRIBUTE_KEYS]]
    moved = pairs.join(numbers, "article_id").select(*home, *_ENTRY, *[f"nr_{s}" for s in suffixes]).repartition(*home)
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("set"), F.col(f"nr_{s}").alias("nr")) for s in suffixes]))
    grouped = (
        moved.select(*home, *_ENTRY, each.alias("entry"))
        .select(*home, *_ENTRY, "entry.*")
        .where(F.col("nr").isNotNull())
        .groupBy(*home, "set", "nr")
        .agg(*activity.merged(list(_ENTRY)))
    )
    return pack(grouped, home, "set", "nr", list(_ENTRY), suffixes)


def age_entries(
    age_articles: DataFrame, listed: DataFrame, max_listed: int, ref: list[str]
) -> DataFrame:
    """One row per listed article with packed entries: age group -> counts."""
    keys = [*ref, "article_id"]
    kept = age_articles.join(bounded(listed.select(*keys), max_listed), keys, "left_semi")
    aged = kept.select(*keys, F.lit("age").alias("set"), F.col("age_id").cast("int").alias("nr"), *AGE_ARTICLE_COUNTS)
    return pack(aged, keys, "set", "nr", list(AGE_ARTICLE_COUNTS), ["age"])

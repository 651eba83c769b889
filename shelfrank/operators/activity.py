"""Mergeable purchase measures.

A purchase carries its window flags and measures as numbers that add up (or have a minimum or
maximum). Any grouping of them has the same columns again, so coarser groups are rolled up from
finer ones instead of from the purchases.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED = (
    "n_hist", "n_short", "n_mid", "n_recent", "n_yesterday",
    "n_ch1", "n_ch2", "channel_hist", "channel_recent", "price_sum",
)
SMALLEST = ("last_age", "price_min")
LARGEST = ("first_age", "price_max")


def measures(hist: DataFrame, lengths: dict[str, int], keep: list[str]) -> DataFrame:
    """Measures of single purchases. ``hist`` holds ages from 1 to the longest window."""
    age, channel, price = F.col("age_days"), F.col("sales_channel_id"), F.col("price")

    def inside(window: str) -> Column:
        return (age <= lengths[window]).cast("long")

    recent = age <= lengths["recent"]
    return hist.select(
        *keep,
        F.lit(1).cast("long").alias("n_hist"),
        inside("short").alias("n_short"),
        inside("mid").alias("n_mid"),
        inside("recent").alias("n_recent"),
        inside("yesterday").alias("n_yesterday"),
        (channel == 1).cast("long").alias("n_ch1"),
        (channel == 2).cast("long").alias("n_ch2"),
        channel.cast("long").alias("channel_hist"),
        F.when(recent, channel).otherwise(0).cast("long").alias("channel_recent"),
        price.alias("price_sum"),
        price.alias("price_min"),
        price.alias("price_max"),
        age.alias("last_age"),
        age.alias("first_age"),
    )


def merged(columns: list[str] | None = None) -> list[Column]:
    """Aggregations that merge measures into measures of the same names."""
    wanted = columns or [*ADDED, *SMALLEST, *LARGEST]
    how = {**dict.fromkeys(ADDED, F.sum), **dict.fromkeys(SMALLEST, F.min), **dict.fromkeys(LARGEST, F.max)}
    return [how[c](c).alias(c) for c in wanted]


def roll_up(act: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Groups with a missing key are left out."""
    return act.dropna(subset=keys).groupBy(*keys).agg(*merged(columns))


def repeat_rate(act: DataFrame, keys: list[str], target: str, name: str, smoothing: int) -> DataFrame:
    """Targets met twice or more, divided by distinct targets plus the smoothing term.

    Two levels: purchases per (key, target) first, so that a hot key is spread by target."""
    per_target = act.dropna(subset=keys).groupBy(*keys, target).agg(F.sum("n_hist").alias("n_hist"))
    return per_target.groupBy(*keys).agg(repeat_rate_of_pairs(smoothing).alias(name))


def repeat_rate_of_pairs(smoothing: int) -> Column:
    """The rate as an aggregate over rows that each stand for one distinct target."""
    return F.count_if(F.col("n_hist") >= 2) / (F.count("*") + smoothing)

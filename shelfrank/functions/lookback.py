"""Look-back windows before a reference day, and the weekly replay of several of them.

Every window ends on the day before the reference day, so a purchase is described by its age
in days (1 = yesterday) and a window by its length. A replay gives each purchase one row per
reference week that sees it; the weeks follow from arithmetic on the age, without a range join.
"""

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.params import RecoParams


def window_lengths(params: RecoParams, extra_day: int = 0) -> dict[str, int]:
    """Days per window. ``extra_day=1`` gives the one-day-longer windows used when predicting."""
    return {
        "yesterday": 1,
        "recent": params.recent_days,
        "short": params.short_days + extra_day,
        "mid": params.mid_days + extra_day,
        "hist": params.hist_days + extra_day,
    }


def between_days(trans: DataFrame, first: date, last: date) -> DataFrame:
    """Both ends included; literal bounds so that the scan can skip files."""
    return trans.where(F.col("t_dat").between(F.lit(first), F.lit(last)))


def history(trans: DataFrame, ds: date, days: int) -> DataFrame:
    """Purchases of the ``days`` days before ``ds`` with their age."""
    seen = between_days(trans, ds - timedelta(days=days), ds - timedelta(days=1))
    return seen.withColumn("age_days", F.datediff(F.lit(ds), "t_dat"))


def label_period(trans: DataFrame, ds: date, params: RecoParams) -> DataFrame:
    return between_days(trans, ds, ds + timedelta(days=params.label_days - 1))


def purchases_after(trans: DataFrame, day: date) -> DataFrame:
    """Everything bought later than ``day``, without an end; the literal lets the scan skip files."""
    return trans.where(F.col("t_dat") > F.lit(day))


def popular_period(
    trans: DataFrame, ds: date, params: RecoParams, include_label_week: bool
) -> DataFrame:
    last = ds + timedelta(days=params.label_days - 1) if include_label_week else ds - timedelta(days=1)
    return between_days(trans, last - timedelta(days=params.popular_days - 1), last)


def reference_days(after_last: date, params: RecoParams) -> list[date]:
    """First label day of each replayed week; ``after_last`` is the day after the newest label."""
    return [
        after_last - timedelta(days=7 * i + params.label_days) for i in range(params.n_weeks)
    ]


def _weeks_seeing(age: Column, shortest: int, longest: int, n_weeks: int) -> Column:
    """Weeks i for which ``shortest <= age - 7 i <= longest``, as an array (empty if none).

    ``age`` counts back from the reference day of week 0."""
    low = F.greatest(F.ceil((age - longest) / 7), F.lit(0)).cast("int")
    high = F.least(F.floor((age - shortest) / 7), F.lit(n_weeks - 1)).cast("int")
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def replay(
    trans: DataFrame,
    after_last: date,
    params: RecoParams,
    shortest: int,
    longest: int,
    deal_by: list[str] | None = None,
    only: str | None = None,
) -> DataFrame:
    """One row per purchase and reference week whose window holds it.

    The window is given in days of age: label week ``(-6, 0)``, history ``(1, 366)``, popularity
    with the label week ``(-6, 28)``. Adds ``week`` and ``age_days`` (relative to that week).

    ``deal_by`` shuffles purchases by these keys before they are copied: groups of a week and these keys
    (or more) then need no exchange of the copies. ``only`` names a column with an array of weeks that a
    purchase is wanted for; it is dropped."""
    days = reference_days(after_last, params)
    span = replayed_span(trans, after_last, params, shortest, longest)
    if deal_by:
        span = span.repartition(*deal_by)
    age = F.datediff(F.lit(days[0]), F.col("t_dat"))
    weeks = _weeks_seeing(age, shortest, longest, params.n_weeks)
    if only:
        weeks = F.array_intersect(weeks, F.col(only))
    copied = span.withColumn("week", F.explode(weeks)).withColumn("age_days", age - 7 * F.col("week"))
    return copied.drop(only) if only else copied


def replayed_span(trans: DataFrame, after_last: date, params: RecoParams, shortest: int, longest: int) -> DataFrame:
    """The purchases that some replayed week sees, each once."""
    days = reference_days(after_last, params)
    return between_days(trans, days[-1] - timedelta(days=longest), days[0] - timedelta(days=shortest))


def week_calendar(trans: DataFrame, params: RecoParams) -> DataFrame:
    """Bounds of every window of every replayed week, counted back from the newest purchase."""
    newest = trans.agg(F.max("t_dat").alias("newest"))
    week = F.explode(F.sequence(F.lit(0), F.lit(params.n_weeks - 1)))
    w = newest.select("newest", week.alias("week")).withColumn(
        "ds", F.expr("date_sub(newest, 7 * week + 6)")
    )
    lengths = window_lengths(params)
    return w.select(
        "week",
        "ds",
        F.date_add("ds", params.label_days - 1).alias("de"),
        F.date_sub("ds", 1).alias("der"),
        F.date_sub("ds", lengths["recent"]).alias("dsr"),
        F.date_sub("ds", lengths["short"]).alias("dsh_short"),
        F.date_sub("ds", lengths["mid"]).alias("dsh_mid"),
        F.date_sub("ds", lengths["hist"]).alias("dsh"),
        F.date_sub("ds", params.popular_lead_days).alias("ds_popular"),
    )

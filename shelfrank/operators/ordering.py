"""Order statistics over whole tables or hot groups, without sorting either in one task.

Values are first put into order-preserving buckets cut at approximate quantiles of the whole
column, so a bucket holds about ``1 / n_buckets`` of the rows however they spread over groups. Exact
results then need only bucket totals (few rows) and work inside single buckets. The cuts only
steer balance; they are fetched once (a few hundred numbers) and enter the plan as constants, so
that every branch and every retried task sees the same buckets.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.session import shared_folder

ROWS_PER_PART = 1_000_000  # rows that one task orders


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once and cut its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Cuts:
    """Number of rows and the values that cut a column into about equal parts."""

    rows: int
    bounds: list[float]


def range_cuts(df: DataFrame, c: str, rows_per_part: int = ROWS_PER_PART) -> Cuts:
    """Cuts of a numeric column for one bucket per ``rows_per_part`` rows, 16 at least."""
    rows = df.count()
    n_buckets = 1 << max(4, (rows // rows_per_part).bit_length())
    shares = [i / n_buckets for i in range(1, n_buckets)]
    bounds = df.agg(F.percentile_approx(F.col(c).cast("double"), shares, 8 * n_buckets)).first()[0]
    return Cuts(rows, bounds or [0.0] * (n_buckets - 1))


def with_bucket(df: DataFrame, c: str, name: str, cuts: Cuts) -> DataFrame:
    """Add the order-preserving bucket of a column: how many cuts lie below its value."""
    steps, step = [], (len(cuts.bounds) + 1) // 2
    while step:
        steps.append(F.lit(step))
        step //= 2
    # one text constant keeps the plan short while it is analysed; it is folded to an array
    bounds = F.split(F.lit(",".join(map(repr, cuts.bounds))), ",").cast("array<double>")
    number = F.col(c).cast("double")
    bucket = F.aggregate(  # binary search
        F.array(*steps),
        F.lit(0),
        lambda at, s: F.when(F.get(bounds, at + s - 1) < number, at + s).otherwise(at),
    )
    # never NULL, so that no branch gains a filter of its own and the shuffle can be shared
    return df.withColumn(name, F.coalesce(bucket, F.lit(0)))


def number_rows(
    df: DataFrame, order: list[tuple[str, bool]], name: str, rows_per_part: int = ROWS_PER_PART,
) -> DataFrame:
    """Number all rows from 1 in the order of (column, ascending) pairs, which should leave no ties.

    Rows are dealt into ranges of the whole order (Spark samples the bounds), the sizes of the ranges
    are summed up in one place, and rows are ordered within their range."""
    sort = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    rows = settle(df)
    parts = rows.count() // rows_per_part + 1
    dealt = settle(rows.repartitionByRange(parts, *sort).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("_part").orderBy(*sort)
    return (
        dealt.join(offsets, "_part")
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_before", "_part")
    )


def exact_median(
    df: DataFrame, keys: list[str], value: str, name: str, cuts: Cuts | None = None,
) -> DataFrame:
    """Exact median per group; a group may hold most of the table. ``cuts`` may come from any table
    that holds these rows.

    Equal values are merged into counts before the shuffle, bucket totals locate the bucket of
    the middle ranks, and only that bucket's values are ordered."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v"))
    for c in rows.columns:
        rows = rows.where(F.col(c).isNotNull())
    cuts = cuts or range_cuts(rows, "_v")
    counts = (
        with_bucket(rows, "_v", "_bucket", cuts)
        .groupBy(*keys, "_bucket", "_v")
        .agg(F.count("*").alias("_n"))
    )
    group = Window.partitionBy(*keys)
    totals = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("_n").alias("_in"))
        .withColumns(
            {
                "_upto": F.sum("_in").over(group.orderBy("_bucket")),
                "_all": F.sum("_in").over(group),
            }
        )
        .select(
            *keys,
            "_bucket",
            (F.col("_upto") - F.col("_in")).alias("_before"),
            "_upto",
            F.floor((F.col("_all") - 1) / 2).alias("_low"),
            F.floor(F.col("_all") / 2).alias("_high"),
        )
    )

    def holds(rank: str, first: str, end: str) -> Column:
        return (F.col(first) <= F.col(rank)) & (F.col(rank) < F.col(end))

    middle = totals.where(holds("_low", "_before", "_upto") | holds("_high", "_before", "_upto"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_v")
    ranked = (
        counts.join(middle.drop("_upto"), [*keys, "_bucket"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inside))
        .withColumn("_first", F.col("_end") - F.col("_n"))
    )
    return (
        ranked.groupBy(*keys)
        .agg(
            F.max(F.when(holds("_low", "_first", "_end"), F.col("_v"))).alias("_a"),
            F.max(F.when(holds("_high", "_first", "_end"), F.col("_v"))).alias("_b"),
        )
        .select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))
    )


DAYS = 1 << 20  # more than any age


def modal_day_age(df: DataFrame, keys: list[str], age: str, name: str, day: str | None = None) -> DataFrame:
    """Age of the day with most rows per group; the latest of tied days. Count and age are packed
    into one number, so that the maximum is found by hashing. ``day`` names a column with the day itself,
    for rows that are dealt by it."""
    daily = df.groupBy(*keys, day or age).agg(F.count("*").alias("_n"), F.min(age).alias("_age"))
    best = F.max(F.col("_n") * DAYS - F.col("_age"))
    return daily.groupBy(*keys).agg(best.alias("_best")).select(
        *keys, F.pmod(-F.col("_best"), F.lit(DAYS)).cast("int").alias(name)
    )

"""Top rows per table or group, ranks and standard scores within small groups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.functions.scalars import ratio


def top_n(df: DataFrame, n: int, order: list[Column], position: str) -> DataFrame:
    """The first n rows of a table, numbered from 1 (the window sees n rows at most)."""
    return df.orderBy(*order).limit(n).withColumn(
        position, F.row_number().over(Window.orderBy(*order))
    )


def top_k(
    df: DataFrame, by: list[str], order: list[Column], k: int, position: str | None = None
) -> DataFrame:
    """The first k rows per group. The filter on the row number lets Spark cut every input
    partition to k rows per group before the shuffle, however large a group is."""
    at = position or "_at"
    kept = df.withColumn(at, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    kept = kept.where(F.col(at) <= k)
    return kept if position else kept.drop(at)


def fold_top_k(
    kept: DataFrame | None, block: DataFrame, by: list[str], order: list[Column], k: int
) -> DataFrame:
    """Merge newly scored rows into the rows kept so far. The k best of a union are among the
    k best of its parts, so folding block by block equals one pass over everything."""
    rows = block if kept is None else kept.unionByName(block)
    return top_k(rows, by, order, k)


def with_rank_and_z(df: DataFrame, by: list[str], score: str) -> DataFrame:
    """Dense rank (best first) and z-score with the sample deviation, within groups that were
    cut to a few rows before. One-row and constant groups get NULL."""
    group = Window.partitionBy(*by)
    gap = F.col(score) - F.avg(score).over(group)
    return df.withColumns(
        {
            f"{score}_rank": F.dense_rank().over(group.orderBy(F.desc(score))),
            f"{score}_norm": ratio(gap, F.stddev_samp(score).over(group)),
        }
    )

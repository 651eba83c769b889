"""Duplicate removal and audits."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(
    df: DataFrame, keys: list[str], order: list[Column], payload: list[str], unique: bool = False
) -> DataFrame:
    """Keep one row per key: the first in the given order.

    Written as a minimum rather than a window, so that copies are merged before the shuffle and
    a key with very many copies never meets in one task. ``unique`` states that ``order`` is one
    number that only equal rows of a key share; rows are then merged by hashing, without a sort."""
    if unique:
        return df.groupBy(*keys).agg(*[F.min_by(c, order[0]).alias(c) for c in payload])
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *payload))
    return df.groupBy(*keys).agg(first.alias("_first")).select(
        *keys, *[F.col(f"_first.{c}").alias(c) for c in payload]
    )


def alone_and_shared(df: DataFrame, keys: list[str], member: str) -> tuple[DataFrame, DataFrame]:
    """Rows (keys, member) parted by whether theirs is the only member of its key: the first table holds each
    such row once, the second all rows of the other keys. Rows without a member may be left out.

    Both come from the first and last member per key, so a key with very many rows never meets in one task."""
    ends = df.groupBy(*keys).agg(F.min(member).alias("_first"), F.max(member).alias("_last"))
    alone = ends.where(F.col("_first") == F.col("_last")).select(*keys, F.col("_first").alias(member))
    several = ends.where(F.col("_first") < F.col("_last")).select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return alone, df.select(*keys, member).join(several, same, "left_semi")


def duplicate_audit(df: DataFrame, keys: list[str], per: str) -> DataFrame:
    """Number of keys and of keys with more than one row, per table name."""
    sizes = df.groupBy(per, *keys).agg(F.count("*").alias("_n"))
    return sizes.groupBy(per).agg(
        F.count("*").alias("n_keys"),
        F.sum("_n").alias("n_rows"),
        F.count_if(F.col("_n") > 1).alias("n_duplicated"),
    )


def positive_wins(positives: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """Union of labelled rows, one row per key with its highest target."""
    both = positives.unionByName(negatives)
    return both.groupBy(*keys).agg(F.max("target").alias("target"))

"""Encodings of a column by frequency or order, mean fill, and type narrowing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.operators.ordering import number_rows


def value_counts(df: DataFrame, c: str, name: str = "cnt") -> DataFrame:
    """Rows per value; missing values are not counted."""
    return df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias(name))


def map_values(df: DataFrame, c: str, table: DataFrame, name: str) -> DataFrame:
    """Look the column up in a two-column table ``(c, name)``; no match stays NULL."""
    return df.join(table.select(c, name), c, "left")


def count_encode(df: DataFrame, c: str, name: str) -> DataFrame:
    return map_values(df, c, value_counts(df, c, name), name)


def frequency_codes(counts: DataFrame, c: str, name: str, rare_limit: int) -> DataFrame:
    """Code table: 0 for values seen ``rare_limit`` times or less, the others 1, 2 ... by
    falling count (ties in value order)."""
    common = counts.where(F.col("cnt") > rare_limit)
    ranked = number_rows(common, [("cnt", False), (c, True)], name)
    rare = counts.where(F.col("cnt") <= rare_limit).select(c, "cnt", F.lit(0).cast("long").alias(name))
    return rare.unionByName(ranked.select(c, "cnt", name))


def ordinal_codes(df: DataFrame, c: str, name: str) -> DataFrame:
    """Code table: the distinct values numbered 0, 1 ... in sorted order."""
    values = df.where(F.col(c).isNotNull()).select(c).distinct()
    ranked = number_rows(values, [(c, True)], name)
    return ranked.select(c, (F.col(name) - 1).cast("int").alias(name))


def ordinal_encode(df: DataFrame, c: str) -> DataFrame:
    coded = map_values(df, c, ordinal_codes(df, c, "_code"), "_code")
    return coded.drop(c).withColumnRenamed("_code", c)


def mean_filled(df: DataFrame, c: str) -> Column:
    """The column with the table's mean in place of NULL."""
    return F.coalesce(F.col(c).cast("double"), df.agg(F.avg(c)).scalar())


# fixed values: a type is taken only if the values lie strictly inside its range
INT_TYPES = [("tinyint", 127), ("smallint", 32767), ("int", 2147483647)]


def _numeric_columns(df: DataFrame) -> list[tuple[str, bool]]:
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    return [
        (f.name, isinstance(f.dataType, whole))
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType)
    ]


def narrowing_report(df: DataFrame) -> DataFrame:
    """One row per numeric column: its extremes and the smallest type that holds them.

    One aggregation over the whole table, then its single row is turned on its side."""
    cols = _numeric_columns(df)
    extremes = [F.min(c).alias(f"{c}__lo") for c, _ in cols] + [
        F.max(c).alias(f"{c}__hi") for c, _ in cols
    ]
    one = df.agg(*extremes)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(whole).alias("whole"),
                    F.col(f"{c}__lo").cast("double").alias("min_value"),
                    F.col(f"{c}__hi").cast("double").alias("max_value"),
                )
                for c, whole in cols
            ]
        )
    )
    kind = F.when(~F.col("whole"), "float")
    for name, limit in INT_TYPES:
        kind = kind.when(
            (F.col("min_value") > -limit - 1) & (F.col("max_value") < limit), name
        )
    return one.select(rows.alias("r")).select("r.*").select(
        "column_name", "min_value", "max_value", kind.otherwise("bigint").alias("chosen_type")
    )


def narrow(df: DataFrame) -> DataFrame:
    """Cast every numeric column to its smallest type (the report has one row per column)."""
    chosen = {r["column_name"]: r["chosen_type"] for r in narrowing_report(df).collect()}
    return df.select(
        *[F.col(c).cast(chosen[c]).alias(c) if c in chosen else F.col(c) for c in df.columns]
    )

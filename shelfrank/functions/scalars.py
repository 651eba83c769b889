"""Column expressions. All of them stay inside code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded_id(c: Column | str, width: int = 10) -> Column:
    """Left-pad an id with zeros; ids already longer are left whole."""
    text = col_of(c).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def split_ids(c: Column | str) -> Column:
    return F.split(col_of(c), " ")


def join_ids(c: Column | str) -> Column:
    return F.array_join(col_of(c), " ")


def parse_day(c: Column | str) -> Column:
    return F.to_date(col_of(c), "yyyy-MM-dd")


def format_day(c: Column | str) -> Column:
    return F.date_format(col_of(c), "yyyy-MM-dd")


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that gives NULL for a zero denominator."""
    return F.try_divide(col_of(top).cast("double"), col_of(bottom).cast("double"))


def round_half_up(c: Column | str, digits: int) -> Column:
    """``F.round`` of a double, which goes over the number's text: here only where the whole part is long
    or the rest is near a half. Else the nearest whole number of units is divided exactly as that text is read."""
    x, unit = col_of(c), F.lit(float(10**digits))
    scaled = x * unit
    whole = F.rint(scaled)
    plain = (F.abs(scaled) < float(1 << 40)) & (F.abs(scaled - whole) < 0.499)
    return F.when(plain, whole / unit + 0.0).otherwise(F.round(x, digits))


def weekly_decay(days: Column | str) -> Column:
    """Weight 1, 1/2, 1/3 ... for purchases 0, 1, 2 ... whole weeks old."""
    return F.lit(1.0) / (F.lit(1) + F.floor(col_of(days) / 7))


def label_weight(week: Column | str, decay: float) -> Column:
    return F.lit(1.0) - F.lit(decay) * col_of(week)


def flag_if(c: Column | str, value: str) -> Column:
    """1 where the column has the value; NULL counts as 0."""
    return F.when(col_of(c) == value, 1).otherwise(0)


def flag_unless(c: Column | str, value: str) -> Column:
    """0 where the column has the value; NULL counts as 1."""
    return F.when(col_of(c) == value, 0).otherwise(1)


def capped_bin(c: Column | str, cap: int, width: int) -> Column:
    return F.floor(F.least(col_of(c), F.lit(cap)) / width).cast("int")


def null_safe_sum(cols: list[str]) -> Column:
    """Row-wise sum that reads NULL as 0."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return total


def row_min(cols: list[str]) -> Column:
    return F.least(*cols) if len(cols) > 1 else F.col(cols[0])


def row_max(cols: list[str]) -> Column:
    return F.greatest(*cols) if len(cols) > 1 else F.col(cols[0])


def row_count(cols: list[str]) -> Column:
    """Number of columns that are not NULL."""
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def average_precision(actual: Column | str, predicted: Column | str, k: int) -> Column:
    """AP@k of one list pair. Repeated predictions count once (at their first place) but keep
    taking up places; repeated truths count in the denominator."""
    truth = F.coalesce(col_of(actual), F.array().cast("array<string>"))
    shown = F.slice(col_of(predicted), 1, k)
    hit_places = F.filter(
        F.transform(
            shown,
            lambda item, i: F.when(
                F.array_contains(truth, item) & (F.array_position(shown, item) == i + 1), i + 1
            ),
        ),
        lambda place: place.isNotNull(),
    )
    return precision_from_places(hit_places, F.size(truth), F.lit(k))


def precision_from_places(places: Column, n_actual: Column, k: Column) -> Column:
    """AP@k from the sorted 1-based places of the hits and the number of truths."""
    total = F.aggregate(
        F.transform(places, lambda place, i: (i + 1).cast("double") / place),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(
        F.coalesce(n_actual, F.lit(0)) > 0, total / F.least(n_actual, k)
    ).otherwise(F.lit(0.0))

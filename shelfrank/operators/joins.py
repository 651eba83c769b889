"""Key lookups, membership filters and the pairing of rows with a bounded list."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.operators.ordering import settle

# A table is only sent to every executor when the caller knows a bound on its rows, and the bound
# times the width of a row is at most this. Tables whose size depends on the data carry no hint: Spark measures them at
# run time and broadcasts, sort-merges or splits a skewed partition accordingly.
BROADCAST_BYTES = 128 * 1024 * 1024
VALUE_BYTES = 400  # a dozen attributes, some of them text
KEY_BYTES = 160  # a row of two text keys and a few numbers
SPREAD = 64
ROWS_PER_TASK = 1_000_000  # rows that one task makes


def lookup(df: DataFrame, dim: DataFrame, on: str | list[str], check: bool = False) -> DataFrame:
    """Left join to a table with one row per key: keeps every row of ``df`` once."""
    keys = [on] if isinstance(on, str) else list(on)
    if check:
        require_unique(dim, keys)
    return df.join(dim, keys, "left")


def distinct_values(dim: DataFrame, key: str, columns: list[str], name: str, row_bytes: int = VALUE_BYTES) -> tuple[DataFrame, DataFrame] | None:
    """The attributes of a table split off it: ``key`` with the number ``name`` of its attributes, and these once per
    number, with a broadcast hint. None where too many differ for that.

    Rows that are shuffled on after a lookup then carry a number in place of the attributes. Values that differ are
    numbered by the least key that has them."""
    values = settle(dim.where(F.col(key).isNotNull()).groupBy(*columns).agg(F.min(key).alias(name)))
    if not fits(values.count(), row_bytes):
        return None
    there = values.select(F.col(name), *[F.col(c).alias(f"_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])
    return dim.select(key, *columns).join(F.broadcast(there), same).select(key, name), F.broadcast(values)


def require_unique(dim: DataFrame, keys: list[str]) -> None:
    if not dim.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"more than one row per {keys}")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def fits(max_rows: int, row_bytes: int = KEY_BYTES) -> bool:
    return max_rows * row_bytes <= BROADCAST_BYTES


def bounded(df: DataFrame, max_rows: int, row_bytes: int = KEY_BYTES) -> DataFrame:
    """Broadcast hint for a table with at most ``max_rows`` rows, if that is small enough."""
    return F.broadcast(df) if fits(max_rows, row_bytes) else df


def longest(listed: DataFrame, position: str) -> int:
    """The largest position of a list."""
    return listed.agg(F.max(position)).first()[0] or 0


def dealt_for(rows: DataFrame, keys: list[str], copies: int, counted: DataFrame | None = None) -> DataFrame:
    """Rows that grow to ``copies`` each, dealt by keys into as many parts as what comes out needs: Spark would
    size them by what goes in. ``counted`` has as many rows and is cheaper to count."""
    made = (rows if counted is None else counted).count() * copies
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-made // ROWS_PER_TASK))
    return rows.repartition(parts, *keys)


def pair_with_list(
    rows: DataFrame, listed: DataFrame, position: str, block: int, spread_by: str,
    row_bytes: int = KEY_BYTES, n_listed: int | None = None,
) -> DataFrame:
    """Give every row of ``rows`` every entry of a list.

    ``position`` numbers the list from 1. Its largest value is looked up, so ``listed`` should be a
    stored or settled table, unless the caller knows it (``n_listed``). Rows are expanded per block of the list and meet its
    entries through an equi-join on the block number, so ``rows`` is neither moved nor sorted
    while the list is small enough to broadcast. A longer list is copied ``SPREAD`` times and
    joined by shuffle, which spreads each block over as many tasks."""
    if n_listed is None:
        n_listed = longest(listed, position)
    n_blocks = max(1, -(-n_listed // block))
    left = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = listed.withColumn("_block", F.floor((F.col(position) - 1) / block).cast("int"))
    if fits(n_listed, row_bytes):
        return left.join(F.broadcast(right), "_block").drop("_block")
    left = left.withColumn("_part", F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int"))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.join(right, ["_block", "_part"]).drop("_block", "_part")

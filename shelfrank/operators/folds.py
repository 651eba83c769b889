"""Group numbers and grouped folds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.operators.joins import bounded
from shelfrank.operators.ordering import number_rows


def consecutive_group_ids(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per distinct key: its size and its number 0, 1 ... in key order."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("group_size"))
    numbered = number_rows(sizes, [(k, True) for k in keys], name)
    return numbered.withColumn(name, F.col(name) - 1)


def hash_folds(df: DataFrame, key: str, n_folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Fold by key hash: no shuffle, all rows of a key together. A missing key is hashed as empty text."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}"))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.withColumn(name, (number % n_folds).cast("int"))


def fill_lightest(sizes: list[tuple[int, int]], n_folds: int) -> list[tuple[int, int, list[int]]]:
    """Groups given as (size, number of groups), largest first, one after another put into the lightest fold
    (ties: the first). Rows (size, place of the first group among those of its size, folds in turn).

    Groups of one size are dealt in a few steps, however many they are: folds that are lighter than the
    lightest one will be after its next group take turns until the next fold is reached."""
    loads, told = [0] * n_folds, []
    for size, left in sizes:
        place = 0
        while left:
            least = min(loads)
            turn = sorted((load, fold) for fold, load in enumerate(loads) if load < least + size)
            others = [load for load in loads if load >= least + size]
            rounds = min((min(others) - least) // size if others else left, left // len(turn))
            order = [fold for _, fold in turn]
            told.append((size, place, order))
            dealt = rounds * len(order) or left  # the last groups do not fill a round
            for i, fold in enumerate(order):
                loads[fold] += size * (rounds or (i < dealt))
            place, left = place + dealt, left - dealt
    return told


def balanced_folds(df: DataFrame, key: str, n_folds: int, name: str = "fold") -> DataFrame:
    """Fold per key so that folds get about as many rows: keys by falling size (ties: the key) go to the
    fold with the fewest rows so far. One row per key.

    Only the number of keys of each size reaches the driver; n rows have fewer than sqrt(2 n) different
    sizes. A key finds its fold by its place among the keys of its size."""
    sizes = df.groupBy(key).agg(F.count("*").alias("group_size"))
    dealt = number_rows(sizes, [("group_size", False), (key, True)], "_place")
    histogram = [tuple(r) for r in sizes.groupBy("group_size").count().orderBy(F.desc("group_size")).collect()]
    told, before = fill_lightest(histogram, n_folds), {}
    seen = 0
    for size, n in histogram:
        before[size], seen = seen, seen + n
    spark = df.sparkSession
    rows = [(size, before[size] + place, order) for size, place, order in told]
    steps = spark.createDataFrame(rows, "group_size long, _from long, _order array<int>")
    per_size = steps.groupBy("group_size").agg(F.sort_array(F.collect_list(F.struct("_from", "_order"))).alias("_steps"))
    found = dealt.join(bounded(per_size, len(histogram), 64 * (n_folds + 1)), "group_size")
    at = F.col("_place") - 1
    step = F.element_at(F.filter("_steps", lambda s: s["_from"] <= at), -1)
    fold = F.get(step["_order"], ((at - step["_from"]) % F.size(step["_order"])).cast("int"))
    return found.select(key, "group_size", fold.alias(name))

"""Ranking quality: AP@k and MAP@k, recall and coverage of candidates.

Truth is a table of (customer, article) rows, one per purchase day, and never a list: hits are
found by grouping, so a customer with very many purchases stays spread out.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.scalars import precision_from_places, ratio
from shelfrank.operators.topk import top_k


def best_first(*more: Column) -> list[Column]:
    """Order by score, then the given columns, with the article id to settle ties."""
    return [F.desc("pred"), *more, F.asc("article_id")]


def average_precision(
    predicted: DataFrame, truth: DataFrame, ks: int | list[int], by: list[str] | None = None
) -> DataFrame:
    """AP@k for every customer that has predictions, one row per customer and ``k``.

    ``predicted`` has ``place`` from 1; a repeated article counts at its first place, a truth
    bought on two days counts twice in the denominator, a customer without truth gets 0. ``by``
    adds keys (say, a cut-off) that both tables carry. Several ``ks`` share one grouping."""
    ks = [ks] if isinstance(ks, int) else sorted(ks)
    home = [*(by or []), "customer_id"]
    keys = [*home, "article_id"]
    shown = predicted.where(F.col("place") <= ks[-1]).select(
        *keys, F.col("place").cast("int"), F.lit(0).cast("long").alias("bought")
    )
    bought = truth.select(*keys, F.lit(None).cast("int").alias("place"), F.lit(1).cast("long").alias("bought"))
    per_article = shown.unionByName(bought).groupBy(*keys).agg(
        F.min("place").alias("place"), F.sum("bought").alias("bought")
    )
    hit = F.when(F.col("bought") > 0, F.col("place"))
    per_customer = per_article.groupBy(*home).agg(
        F.sort_array(F.collect_list(hit)).alias("_all"),
        F.sum("bought").alias("n_actual"),
        F.count("place").alias("n_predicted"),
    )
    per_k = per_customer.where(F.col("n_predicted") > 0).withColumn(
        "k", F.explode(F.array(*[F.lit(k) for k in ks]))
    )
    return per_k.withColumn("_places", F.filter("_all", lambda p: p <= F.col("k"))).select(
        *home,
        "k",
        "n_actual",
        F.size("_places").cast("long").alias("n_hits"),
        precision_from_places(F.col("_places"), F.col("n_actual"), F.col("k")).alias("ap"),
    )


def mean_average_precision(
    scored: DataFrame, truth: DataFrame, ks: int | list[int], order: list[Column] | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """MAP@k of scored candidates: rank, cut, average over customers (per ``by`` if given)."""
    keys = by or []
    longest = ks if isinstance(ks, int) else max(ks)
    shown = top_k(scored, [*keys, "customer_id"], order or best_first(), longest, "place")
    return average_precision(shown, truth, ks, by).groupBy(*keys, "k").agg(
        F.avg("ap").alias("map_at_k"), F.count("*").alias("n_customers")
    )


def map_by_cutoff(
    scored: DataFrame, truth: DataFrame, cutoffs: list[int], k: int, position: str = "position"
) -> DataFrame:
    """MAP@k when only the first n listed articles are candidates, for several n at once.

    Cut-offs divide the list into bands. What is among the k best up to some cut-off is among the k
    best of its own band, so a candidate is cut within its band first and leaves the scan once at
    most; only the k rows a band that are left are ranked once per cut-off. Truth is moved once.
    Candidates without position or beyond the last cut-off are none; a cut-off at which a customer
    has no candidate does not count for it."""
    limits = sorted(set(cutoffs))
    sizes = F.array(*[F.lit(n) for n in limits])
    band = F.element_at(F.filter(sizes, lambda n: n >= F.col(position)), 1)
    listed = scored.where(F.col(position) <= limits[-1]).withColumn("band", band)
    best = top_k(listed, ["customer_id", "band"], best_first(), k)
    copied = best.withColumn("cutoff", F.explode(F.filter(sizes, lambda n: n >= F.col("band"))))
    shown = top_k(copied, ["customer_id", "cutoff"], best_first(), k, "place")
    keys = ["customer_id", "article_id"]
    nothing = F.lit(None).cast("int")
    rows = shown.select(*keys, "cutoff", "place", F.lit(0).cast("long").alias("bought")).unionByName(
        truth.select(*keys, nothing.alias("cutoff"), nothing.alias("place"), F.lit(1).cast("long").alias("bought"))
    )
    per_article = rows.groupBy(*keys).agg(
        F.sum("bought").alias("bought"),
        *[F.min(F.when(F.col("cutoff") == n, F.col("place"))).alias(f"_at{n}") for n in limits],
    )
    hit = lambda n: F.when(F.col("bought") > 0, F.col(f"_at{n}"))
    per_customer = per_article.groupBy("customer_id").agg(
        F.sum("bought").alias("n_actual"),
        *[F.struct(
            F.lit(n).alias("cutoff"), F.sort_array(F.collect_list(hit(n))).alias("places"),
            F.count(f"_at{n}").alias("n_predicted"),
        ).alias(f"_by{n}") for n in limits],
    )
    each = per_customer.select("n_actual", F.inline(F.array(*[F.col(f"_by{n}") for n in limits])))
    ap = precision_from_places(F.col("places"), F.col("n_actual"), F.lit(k))
    return each.where(F.col("n_predicted") > 0).groupBy("cutoff").agg(
        F.avg(ap).alias("map_at_k"), F.count("*").alias("n_customers")
    )


def recall_and_coverage(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of truth rows found among the candidates, and share of candidate customers with at
    least one hit."""
    per_customer = labelled.groupBy("customer_id").agg(F.sum("target").alias("hits"))
    found = per_customer.agg(
        F.sum("hits").cast("long").alias("hits"),
        F.count_if(F.col("hits") > 0).alias("covered"),
        F.count("*").alias("customers"),
    )
    rows = truth.agg(F.count("*")).scalar()
    return found.withColumn("label_rows", rows).select(
        "hits", "label_rows", "covered", "customers",
        ratio("hits", "label_rows").alias("recall"),
        ratio("covered", "customers").alias("user_coverage"),
    )

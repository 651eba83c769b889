"""Long model scores to one row per (customer, article), and statistics across models."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.scalars import null_safe_sum, row_count, row_max, row_min

KEYS = ["customer_id", "article_id"]
SCORE_KINDS = {"pred": "", "pred_rank": "_rank", "pred_norm": "_norm"}


def pivot_scores(scores: DataFrame, models: list[str]) -> DataFrame:
    """One row per key with ``pred_<m>``, ``pred_rank_<m>`` and ``pred_norm_<m>``.

    One aggregation fills all columns, so they belong together by key."""
    cells = [F.avg(kind).alias(kind) for kind in SCORE_KINDS]
    wide = scores.groupBy(*KEYS).pivot("model", models).agg(*cells)
    return wide.withColumnsRenamed(
        {f"{m}_{kind}": f"{kind}_{m}" for m in models for kind in SCORE_KINDS}
    )


def with_score_stats(wide: DataFrame, models: list[str]) -> DataFrame:
    """Sum, smallest and largest value across models for each kind of score, and the number of
    models that scored the row."""
    stats = {}
    for kind, tail in SCORE_KINDS.items():
        cols = [f"{kind}_{m}" for m in models]
        stats[f"preds_sum{tail}"] = null_safe_sum(cols)
        stats[f"preds_min{tail}"] = row_min(cols)
        stats[f"preds_max{tail}"] = row_max(cols)
        if kind == "pred":
            stats["preds_cnt"] = row_count(cols)
    return wide.withColumns(stats)

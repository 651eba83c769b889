"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the local cores. Results are written to
Spark's no-op sink, so every column of every row is computed and nothing is collected. Tables that
queries share (purchases without duplicates, cleaned dimensions, pairs, popular lists, scores) are
stored first and timed as an item of their own.
"""

import json
import os
from pathlib import Path
import time

from registry.queries import _pairs, registered
from shelfrank.session import local_session
from shelfrank.sources.bindings import Tables

HEADLINE = [
    "transactions_dedup",
    "article_window_counts",
    "article_price_age_stats",
    "customer_features",
    "customer_article_features",
    "customer_attr_features_ptype",
    "candidate_features_assembled",
    "popular_articles_by_week",
    "training_set",
    "training_features",
    "topk_customer",
    "pivot_scores",
    "stack_features_assembled",
    "map_at_k",
    "flagship_recommendations",
    "recommendations_for_everyone",
]


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = registered()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads

    def prepare() -> None:
        t = Tables(spark, folder)
        t.transactions(), t.articles(), t.customers()
        t.stored("pairs", lambda: _pairs(t))
        t.popular(), t.popular_by_week(), t.scores()

    seconds = {"prepare_tables": timed(prepare)}
    for name in HEADLINE:
        seconds[name] = timed(
            lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        )
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

"""Registered queries: each takes (session, folder) and returns a DataFrame."""

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.functions.lookback import replay, week_calendar
from shelfrank.functions.scalars import format_day, join_ids, padded_id, round_half_up
from shelfrank.operators import activity
from shelfrank.operators.dedup import duplicate_audit
from shelfrank.operators.encode import count_encode, frequency_codes, narrowing_report, ordinal_codes, value_counts
from shelfrank.operators.folds import balanced_folds, consecutive_group_ids, hash_folds
from shelfrank.operators.joins import lookup
from shelfrank.operators.ordering import exact_median, modal_day_age
from shelfrank.operators.topk import top_k
from shelfrank.plans import features as feat
from shelfrank.plans import metrics
from shelfrank.plans.assembly import all_candidates
from shelfrank.plans.candidates import (
    customers_by_articles, negatives, popular_by_week, positives, training_set,
)
from shelfrank.plans.catalogue import ATTRIBUTE_KEYS, PAIR, STATISTICS, stale_filled
from shelfrank.plans.clean import enrich
from shelfrank.plans.flows import lists_folder, predict, predict_stack, recommend_in_waves, train, train_stack
from shelfrank.plans.listwise import ListParams, gradients
from shelfrank.plans.ranker import TreeParams, mean_score, shared_top
from shelfrank.plans.recommend import (
    ground_truth, ground_truth_lists, inputs_at, popularity_with_history, published, ranked_lists,
    stack_truth, training_features,
)
from shelfrank.plans.stacking import (
    from_lists, long_stack, stack_features, wide_stack, with_article_counts, with_stack_label,
)
from shelfrank.session import tune
from shelfrank.sources.bindings import AFTER_LAST, DS, MODELS, PARAMS, Tables
from shelfrank.sources.store import unfinished
from shelfrank.sources.tables import load_transactions, read_csv, scan_csv, write_csv

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}
KEYS = ["customer_id", "article_id"]
REPEAT_WEIGHT = 50.0
SINCE = date(1998, 1, 1)
CUTOFFS = [25, 50, 100, 200]
TREES = TreeParams(depth=4, rounds=10, rate=0.2)
LISTWISE = ListParams()


def query(name: str):
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _REGISTRY[name] = lambda spark, folder: build(Tables(tune(spark), folder))
        return build

    return register


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def rounded(df: DataFrame, digits: int = 6, **per_column: int) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(
        *[
            round_half_up(c, per_column.get(c, digits)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def as_long(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# --- cleaning -----------------------------------------------------------------------------------


@query("transactions_dedup")
def transactions_dedup(t: Tables) -> DataFrame:
    return t.make_transactions()


@query("transactions_enriched")
def transactions_enriched(t: Tables) -> DataFrame:
    return enrich(t.make_transactions(), t.make_articles(), t.make_customers(), bins=True)


@query("customers_clean")
def customers_clean(t: Tables) -> DataFrame:
    return t.make_customers()


@query("postal_count_encoding")
def postal_count_encoding(t: Tables) -> DataFrame:
    rows = t.raw_customers().select("customer_id", "postal_code")
    return count_encode(rows, "postal_code", "postal_code_ce")


@query("postal_rare_grouping")
def postal_rare_grouping(t: Tables) -> DataFrame:
    counts = value_counts(t.raw_customers(), "postal_code")
    return frequency_codes(counts, "postal_code", "code", PARAMS.rare_limit)


@query("label_encode_index_code")
def label_encode_index_code(t: Tables) -> DataFrame:
    raw = t.raw_articles()
    codes = ordinal_codes(raw, "index_code", "code")
    return raw.groupBy("index_code").agg(F.count("*").alias("n_articles")).join(codes, "index_code")


@query("schema_narrowing_report")
def schema_narrowing_report(t: Tables) -> DataFrame:
    numeric = t.transactions().select("customer_id", "article_id", "price", "sales_channel_id")
    return narrowing_report(numeric)


@query("article_id_padded")
def article_id_padded(t: Tables) -> DataFrame:
    return t.raw_articles().select("article_id", padded_id("article_id").alias("article_key"))


# --- time and popularity ------------------------------------------------------------------------


@query("week_calendar")
def week_calendar_query(t: Tables) -> DataFrame:
    """Every replayed week's bounds as text, with the purchases in its label week and history."""
    trans = t.transactions()
    weeks = week_calendar(trans, PARAMS)
    daily = trans.groupBy("t_dat").agg(F.count("*").alias("_n"))
    seen = replay(daily, AFTER_LAST, PARAMS, 1 - PARAMS.label_days, PARAMS.hist_days)
    label = F.col("age_days") <= 0
    totals = seen.groupBy("week").agg(
        F.sum(F.when(label, F.col("_n")).otherwise(0)).alias("n_label"),
        F.sum(F.when(label, 0).otherwise(F.col("_n"))).alias("n_hist"),
    )
    bounds = [c for c in weeks.columns if c != "week"]
    return lookup(weeks, totals, "week").select(
        F.col("week").cast("long"), *[format_day(b).alias(b) for b in bounds], "n_label", "n_hist"
    )


@query("popular_articles_topn")
def popular_articles_topn(t: Tables) -> DataFrame:
    return as_long(t.make_popular(), "position")


@query("popular_articles_by_week")
def popular_articles_by_week(t: Tables) -> DataFrame:
    return as_long(popular_by_week(t.transactions(), AFTER_LAST, PARAMS), "week", "position")


# --- features per key-set -----------------------------------------------------------------------


def _measures(t: Tables) -> DataFrame:
    return activity.measures(t.hist(), t.lengths(), KEYS)


def _pairs(t: Tables) -> DataFrame:
    return feat.pair_activity(t.hist(), t.lengths(), [])


@query("article_window_counts")
def article_window_counts(t: Tables) -> DataFrame:
    merged = activity.roll_up(_measures(t), ["article_id"])
    return merged.select(
        "article_id", *feat.named(feat.ARTICLE_COUNTS), *feat.channel_rates("art_")
    ).transform(rounded)


@query("article_recency")
def article_recency(t: Tables) -> DataFrame:
    merged = activity.roll_up(_measures(t), ["article_id"], ["last_age", "first_age"])
    return merged.select(
        "article_id",
        F.col("last_age").cast("long").alias("art_days_after_buy"),
        F.col("first_age").cast("long").alias("art_days_from_oldest_buy"),
    )


@query("article_modal_day")
def article_modal_day(t: Tables) -> DataFrame:
    modes = modal_day_age(t.hist(), ["article_id"], "age_days", "art_days_from_mode_buy")
    return as_long(modes, "art_days_from_mode_buy")


@query("article_price_age_stats")
def article_price_age_stats(t: Tables) -> DataFrame:
    hist = t.hist()
    ages = t.customers().select("customer_id", "age")
    base = (
        activity.measures(hist, t.lengths(), KEYS).join(ages, "customer_id", "left")
        .groupBy("article_id")
        .agg(*activity.merged(["n_hist", "price_sum", "price_max", "price_min"]), *feat.age_stats_aggregates())
    )
    medians = exact_median(hist, ["article_id"], "price", "art_price_hist_median")
    stats = base.join(medians, "article_id", "left").select(
        "article_id", *feat.price_stats("art_price_hist"), *[f"art_age_hist_{s}" for s in STATISTICS]
    )
    return rounded(stats)


@query("article_rebuy_rate")
def article_rebuy_rate(t: Tables) -> DataFrame:
    rates = activity.repeat_rate(_measures(t), ["article_id"], "customer_id", "rebuy_rate", PARAMS.smoothing)
    return rounded(rates)


@query("code_rebuy_rate")
def code_rebuy_rate(t: Tables) -> DataFrame:
    coded = lookup(_measures(t), t.raw_articles().select("article_id", "product_code"), "article_id")
    return rounded(
        activity.repeat_rate(coded, ["product_code"], "customer_id", "code_rebuy_rate", PARAMS.smoothing)
    )


@query("customer_rebuy_rate")
def customer_rebuy_rate(t: Tables) -> DataFrame:
    return rounded(
        activity.repeat_rate(_measures(t), ["customer_id"], "article_id", "cust_rebuy_rate", PARAMS.smoothing)
    )


@query("article_decayed_count")
def article_decayed_count(t: Tables) -> DataFrame:
    return rounded(feat.decayed_article_features(t.hist(), t.lengths()))


@query("code_features")
def code_features(t: Tables) -> DataFrame:
    return rounded(feat.code_features(_pairs(t), t.raw_articles(), PARAMS, []))


@query("age_group_features")
def age_group_features(t: Tables) -> DataFrame:
    found = feat.age_group_features(_pairs(t), t.hist(), t.customers(), [])
    return rounded(found)


@query("age_group_article_features")
def age_group_article_features(t: Tables) -> DataFrame:
    return feat.age_group_article_features(_pairs(t), t.customers(), [])


@query("customer_features")
def customer_features(t: Tables) -> DataFrame:
    """For the customers of the label week only."""
    hist = t.hist().join(t.label_customers(), "customer_id", "left_semi")
    found = feat.customer_features(feat.pair_activity(hist, t.lengths(), []), hist, PARAMS, [])
    found = as_long(found, "days_after_buy_all", "days_from_oldest_buy_all")
    return rounded(found)


@query("customer_article_features")
def customer_article_features(t: Tables) -> DataFrame:
    found = feat.attribute_features(_measures(t), t.raw_articles(), PAIR, [])
    return as_long(found, "days_after_buy")


def _attribute_query(key) -> Callable[[Tables], DataFrame]:
    def build(t: Tables) -> DataFrame:
        articles = t.articles() if "index_code" in key.columns else t.raw_articles()
        found = feat.attribute_features(_measures(t), articles, key, [])
        found = found.withColumns({c: F.col(c).cast("string") for c in key.columns})
        return as_long(found, key.recency)

    return build


for _key in ATTRIBUTE_KEYS:
    _kind = "attr_pair" if len(_key.columns) > 1 else "attr"
    query(f"customer_{_kind}_features_{_key.suffix}")(_attribute_query(_key))


# --- candidates and labels ----------------------------------------------------------------------


@query("candidate_cross_join")
def candidate_cross_join(t: Tables) -> DataFrame:
    rows = customers_by_articles(t.label_customers(), t.popular(), PARAMS)
    return as_long(rows.select(*KEYS, "position"), "position")


def _as_shown(name: str, kind: str, value: Column) -> Column:
    """A feature as the queries give it: recencies as long numbers, doubles rounded."""
    value, kind = (value.cast("long"), "bigint") if name in stale_filled() else (value, kind)
    return round_half_up(value, 6) if kind == "double" else value


def _candidate_features(t: Tables) -> DataFrame:
    x = inputs_at(
        t.transactions(), t.articles(), t.customers(), t.label_customers(), t.popular(), DS, PARAMS,
        pairs=t.stored("pairs", lambda: _pairs(t)),
    )
    return all_candidates(x, _as_shown)


@query("candidate_features_assembled")
def candidate_features_assembled(t: Tables) -> DataFrame:
    return _candidate_features(t)


@query("positives_decayed")
def positives_decayed(t: Tables) -> DataFrame:
    found = positives(t.transactions(), t.popular_by_week(), AFTER_LAST, PARAMS)
    return rounded(as_long(found, "week"))


@query("negatives_sampled")
def negatives_sampled(t: Tables) -> DataFrame:
    popular = t.popular_by_week()
    drawn = negatives(positives(t.transactions(), popular, AFTER_LAST, PARAMS), popular, PARAMS)
    return as_long(drawn, "week")


def _training(t: Tables) -> DataFrame:
    return training_set(t.transactions(), t.popular_by_week(), AFTER_LAST, PARAMS)


@query("training_set")
def training_set_query(t: Tables) -> DataFrame:
    return rounded(as_long(_training(t), "week"))


@query("group_ids")
def group_ids(t: Tables) -> DataFrame:
    train = _training(t).where(F.col("part") == "train")
    return as_long(consecutive_group_ids(train, ["customer_id", "week"], "group_id"), "week", "group_id")


@query("grouped_folds")
def grouped_folds(t: Tables) -> DataFrame:
    rows = t.scores().select("customer_id", "article_id").distinct()
    return as_long(balanced_folds(rows, "customer_id", PARAMS.n_folds), "fold")


@query("grouped_folds_hash")
def grouped_folds_hash(t: Tables) -> DataFrame:
    customers = t.scores().select("customer_id").distinct()
    return hash_folds(customers, "customer_id", PARAMS.n_folds, PARAMS.seed)


# --- stacking -----------------------------------------------------------------------------------


@query("score_tables_normalised")
def score_tables_normalised(t: Tables) -> DataFrame:
    return rounded(t.make_scores())


@query("list_format_scores")
def list_format_scores(t: Tables) -> DataFrame:
    lists = published(t.scores().where(F.col("model") == "pop_recent"), PARAMS.top_k)
    return from_lists(lists, "prediction", "listed")


@query("model_registry")
def model_registry(t: Tables) -> DataFrame:
    used = t.scores().groupBy("model").agg(
        F.count("*").alias("n_scores"), F.count_distinct("customer_id").alias("n_customers")
    )
    gap = F.round(F.col("cv") - F.col("lb"), 6).alias("cv_lb_gap")
    return lookup(used, F.broadcast(t.registry()), "model").select("*", gap)


@query("duplicate_audit")
def duplicate_audit_query(t: Tables) -> DataFrame:
    """Over the score tables, and over the purchases before and after duplicate removal."""
    purchases = t.purchases().select("customer_id", padded_id("article_id").alias("article_id"), F.lit("purchases").alias("model"))
    scores = t.scores().select("customer_id", "article_id", "model")
    return duplicate_audit(scores.unionByName(purchases), KEYS, "model")


def _stack(t: Tables) -> DataFrame:
    return long_stack(t.scores(), PARAMS)


@query("top24_rank_zscore")
def top24_rank_zscore(t: Tables) -> DataFrame:
    return rounded(as_long(_stack(t), "pred_rank"))


def _wide(t: Tables) -> DataFrame:
    return wide_stack(_stack(t), MODELS)


@query("pivot_scores")
def pivot_scores_query(t: Tables) -> DataFrame:
    wide = _wide(t)
    return rounded(wide.select(*[c for c in wide.columns if not c.startswith("preds_")]))


@query("row_wise_score_stats")
def row_wise_score_stats(t: Tables) -> DataFrame:
    wide = _wide(t)
    stats = wide.select(*KEYS, *[c for c in wide.columns if c.startswith("preds_")])
    return rounded(as_long(stats, "preds_cnt"))


def _padded(df: DataFrame) -> DataFrame:
    return df.withColumn("article_id", padded_id("article_id"))


def _stack_features(t: Tables) -> DataFrame:
    counts = _padded(feat.decayed_article_features(t.hist(), t.lengths()))
    return stack_features(_wide(t), counts, _padded(t.articles()), t.customers(), PARAMS)


@query("stack_features_assembled")
def stack_features_assembled(t: Tables) -> DataFrame:
    return rounded(as_long(_stack_features(t), "preds_cnt"))


def _bought(t: Tables) -> DataFrame:
    """Purchases after the day before the label week."""
    return _padded(stack_truth(t.transactions(), DS))


@query("stack_truth_open_ended")
def stack_truth_open_ended(t: Tables) -> DataFrame:
    """Label rows counted from a day three weeks before the newest week: there is no last day to them, so
    they reach over all weeks that follow."""
    rows = stack_truth(t.transactions(), DS - timedelta(days=21))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n_days"), F.max("t_dat").alias("newest"))


@query("stack_labelled")
def stack_labelled(t: Tables) -> DataFrame:
    return as_long(with_stack_label(_wide(t).select(*KEYS), _bought(t)), "target")


@query("recall_coverage")
def recall_coverage(t: Tables) -> DataFrame:
    labelled = with_stack_label(_wide(t).select(*KEYS), _bought(t))
    return rounded(metrics.recall_and_coverage(labelled, _bought(t)))


# --- ranking ------------------------------------------------------------------------------------


def _hash_scores(t: Tables) -> DataFrame:
    return t.scores().where(F.col("model") == "hash")


@query("topk_customer")
def topk_customer(t: Tables) -> DataFrame:
    ranked = top_k(_hash_scores(t), ["customer_id"], metrics.best_first(), PARAMS.keep, "place")
    return rounded(as_long(ranked.drop("model"), "place"))


@query("topk_customer_tiebreak")
def topk_customer_tiebreak(t: Tables) -> DataFrame:
    """Coarse scores with many ties, settled by recent purchases."""
    counts = _padded(feat.decayed_article_features(t.hist(), t.lengths())).select("article_id", "art_buy_recent")
    coarse = _hash_scores(t).select(*KEYS, F.floor(F.col("pred") * 10).cast("long").alias("pred"))
    scored = lookup(coarse, counts, "article_id").fillna(0, subset=["art_buy_recent"])
    order = metrics.best_first(F.desc("art_buy_recent"))
    return as_long(top_k(scored, ["customer_id"], order, PARAMS.top_k, "place"), "place")


@query("mean_score_dedup")
def mean_score_dedup(t: Tables) -> DataFrame:
    """Scores of all models for the same customer and article averaged."""
    return rounded(mean_score(t.scores()))


@query("recommendation_strings")
def recommendation_strings(t: Tables) -> DataFrame:
    return published(_hash_scores(t), PARAMS.top_k)


@query("ground_truth_lists")
def ground_truth_lists_query(t: Tables) -> DataFrame:
    lists = ground_truth_lists(t.transactions(), DS, PARAMS)
    return lists.select(
        "customer_id", join_ids("articles").alias("articles"), F.size("articles").cast("long").alias("n_articles")
    )


def _shown(t: Tables, k: int) -> DataFrame:
    return top_k(_hash_scores(t), ["customer_id"], metrics.best_first(), k, "place")


@query("ap_at_k")
def ap_at_k(t: Tables) -> DataFrame:
    return rounded(metrics.average_precision(_shown(t, 12), _bought(t), 12).drop("k"))


@query("map_at_k")
def map_at_k(t: Tables) -> DataFrame:
    """MAP@10 and MAP@12 of every model's list."""
    names = F.explode(F.array(*[F.lit(m) for m in MODELS]))
    truth = _bought(t).withColumn("model", names)
    found = metrics.mean_average_precision(t.scores(), truth, [10, 12], by=["model"])
    return rounded(as_long(found, "k"))


@query("map_by_candidate_cutoff")
def map_by_candidate_cutoff(t: Tables) -> DataFrame:
    """Candidates scored by recent purchases plus the hash score, for growing lists."""
    listed = t.popular().where(F.col("position") <= max(CUTOFFS))  # no cut-off has more candidates
    rows = customers_by_articles(t.label_customers(), listed, PARAMS)
    mixed = (F.col("customer_id") * 7919 + F.col("article_id") * 104729) % 1009
    scored = rows.select(*KEYS, "position", (F.col("cnt") + mixed / 1009.0).alias("pred"))
    found = metrics.map_by_cutoff(scored, ground_truth(t.transactions(), DS, PARAMS), CUTOFFS, 12)
    return rounded(as_long(found, "cutoff"))


@query("ensemble_mean")
def ensemble_mean(t: Tables) -> DataFrame:
    """Models' z-scores averaged over all models; a model that did not score a row adds 0."""
    total = _stack(t).groupBy(*KEYS).agg(F.sum(F.coalesce("pred_norm", F.lit(0.0))).alias("_sum"))
    return rounded(total.select(*KEYS, (F.col("_sum") / len(MODELS)).alias("pred")))


@query("flagship_recommendations")
def flagship(t: Tables) -> DataFrame:
    ranked = popularity_with_history(
        t.transactions(), t.label_customers(), t.popular(), DS, PARAMS, REPEAT_WEIGHT, PARAMS.top_k
    )
    return ranked_lists(ranked)


@query("recommendations_for_everyone")
def recommendations_for_everyone(t: Tables) -> DataFrame:
    """Twelve articles for every customer, also those without purchases, in waves of customer buckets."""
    path, listed = t.store.path("everyone", DS.isoformat()), t.popular()

    def recommend(part: DataFrame) -> DataFrame:
        return popularity_with_history(t.transactions(), part, listed, DS, PARAMS, REPEAT_WEIGHT, PARAMS.top_k).drop("place")

    recommend_in_waves(t.raw_customers().select("customer_id"), recommend, path, PARAMS, 16, 2)
    lists = t.spark.read.parquet(lists_folder(path, 16))
    return lists.select("customer_id", "prediction")


@query("transactions_from_csv")
def transactions_from_csv(t: Tables) -> DataFrame:
    """Purchases written as CSV to the shared folder, read back, and loaded from SINCE on."""
    path = t.store.path("purchases_csv", "all")
    if not t.store.has("purchases_csv", "all"):
        rows = t.purchases().select(F.date_format("t_dat", "yyyy-MM-dd").alias("t_dat"), "customer_id", "article_id", "price", "sales_channel_id")
        write_csv(rows, path)
    loaded = load_transactions(read_csv(t.spark, path, "transactions"), SINCE, ["price"])
    return as_long(loaded.withColumn("customer_id", F.col("customer_id").cast("long")), "sales_channel_id")


def _damaged(t: Tables) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Purchases as CSV in which some prices are no numbers, scanned with inferred types."""
    path = t.store.path("damaged_csv", "all")
    if not t.store.has("damaged_csv", "all"):
        price = F.when(F.col("article_id") % 97 == 5, "n/a").otherwise(F.col("price").cast("string"))
        write_csv(t.purchases().select("t_dat", "customer_id", "article_id", price.alias("price"), "sales_channel_id",
                                       F.year("t_dat").alias("bought_in")), path)
    return scan_csv(t.spark, path, "transactions")


@query("csv_inferred_types")
def csv_inferred_types(t: Tables) -> DataFrame:
    """For each column of a damaged text table the inferred and the loaded type, the sound rows and
    the values that were set aside."""
    sound, aside, inferred = _damaged(t)
    columns = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("inferred"), F.lit(dict(sound.dtypes)[c]).alias("loaded"))
        for c, i in inferred.items()
    ])).alias("c")
    n_sound = sound.agg(F.count("*").alias("n_sound"))
    faults = aside.select(F.explode("faults").alias("column_name")).groupBy("column_name").agg(F.count("*").alias("n_aside"))
    return n_sound.select(columns, "n_sound").select("c.*", "n_sound").join(F.broadcast(faults), "column_name", "left").select(
        "column_name", "inferred", "loaded", "n_sound", F.coalesce("n_aside", F.lit(0)).cast("long").alias("n_aside")
    )


@query("transactions_from_damaged_csv")
def transactions_from_damaged_csv(t: Tables) -> DataFrame:
    """The sound purchases of a damaged text table, loaded from SINCE on."""
    loaded = load_transactions(_damaged(t)[0], SINCE, ["price"])
    return as_long(loaded.withColumn("customer_id", F.col("customer_id").cast("long")), "sales_channel_id")


@query("transactions_since")
def transactions_since(t: Tables) -> DataFrame:
    """Stored purchases from SINCE on; the filter reaches the scan."""
    return t.transactions().where(F.col("t_dat") >= F.lit(SINCE))


@query("unfinished_customers")
def unfinished_customers(t: Tables) -> DataFrame:
    """All customers without a published list yet."""
    return unfinished(t.raw_customers().select("customer_id"), published(_hash_scores(t), PARAMS.top_k))


@query("intermediate_round_trip")
def intermediate_round_trip(t: Tables) -> DataFrame:
    """The enriched history written once to the shared folder and read back."""
    return t.stored(
        "history_enriched",
        lambda: enrich(t.hist(), t.articles(), t.customers()).drop("age_days"),
        ["t_dat"],
    )


# --- learned ranker -----------------------------------------------------------------------------


@query("training_features")
def training_features_query(t: Tables) -> DataFrame:
    """The labelled rows of all weeks with the features known at the start of their week."""
    trans, popular = t.transactions(), t.popular_by_week()
    labelled = t.stored("training_set", lambda: training_set(trans, popular, AFTER_LAST, PARAMS))
    rows = training_features(trans, t.articles(), t.customers(), labelled, popular, AFTER_LAST, PARAMS)
    return rounded(as_long(rows, *stale_filled(), "week"))


@query("ranker_gradients")
def ranker_gradients(t: Tables) -> DataFrame:
    """Gradients of all training rows, grouped by customer and week: of the first round, where all scores
    are equal, and at scores that differ."""
    labelled = t.stored("training_set", lambda: training_set(t.transactions(), t.popular_by_week(), AFTER_LAST, PARAMS))
    mixed = ((F.col("customer_id") * 31 + F.col("article_id") * 17) % 101) / 101.0
    kinds = F.array(F.struct(F.lit("equal").alias("scores"), F.lit(0.0).alias("score")), F.struct(F.lit("mixed").alias("scores"), mixed.alias("score")))
    rows = labelled.select("week", *KEYS, "target", F.inline(kinds))
    group = ["scores", "week", "customer_id"]
    # Equal scores give halves that rounding would settle by the last bit: they are moved off the border.
    moved = {c: F.col(c) + 1e-8 for c in ("gradient", "curvature")}
    return rounded(as_long(gradients(rows, group).withColumns(moved), "week"))


@query("ranker_fit_score")
def ranker_fit_score(t: Tables) -> DataFrame:
    trans, articles, customers = t.transactions(), t.articles(), t.customers()
    model = train(t.store, trans, articles, customers, AFTER_LAST, PARAMS, LISTWISE)
    scored = predict(model, trans, articles, customers, t.label_customers(), DS, PARAMS)
    return top_k(scored, ["customer_id"], metrics.best_first(), PARAMS.keep, "place")


@query("ranker_oof")
def ranker_oof(t: Tables) -> DataFrame:
    return train_stack(
        t.store, t.scores(), MODELS, t.transactions(), t.articles(), t.customers(), DS, PARAMS, TREES
    )[0]


def _oof(t: Tables) -> DataFrame:
    """The stored out-of-fold scores; ``train_stack`` makes and stores them if there are none yet."""
    return ranker_oof(t)


@query("ranker_oof_folds")
def ranker_oof_folds(t: Tables) -> DataFrame:
    """Which fold scored each row; every row is scored."""
    scored = F.col("pred").isNotNull().alias("scored")
    return as_long(_oof(t).select(*KEYS, "fold", scored), "fold")


@query("ranker_top30")
def ranker_top30(t: Tables) -> DataFrame:
    return shared_top(_oof(t), PARAMS.share_top)


@query("stack_recommendations")
def stack_recommendations(t: Tables) -> DataFrame:
    """Second-stage lists of all scored customers by the mean of the fold models, written as a CSV of two
    columns and read back: how long each is, how many rows are shared with a next stage, and whether the
    list is the beginning of those in their order."""
    day, path = DS.isoformat(), t.store.path("stack_lists", DS.isoformat())
    trans, articles, customers = t.transactions(), t.articles(), t.customers()
    if not t.store.has("stack_lists", day):
        model = train_stack(t.store, t.scores(), MODELS, trans, articles, customers, DS, PARAMS, TREES)[1]
        lists, shared = predict_stack(model, t.scores(), MODELS, trans, articles, customers, DS, PARAMS)
        t.store.write("stack_shared", day, shared)
        write_csv(lists, path)
    order = metrics.best_first(F.desc("art_buy_recent"))
    placed = top_k(t.store.read("stack_shared", day), ["customer_id"], order, PARAMS.share_top, "place")
    first = ranked_lists(placed.where(F.col("place") <= PARAMS.top_k)).withColumnRenamed("prediction", "first")
    n_shared = placed.groupBy("customer_id").agg(F.max("place").cast("long").alias("n_shared"))
    listed = read_csv(t.spark, path, "submission").withColumn("customer_id", F.col("customer_id").cast("long"))
    return listed.join(first, "customer_id", "left").join(n_shared, "customer_id", "left").select(
        "customer_id", F.size(F.split("prediction", " ")).cast("long").alias("n_listed"), "n_shared",
        F.col("prediction").eqNullSafe(F.col("first")).alias("in_order"),
    )


@query("ranker_oof_map")
def ranker_oof_map(t: Tables) -> DataFrame:
    """MAP@10 and MAP@12 of the out-of-fold lists, over all customers and as the mean of folds."""
    scored, truth = _oof(t), _bought(t)
    shown = top_k(scored, ["customer_id"], metrics.best_first(), 12, "place")
    folds = scored.select("customer_id", "fold").distinct()
    ap = lookup(metrics.average_precision(shown, truth, [10, 12]), folds, "customer_id")
    per_fold = ap.groupBy("k", "fold").agg(
        F.avg("ap").alias("_map"), F.sum("ap").alias("_sum"), F.count("*").alias("_n")
    )
    return per_fold.groupBy("k").agg(
        (F.sum("_sum") / F.sum("_n")).alias("map_at_k"), F.avg("_map").alias("mean_of_folds")
    )

"""Plans as a whole: metrics, recommendation, stores, ranker, and what plans must not contain."""

from datetime import date
import random

from pyspark.sql import functions as F
import pytest

from conftest import as_set, plan_of
from registry.queries import registered as queries, rounded
from shelfrank.plans import flows, metrics
from shelfrank.plans.assembly import all_candidates, given_candidates
from shelfrank.plans.catalogue import candidate_policy, stack_policy
from shelfrank.plans.candidates import negatives, popular_by_week, positives
from shelfrank.plans.ranker import (
    TreeParams, feature_names, fit, load_models, out_of_fold, ready, save_models, score,
)
from shelfrank.functions.lookback import replay
from shelfrank.plans.recommend import additive_top_k, ground_truth, inputs_at, stack_truth, weekly_pairs
from shelfrank.plans.stacking import ScoreFormat, normalise, with_stack_label
from shelfrank.sources.bindings import AFTER_LAST, DS, MODELS, PARAMS
from shelfrank.operators.ordering import settle
from shelfrank.sources.store import TableStore, identity, unfinished, write_restartable
from shelfrank.sources.tables import SCHEMAS, load_transactions, read_csv, scan_csv, write_csv
from test_operators import plain_ap


def test_average_precision_by_rows_equals_lists(spark):
    rng = random.Random(2)
    shown, bought = [], []
    for c in range(40):
        shown += [(c, a, i) for i, a in enumerate([rng.randrange(12) for _ in range(10)], 1)]
        bought += [(c, rng.randrange(12)) for _ in range(rng.randrange(0, 20))]
    p = spark.createDataFrame(shown, "customer_id int, article_id int, place int")
    t = spark.createDataFrame(bought, "customer_id int, article_id int")
    for k in (3, 10, 12):
        got = {r["customer_id"]: r["ap"] for r in metrics.average_precision(p, t, k).collect()}
        assert len(got) == 40
        for c in range(40):
            lists = [a for x, a in bought if x == c], [a for x, a, _ in shown if x == c]
            assert got[c] == pytest.approx(plain_ap(*lists, k)) and 0 <= got[c] <= 1


def test_additive_top_k_equals_scoring_everything(spark):
    rng = random.Random(9)
    base = [(a, float(rng.randrange(6))) for a in range(80)]
    pairs = [(c, a, float(rng.randrange(1, 5))) for c in range(25) for a in rng.sample(range(100), 9)]
    articles = spark.createDataFrame(base, "article_id bigint, base double")
    bonus = spark.createDataFrame(pairs, "customer_id bigint, article_id bigint, bonus double")
    customers = spark.range(25).withColumnRenamed("id", "customer_id")
    got = as_set(additive_top_k(customers, articles, bonus, 5, 100), "customer_id", "article_id", "pred", "place")
    extra = {(c, a): b for c, a, b in pairs}
    want = set()
    for c in range(25):
        scored = sorted((-(b + extra.get((c, a), 0.0)), a) for a, b in base)[:5]
        want |= {(c, a, -s, i) for i, (s, a) in enumerate(scored, 1)}
    assert got == want


def test_negatives_are_distinct_per_customer_and_week(tables):
    trans = tables.transactions()
    popular = popular_by_week(trans, AFTER_LAST, PARAMS)
    drawn = negatives(positives(trans, popular, AFTER_LAST, PARAMS), popular, PARAMS)
    per = drawn.groupBy("week", "customer_id").agg(
        F.count("*").alias("n"), F.count_distinct("article_id").alias("d")
    )
    sizes = popular.groupBy("week").agg(F.least(F.max("position"), F.lit(PARAMS.n_negatives)).alias("size"))
    assert per.join(sizes, "week").where((F.col("n") != F.col("d")) | (F.col("n") != F.col("size"))).isEmpty()


def test_hot_customer_and_article_give_whole_results(spark):
    """A third of the purchases by one customer, a third of one article."""
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        c = 0 if i % 3 == 0 else rng.randrange(1, 300)
        a = 0 if i % 3 == 1 else rng.randrange(1, 500)
        rows.append((c, a, rng.randrange(1, 366), 1 + i % 2, float(i % 97)))
    from shelfrank.operators.activity import roll_up
    from shelfrank.plans.features import customer_features, pair_activity

    lengths = {"yesterday": 1, "recent": 7, "short": 30, "mid": 90, "hist": 366}
    hist = spark.createDataFrame(rows, "customer_id bigint, article_id bigint, age_days int, sales_channel_id int, price double")
    pairs = pair_activity(hist, lengths, [])
    assert pairs.agg(F.sum("n_hist")).first()[0] == 3000
    by_article = {r["article_id"]: r["n_hist"] for r in roll_up(pairs, ["article_id"]).collect()}
    assert by_article[0] == sum(1 for r in rows if r[1] == 0)
    mine = customer_features(pairs, hist, PARAMS, []).where("customer_id = 0").first()
    assert mine["n_buy_hist_all"] == sum(1 for r in rows if r[0] == 0)
    assert mine["days_after_buy_all"] == min(r[2] for r in rows if r[0] == 0)


def test_fill_policies():
    base = candidate_policy(PARAMS).by_name
    assert base["n_buy_hist"] == 0 and base["days_after_buy_idxg_gram"] == 376
    assert base["art_rate_sales_channel_recent"] == 1.5 and "user_price_hist_mean" not in base
    stack = stack_policy(PARAMS)
    assert stack.values_for(["pred_rank_x", "preds_min_rank", "pred_x", "art_buy_hist_decay"]) == {
        "pred_rank_x": 100000, "preds_min_rank": 100000, "art_buy_hist_decay": 0,
    }


def test_normalising_drops_the_sentinel_and_keeps_missing(spark):
    raw = spark.createDataFrame([(1, 7, -1.0, 1), (1, 8, None, 2), (2, 9, 0.5, 1)], "customer_id int, article_id bigint, oof double, oof_rank int")
    got = normalise(raw, ScoreFormat("m", score="oof", drop=("oof_rank",), not_scored=-1.0))
    assert as_set(got, "article_id", "pred", "model") == {("0000000008", None, "m"), ("0000000009", 0.5, "m")}


def test_label_join_does_not_double_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b")], "customer_id int, article_id string")
    bought = spark.createDataFrame([(1, "a"), (1, "a")], rows.schema)
    assert as_set(with_stack_label(rows, bought), "article_id", "target") == {("a", 1), ("b", 0)}


# --- sources and sinks


def test_csv_round_trip_and_load(spark, tmp_path):
    rows = [("2001-01-02", "c1", 1, 2.0, 1), ("2001-01-02", "c1", 1, 1.0, 2), ("1999-01-01", "c1", 1, 1.0, 2)]
    path = str(tmp_path / "t")
    write_csv(spark.createDataFrame(rows, SCHEMAS["transactions"]), path)
    from datetime import date

    got = load_transactions(read_csv(spark, path, "transactions"), date(2000, 1, 1), ["price"])
    assert [tuple(r) for r in got.select("customer_id", "article_id", "price", "sales_channel_id").collect()] == [("c1", 1, 1.0, 2)]
    assert got.schema["t_dat"].dataType.simpleString() == "date"


def test_scan_infers_types_and_sets_bad_records_aside(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        "t_dat,customer_id,article_id,price,sales_channel_id,note\n"
        "2001-01-02,007,1,1.5,1,3\n2001-01-03,8,2,cheap,1,4\n2001-01-04,9,x,dear,2,5\n2001-01-05,10\n"
        "2001-01-06,11,3,,2,\n"
    )
    sound, aside, inferred = scan_csv(spark, str(path), "transactions")
    assert [tuple(r) for r in sound.orderBy("t_dat").collect()] == [
        ("2001-01-02", "007", 1, 1.5, 1, 3), ("2001-01-06", "11", 3, None, 2, None),
    ]
    assert dict(sound.dtypes)["note"] == "int" and dict(sound.dtypes)["article_id"] == "bigint"
    assert inferred["price"] == inferred["article_id"] == "string" and inferred["customer_id"] == "int"
    assert {r["record"]: r["faults"] for r in aside.collect()} == {
        "2001-01-03,8,2,cheap,1,4": ["price"], "2001-01-04,9,x,dear,2,5": ["article_id", "price"], "2001-01-05,10": ["record"],
    }
    with pytest.raises(ValueError, match="lacks"):
        scan_csv(spark, str(path), "articles")
    path.write_text("t_dat,customer_id,article_id,price,sales_channel_id\n")
    sound, aside, _ = scan_csv(spark, str(path), "transactions")
    assert sound.count() == aside.count() == 0


def test_map_by_cutoff_equals_lists_per_cutoff(spark):
    rng = random.Random(4)
    cutoffs, k = [9, 2, 5], 3
    scored = [(c, a, p, float(rng.randrange(4))) for c in range(12) for p, a in enumerate(rng.sample(range(30), 8), c % 4 + 1)]
    scored += [(3, scored[25][1], 2, 9.0), (4, 1, None, 9.0), (5, 1, 40, 9.0)]
    bought = [(c, rng.randrange(30)) for c in range(14) for _ in range(rng.randrange(20))]
    s = spark.createDataFrame(scored, "customer_id int, article_id int, position int, pred double")
    t = spark.createDataFrame(bought, "customer_id int, article_id int")
    got = {r["cutoff"]: (r["map_at_k"], r["n_customers"]) for r in metrics.map_by_cutoff(s, t, cutoffs, k).collect()}
    for n in cutoffs:
        aps = []
        for c in range(12):
            rows = sorted((-x, a) for d, a, p, x in scored if d == c and p is not None and p <= n)
            if rows:
                aps.append(plain_ap([a for d, a in bought if d == c], [a for _, a in rows[:k]], k))
        assert got[n] == (pytest.approx(sum(aps) / len(aps)), len(aps))
    plan = metrics.map_by_cutoff(s, t, cutoffs, k)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before and after the copies to cut-offs
    assert metrics.map_by_cutoff(s.limit(0), t, cutoffs, k).count() == 0


def test_store_computes_once(spark, tmp_path):
    store, calls = TableStore(spark, (tmp_path / "s").as_uri()), []

    def make():
        calls.append(1)
        return spark.range(5)

    assert store.reuse("t", "d", make).count() == store.reuse("t", "d", make).count() == 5
    assert len(calls) == 1


def test_store_tells_parameters_and_inputs_apart(spark, tmp_path):
    store = TableStore(spark, (tmp_path / "s").as_uri())
    a = store.write("a", "d", spark.range(3))
    b = store.write("b", "d", spark.range(3))
    roots = {store.about(*x).root for x in ((PARAMS, a), (PARAMS, b), (PARAMS.scaled(keep=1), a), (PARAMS, a.where("id > 1")))}
    assert len(roots) == 4
    assert store.about(PARAMS, a).root == store.about(PARAMS, spark.read.parquet(store.path("a", "d"))).root


def test_store_refuses_to_write_a_table_from_itself(spark, tmp_path):
    store = TableStore(spark, (tmp_path / "s").as_uri())
    rows = store.write("t", "d", spark.range(5))
    with pytest.raises(ValueError):
        store.write("t", "d", rows.where("id > 2"))
    with pytest.raises(ValueError):
        store.reuse("u", "d", lambda: store.write("u", "d", spark.range(2)))
    assert store.read("t", "d").count() == 5


@pytest.mark.parametrize("name", ["ranker_top30", "ranker_oof_map", "ranker_oof", "ranker_fit_score"])
def test_learned_queries_run_alone_and_again(name, spark, folder, tmp_path):
    """Each in a store of its own: the tables of another folder's name are not there yet."""
    alone = tmp_path / name
    alone.symlink_to(folder)
    first = queries()[name](spark, str(alone))
    again = queries()[name](spark, str(alone))
    assert first.count() == again.count() > 0


def test_stored_transactions_skip_files_by_day(tables):

    plan = plan_of(tables.hist())
    assert "GreaterThanOrEqual(t_dat" in plan and "LessThanOrEqual(t_dat" in plan


def test_restart_replaces_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "out")
    everyone = spark.range(40).select(F.col("id").alias("customer_id"), F.lit("old").alias("prediction"))
    write_restartable(everyone.where("customer_id < 30"), path, 8)
    done = spark.read.parquet(path)
    left = unfinished(everyone.select("customer_id"), done)
    assert left.count() == 10
    bucket = done.select("bucket").distinct().first()[0]
    again = done.where(F.col("bucket") == bucket).select("customer_id", F.lit("new").alias("prediction"))
    rows = [tuple(r) for r in again.collect()]
    write_restartable(spark.createDataFrame(rows, "customer_id bigint, prediction string"), path, 8)
    got = spark.read.parquet(path)
    assert got.count() == 30 and got.where("prediction = 'new'").count() == len(rows)


def test_store_tells_inputs_apart(spark, tmp_path):
    """Tables in memory by their rows, plans by every column, files by size and time."""
    one, two = (spark.createDataFrame([(i,)], "x int") for i in (1, 2))
    assert identity(one) != identity(two) and identity(one) == identity(spark.createDataFrame([(1,)], "x int"))
    assert identity(settle(one)) != identity(settle(two))
    path = (tmp_path / "t").as_uri()
    spark.range(5).write.parquet(path)
    read = lambda: spark.read.parquet(path)
    wide = lambda last: read().select("id", *[(F.col("id") + i).alias(f"c{i}") for i in range(40)], (F.col("id") + last).alias("c40"))
    assert identity(wide(1)) != identity(wide(2)) and identity(wide(1)) == identity(wide(1))
    assert identity(read().union(one.select(F.col("x").cast("long")))) != identity(read().union(two.select(F.col("x").cast("long"))))
    before = identity(read())
    assert before == identity(read())
    spark.range(5, 10).write.mode("overwrite").parquet(path)
    assert identity(read()) != before


def test_other_rows_do_not_meet_an_old_table(spark, tmp_path):
    store = TableStore(spark, (tmp_path / "s").as_uri())
    tables = [spark.createDataFrame([(i,)], "x int") for i in (1, 2)]
    got = [store.about(t).reuse("t", "2001-01-01", lambda t=t: t).first()["x"] for t in tables]
    assert got == [1, 2]


def test_weekly_pairs_move_the_history_once(tables):
    """Purchases are dealt before they are copied to weeks; the copies meet no exchange."""
    plan = plan_of(weekly_pairs(tables.transactions(), AFTER_LAST, PARAMS))
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_second_stage_labels_have_no_last_day(spark):
    rows = spark.sql("SELECT 1L AS customer_id, 2L AS article_id, explode(sequence(DATE'2001-01-01', DATE'2001-03-01', INTERVAL 1 DAY)) AS t_dat")
    days = [r["t_dat"] for r in stack_truth(rows, date(2001, 1, 8)).orderBy("t_dat").collect()]
    assert days[0] == date(2001, 1, 8) and days[-1] == date(2001, 3, 1) and len(days) == 53
    assert ground_truth(rows, date(2001, 1, 8), PARAMS).count() == 7


def test_replay_of_wanted_weeks_only(tables, spark):
    trans = tables.transactions().limit(500)
    wanted = trans.select("customer_id").distinct().where("customer_id % 2 = 0").withColumn("_weeks", F.array(F.lit(0), F.lit(3)))
    got = replay(trans.join(wanted, "customer_id"), AFTER_LAST, PARAMS, 1, 366, ["customer_id"], "_weeks")
    every = replay(trans, AFTER_LAST, PARAMS, 1, 366).where("customer_id % 2 = 0 and week in (0, 3)")
    columns = ["week", "customer_id", "article_id", "t_dat", "age_days"]
    assert got.columns == every.columns and as_set(got, *columns) == as_set(every, *columns)


# --- ranker


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows = []
    for c in range(60):
        for a in range(10):
            x = rng.random()
            rows.append((c, f"{a}", x, None if a % 3 else 1.0, float(x > 0.7)))
    return spark.createDataFrame(rows, "customer_id bigint, article_id string, x double, y double, target double")


def test_ranker_learns_and_averages(labelled):
    trees = TreeParams(depth=2, rounds=3)
    names = feature_names(labelled)
    assert names == ["x", "y"]
    model = fit(ready(labelled, names), trees)
    one = score([model], labelled, names, ["customer_id", "article_id", "target"])
    two = score([model, model], labelled, names, ["customer_id", "article_id"])
    means = {r["target"]: r["m"] for r in one.groupBy("target").agg(F.avg("pred").alias("m")).collect()}
    assert means[1.0] > means[0.0] + 0.5
    both = one.join(two.withColumnRenamed("pred", "p2"), ["customer_id", "article_id"])
    assert both.where(F.abs(F.col("pred") - F.col("p2")) > 1e-9).isEmpty()


def test_mean_model_equals_chained_models(labelled):
    names = feature_names(labelled)
    rows = ready(labelled, names)
    models = [fit(rows, TreeParams(depth=d, rounds=r, seed=d)) for d, r in ((1, 2), (2, 3), (3, 1))]
    chained = rows
    for i, model in enumerate(models):
        chained = model.transform(chained).withColumnRenamed("pred", f"pred_{i}")
    chained = chained.select("customer_id", "article_id", ((F.col("pred_0") + F.col("pred_1") + F.col("pred_2")) / 3).alias("mean"))
    both = score(models, labelled, names, ["customer_id", "article_id"]).join(chained, ["customer_id", "article_id"])
    assert both.count() == labelled.count() and both.where(F.abs(F.col("pred") - F.col("mean")) > 1e-12).isEmpty()


def test_out_of_fold_scores_every_row_once(labelled):
    scored, models, _ = out_of_fold(labelled, 3, TreeParams(depth=2, rounds=2), ["customer_id", "article_id"])
    assert len(models) == 3 and scored.count() == labelled.count()
    folds = scored.groupBy("customer_id").agg(F.count_distinct("fold").alias("n"))
    assert folds.where("n > 1").isEmpty()


def test_models_are_saved_with_their_features(labelled, tmp_path):
    names = feature_names(labelled)
    model = fit(ready(labelled, names), TreeParams(depth=2, rounds=2))
    save_models([model], names, (tmp_path / "m").as_uri())
    models, loaded = load_models((tmp_path / "m").as_uri())
    assert loaded == names
    keys = ["customer_id", "article_id", "pred"]
    assert as_set(score(models, labelled, names, keys[:2]), *keys) == as_set(score([model], labelled, names, keys[:2]), *keys)


def test_waves_finish_everyone_and_restart_does_nothing(spark, tmp_path):
    targets = spark.range(50).withColumnRenamed("id", "customer_id")
    path = (tmp_path / "lists").as_uri()

    def recommend(part):
        listed = F.explode(F.sequence(F.lit(1), F.lit(20))).alias("article_id")
        return part.select("customer_id", listed).withColumn("pred", F.col("article_id") * 1.0)

    assert flows.recommend_in_waves(targets, recommend, path, PARAMS, 8, 4) == 4
    assert flows.recommend_in_waves(targets, recommend, path, PARAMS, 8, 4) == 0
    assert flows.recommend_in_waves(targets, recommend, path, PARAMS, 6, 2) == 2
    got = spark.read.parquet(flows.lists_folder(path, 8))
    assert got.count() == spark.read.parquet(flows.lists_folder(path, 6)).count() == 50
    assert got.first()["prediction"].startswith("0000000020 0000000019")


def test_stack_job_end_to_end(tables):
    params = PARAMS.scaled(n_folds=2)
    store = tables.store
    args = (tables.scores(), MODELS, tables.transactions(), tables.articles(), tables.customers(), DS, params)
    scored, model = flows.train_stack(store, *args, TreeParams(depth=2, rounds=2))
    about = store.about(params, TreeParams(depth=2, rounds=2), MODELS, args[0], *args[2:5])
    assert scored.count() == about.read("stack_rows", DS.isoformat()).count()
    again, (models, names) = flows.train_stack(store, *args, TreeParams(depth=2, rounds=2))
    assert sorted(again.inputFiles()) == sorted(scored.inputFiles()) and names == model[1] and len(models) == 2
    lists, shared = flows.predict_stack(model, *args)
    customers = tables.scores().select("customer_id").distinct().count()
    assert lists.count() == customers
    per = shared.groupBy("customer_id").count().agg(F.max("count")).first()[0]
    assert per <= params.share_top


# --- what plans must not contain


LEARNED = {"stack_recommendations", "ranker_fit_score", "ranker_oof", "ranker_oof_folds", "ranker_oof_map", "ranker_top30"}


@pytest.mark.parametrize("name", sorted(set(queries()) - LEARNED))
def test_plans_stay_in_the_jvm_without_nested_loops(name, spark, folder):
    plan = plan_of(queries()[name](spark, folder))
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_wide_rows_of_purchases_meet_in_small_parts(spark, folder):
    """A task's sorts and hash maps grow with its part: the stored purchases' exchanges are read in parts of 16 MB."""
    queries()["popular_articles_topn"](spark, folder)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_training_features_move_neither_all_pairs_nor_entries_to_articles(spark, folder):
    """Purchases of a year are some ten times as many once they are pairs of each week; and a customer's entries are
    many times a candidate's keys."""
    from shelfrank.sources.bindings import OLDEST, Tables

    rows = queries()["training_features"](spark, folder)
    assert not Tables(spark, folder).store.has("weekly_pairs", OLDEST.isoformat())
    joined = []

    def walk(node):
        if node.nodeName() == "Join":
            joined.append({c.split("#")[0] for c in node.output().mkString(",").split(",")})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(rows._jdf.queryExecution().optimizedPlan())
    assert any("art_buy_hist" in columns for columns in joined) and any("own_ptype" in columns for columns in joined)
    assert not any({"own_ptype", "art_buy_hist"} <= columns for columns in joined)


def test_candidates_are_made_of_whole_sides_in_one_projection(spark, folder):
    """A candidate is a wide row: each further projection copies it again, and a customer's entries with it."""
    node = queries()["candidate_features_assembled"](spark, folder)._jdf.queryExecution().optimizedPlan()
    above = []
    while node.nodeName() != "Join":
        above.append(node.nodeName())
        node = node.children().apply(0)
    assert above == ["Project"] and node.output().size() <= 40  # of 142 features


def test_all_candidates_equal_given_ones(tables):
    """What is filled and derived on one side equals what is filled and derived on the whole row."""
    t = tables
    customers = t.label_customers().where("customer_id % 2 = 0")
    x = inputs_at(t.transactions(), t.articles(), t.customers(), customers, t.popular(), DS, PARAMS)
    made = settle(rounded(all_candidates(x)))
    given = given_candidates(x, settle(made.select("customer_id", "article_id")))
    assert set(made.columns) == set(given.columns) and dict(made.dtypes) == dict(given.dtypes)
    given = settle(rounded(given.select(*made.columns)))
    assert made.count() == given.count() > 0 and made.exceptAll(given).isEmpty()

"""Hand-made cases, equivalences and invariants of the operators."""

from collections import Counter
from datetime import date, timedelta
from heapq import heappop, heappush
import random
import statistics

from pyspark.sql import functions as F
import pytest

from conftest import as_set, plan_of
from shelfrank.functions import scalars
from shelfrank.functions.lookback import history, replay, reference_days, window_lengths
from shelfrank.operators import activity, joins
from shelfrank.operators.dedup import alone_and_shared, first_per_key, positive_wins
from shelfrank.operators.encode import count_encode, frequency_codes, narrow, value_counts
from shelfrank.operators.fill import FillPolicy
from shelfrank.operators.folds import balanced_folds, consecutive_group_ids, fill_lightest, hash_folds
from shelfrank.operators.joins import lookup, pair_with_list
from shelfrank.operators.ordering import exact_median, modal_day_age, number_rows, range_cuts, settle
from shelfrank.operators.sample import draw_places
from shelfrank.operators.topk import fold_top_k, top_k, with_rank_and_z
from shelfrank.params import RecoParams
from shelfrank.plans import clean


def one(df):
    return df.first()[0]


# --- scalars


def test_padding_leaves_long_ids_whole(spark):
    df = spark.createDataFrame([(7,), (12345678901,)], "id bigint")
    assert [r[0] for r in df.select(scalars.padded_id("id")).collect()] == ["0000000007", "12345678901"]


def test_flags_read_null_differently(spark):
    df = spark.createDataFrame([("ACTIVE", "NONE"), ("x", "x"), (None, None)], "a string, b string")
    got = df.select(scalars.flag_if("a", "ACTIVE"), scalars.flag_unless("b", "NONE")).collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 1), (0, 1)]


def test_zero_by_zero_is_null(spark):
    assert one(spark.range(1).select(scalars.ratio(F.lit(0), F.lit(0)))) is None


def test_weekly_decay_and_label_weight(spark):
    got = spark.range(1).select(
        scalars.weekly_decay(F.lit(6)), scalars.weekly_decay(F.lit(7)), scalars.label_weight(F.lit(2), 0.05)
    ).first()
    assert tuple(got) == (1.0, 0.5, 0.9)


def test_capped_bins(spark):
    df = spark.createDataFrame([(59,), (61,), (80,)], "age int")
    assert [r[0] for r in df.select(scalars.capped_bin("age", 61, 10)).collect()] == [5, 6, 6]


def test_row_statistics_skip_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    got = df.select(
        scalars.null_safe_sum(["a", "b"]), scalars.row_min(["a", "b"]), scalars.row_count(["a", "b"])
    ).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 1), (0.0, None, 0)]


def plain_ap(actual, predicted, k):
    seen, hits, total = set(), 0, 0.0
    for place, item in enumerate(predicted[:k], 1):
        if item in actual and item not in seen:
            hits += 1
            total += hits / place
        seen.add(item)
    return total / min(len(actual), k) if actual else 0.0


def test_list_average_precision(spark):
    cases = [
        (["1", "1"], ["1", "2"]), ([], ["1"]), (["1", "2"], ["2", "2", "1"]), (None, ["1"]),
        (["a", "b", "c"], ["x", "a", "c", "a", "b"]),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t array<string>, p array<string>")
    got = {r[0]: r[1] for r in df.select("i", scalars.average_precision("t", "p", 4)).collect()}
    for i, (t, p) in enumerate(cases):
        assert got[i] == pytest.approx(plain_ap(t or [], p, 4))
    assert got[0] == pytest.approx(0.5)


# --- order statistics


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds a third of the rows, with many repeated values."""
    rng = random.Random(5)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.choice([rng.gauss(0, 9), 1.0, 2.5])) for i in range(6000)]
    return rows, spark.createDataFrame(rows, "g int, v double")


def test_bucketed_median_is_exact(skewed):
    rows, df = skewed
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    got = {r["g"]: r["m"] for r in exact_median(df, ["g"], "v", "m").collect()}
    assert got == {g: pytest.approx(statistics.median(v)) for g, v in groups.items()}
    fine = range_cuts(df, "v", rows_per_part=100)
    assert len(fine.bounds) == 63
    split = {r["g"]: r["m"] for r in exact_median(df, ["g"], "v", "m", fine).collect()}
    assert split == {g: pytest.approx(m) for g, m in got.items()}


def test_bucketed_median_orders_no_group_as_a_whole(skewed):
    plan = plan_of(exact_median(skewed[1], ["g"], "v", "m"))
    assert "median" not in plan and "percentile" not in plan


def test_median_skips_missing(spark):
    df = spark.createDataFrame([(1, 1.0), (1, None), (1, 4.0), (None, 3.0)], "g int, v double")
    assert as_set(exact_median(df, ["g"], "v", "m"), "g", "m") == {(1, 2.5)}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_bucketed_numbering_equals_one_sort(spark, kind):
    rng = random.Random(3)
    rows = [(rng.randrange(4), f"https://same-head/{k}" if kind == "string" else k) for k in rng.sample(range(100000), 3000)]
    df = spark.createDataFrame(rows, f"c int, k {kind}")
    order = [("c", False), ("k", True)]
    split = as_set(number_rows(df, order, "n", rows_per_part=200), "c", "k", "n")
    assert split == as_set(number_rows(df, order, "n"), "c", "k", "n")
    want = sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: -r[0])
    assert split == {(*r, i) for i, r in enumerate(want, 1)}


def test_modal_day_takes_the_latest_of_ties(spark):
    ages = [5, 5, 4, 4, 3]  # days 1, 1, 2, 2, 3 counted back from day 6
    df = spark.createDataFrame([(1, a) for a in ages], "g int, age int")
    assert as_set(modal_day_age(df, ["g"], "age", "m"), "g", "m") == {(1, 4)}


# --- duplicates, labels


def test_first_row_per_key(spark):
    rows = [(1, 3, "c"), (1, 2, "b"), (1, 2, "a"), (2, 9, "z")]
    df = spark.createDataFrame(rows, "k int, o int, p string")
    got = first_per_key(df, ["k"], [F.col("o"), F.col("p")], ["p"])
    assert as_set(got, "k", "p") == {(1, "a"), (2, "z")}
    assert "Window" not in plan_of(got)
    numbered = df.withColumn("n", F.col("o") * 1000 + F.ascii("p"))
    hashed = first_per_key(numbered, ["k"], [F.col("n")], ["p"], unique=True)
    assert as_set(hashed, "k", "p") == {(1, "a"), (2, "z")}


def test_alone_and_shared_part_all_rows(spark):
    rows = [(1, 1, 10), (1, 2, 11), (1, 2, 12), (1, 2, 12), (2, 1, 13), (2, 1, 13), (None, 1, 14), (None, 2, 15), (None, 2, 16)]
    alone, shared = alone_and_shared(spark.createDataFrame(rows, "c int, d int, o int"), ["c", "d"], "o")
    assert sorted(tuple(r)[2] for r in alone.collect()) == [10, 13, 14]
    assert sorted(tuple(r)[2] for r in shared.collect()) == [11, 12, 12, 15, 16]


def test_orders_alone_on_their_day_are_moved_once(spark, tables, monkeypatch):
    """Lines meet their order by one exchange; what follows another one holds lines of shared orders only."""
    # orders 1 and 2 share a day, 3 is alone and holds an article twice, once in two lines of one number
    orders = [(1, 7, date(2000, 1, 1)), (2, 7, date(2000, 1, 1)), (3, 7, date(2000, 1, 2)), (4, None, date(2000, 1, 2)), (5, 7, None)]
    lines = [(1, 2, "F", 50, 1.0), (2, 1, "O", 50, 2.0), (2, 1, "O", 51, 2.5), (3, 2, "F", 50, 3.0), (3, 1, "O", 50, 4.5),
             (3, 1, "F", 50, 4.5), (3, 1, "F", 50, 4.75), (4, 1, "F", None, 5.0), (5, 1, "F", 50, 6.0), (6, 1, "F", 50, 7.0)]
    given = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_linestatus string, l_partkey long, l_extendedprice double"),
    }
    monkeypatch.setattr(tables, "raw", lambda name: settle(given[name]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    made = tables.make_transactions()
    plan = plan_of(made)
    got = {tuple(r) for r in made.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    day = [date(2000, 1, d) for d in (1, 2)]
    assert made.count() == len(got)
    assert got == {(7, 50, day[0], 1.0, 2), (7, 51, day[0], 2.5, 1), (7, 50, day[1], 4.5, 2), (None, None, day[1], 5.0, 2)}
    of_alone = plan.split("Union", 1)[1].split("\n   +- ")[0]
    assert "hashpartitioning(l_orderkey" in of_alone and "min_by" not in of_alone and "min_by" in plan


def test_merging_needs_no_sort(spark, tables):
    for df in (tables.make_transactions(), modal_day_age(spark.createDataFrame([(1, 2)], "g int, age int"), ["g"], "age", "m")):
        plan = plan_of(df)
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_positive_wins_equals_anti_join(spark):
    keys = ["week", "customer_id", "article_id"]
    pos = spark.createDataFrame([(0, 1, 1, 0.9), (0, 1, 2, 0.9)], "week int, customer_id int, article_id int, target double")
    neg = spark.createDataFrame([(0, 1, 2, 0.0), (0, 1, 3, 0.0)], pos.schema)
    by_max = as_set(positive_wins(pos, neg, keys), *keys, "target")
    assert by_max == as_set(pos.unionByName(neg.join(pos, keys, "left_anti")), *keys, "target")


def test_draws_are_different_and_complete(spark):
    df = spark.createDataFrame([(c, w, s) for c in range(50) for w in range(3) for s in (7, 30)], "customer_id bigint, week int, size int")
    drawn = draw_places(df, "customer_id", "week", "size", 20, 46, "place").collect()
    per = {}
    for r in drawn:
        per.setdefault((r["customer_id"], r["week"], r["size"]), []).append(r["place"])
    assert len(per) == 300
    for (_, _, size), places in per.items():
        assert len(places) == len(set(places)) == min(20, size)
        assert 1 <= min(places) and max(places) <= size


def test_draws_from_text_keys_spread(spark):
    df = spark.createDataFrame([(f"c{i}", 0, 500) for i in range(200)], "customer_id string, week int, size int")
    places = Counter(r["place"] for r in draw_places(df, "customer_id", "week", "size", 20, 1, "place").collect())
    assert len(places) > 450


def heap_fill(sizes, n_folds):
    """Each group, largest first, into the lightest fold."""
    heap, folds = [(0, f) for f in range(n_folds)], []
    for size in sizes:
        load, fold = heappop(heap)
        folds.append(fold)
        heappush(heap, (load + size, fold))
    return folds


def test_steps_of_equal_groups_equal_a_heap():
    rng = random.Random(12)
    for _ in range(500):
        n_folds, top = rng.randint(1, 11), rng.choice((3, 10, 200))
        histogram = [(s, rng.choice((1, 2, 7, 30, 100))) for s in sorted(rng.sample(range(1, top + 1), rng.randint(1, 3)), reverse=True)]
        told = fill_lightest(histogram, n_folds)
        got = []
        for size, n in histogram:
            steps = [(place, order) for s, place, order in told if s == size]
            for p in range(n):
                place, order = [x for x in steps if x[0] <= p][-1]
                got.append(order[(p - place) % len(order)])
        assert got == heap_fill([s for s, n in histogram for _ in range(n)], n_folds)
    assert len(fill_lightest([(10**6, 3), (1, 10**9)], 10)) < 30


def test_folds_keep_customers_together(spark):
    rows = [(c, a) for c in range(30) for a in range(1 + c % 7)]
    df = spark.createDataFrame(rows, "customer_id bigint, article_id int")
    per = hash_folds(df, "customer_id", 5, 1).groupBy("customer_id").agg(F.count_distinct("fold").alias("n"))
    assert per.where("n > 1").isEmpty()
    loads = balanced_folds(df, "customer_id", 5).groupBy("fold").agg(F.sum("group_size").alias("n")).collect()
    sizes = [r["n"] for r in loads]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 7


def test_group_ids_are_consecutive(spark):
    df = spark.createDataFrame([(2, 1), (2, 1), (1, 5), (2, 0)], "customer_id bigint, week int")
    got = as_set(consecutive_group_ids(df, ["customer_id", "week"], "g"), "customer_id", "week", "group_size", "g")
    assert got == {(1, 5, 1, 0), (2, 0, 1, 1), (2, 1, 2, 2)}


# --- encodings


def test_codes_by_frequency(spark):
    df = spark.createDataFrame([(c,) for c in "aaaabbbbccd"] + [(None,)], "code string")
    codes = frequency_codes(value_counts(df, "code"), "code", "n", 2)
    assert as_set(codes, "code", "n") == {("a", 1), ("b", 2), ("c", 0), ("d", 0)}
    counted = as_set(count_encode(df, "code", "ce"), "code", "ce")
    assert (None, None) in counted and ("a", 4) in counted


def test_narrowing_keeps_values(spark):
    df = spark.createDataFrame([(1, 127, 1.5, "x"), (2, 40000, 2.5, "y")], "a bigint, b bigint, c double, d string")
    got = narrow(df)
    assert [t for _, t in got.dtypes] == ["tinyint", "int", "float", "string"]
    assert as_set(got, "a", "b", "c", "d") == as_set(df, "a", "b", "c", "d")


def test_fill_policy_touches_existing_columns_only(spark):
    df = spark.createDataFrame([(None, None, None)], "a double, x_rank double, y double")
    got = FillPolicy({"a": 1.5, "missing": 0}, {"_rank": 100000}).apply(df).first()
    assert tuple(got) == (1.5, 100000.0, None)


# --- top k


def test_folding_blocks_equals_one_pass(spark):
    rng = random.Random(1)
    rows = [(c, a, float(rng.randrange(20))) for c in range(5) for a in range(60)]
    df = spark.createDataFrame(rows, "customer_id int, article_id int, pred double")
    order = [F.desc("pred"), F.asc("article_id")]
    kept = None
    for low in range(0, 60, 20):
        block = df.where(F.col("article_id").between(low, low + 19))
        kept = fold_top_k(kept, block, ["customer_id"], order, 7)
    cols = ["customer_id", "article_id", "pred"]
    assert as_set(kept, *cols) == as_set(top_k(df, ["customer_id"], order, 7), *cols)


def test_top_k_cuts_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("c"), "id")
    plan = plan_of(top_k(df, ["c"], [F.desc("id")], 3))
    assert plan.count("WindowGroupLimit") >= 2


def test_z_score_of_single_and_constant_groups_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 3.0), (2, 3.0), (3, 1.0), (3, 2.0)], "g int, pred double")
    got = with_rank_and_z(df, ["g"], "pred")
    assert {r["pred_norm"] for r in got.where("g < 3").collect()} == {None}
    assert sorted(r["pred_norm"] for r in got.where("g = 3").collect()) == pytest.approx([-0.70710678, 0.70710678])
    assert {r["pred_rank"] for r in got.where("g = 2").collect()} == {1}


# --- joins, windows


def test_lookup_keeps_rows_and_can_check(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    dim = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        lookup(df, dim, "k", check=True)
    assert lookup(df, dim.limit(1), "k").count() == 3


def test_draws_differ_between_customers(spark):
    df = spark.createDataFrame([(c * 1_000_003, 0, 700) for c in range(3000)], "customer_id bigint, week int, size int")
    sets = draw_places(df, "customer_id", "week", "size", 10, 46, "place").groupBy("customer_id").agg(F.sort_array(F.collect_set("place")).alias("s"))
    assert sets.select("s").distinct().count() > 2500


@pytest.mark.parametrize("row_bytes", [160, 10_000_000])
def test_pairing_gives_every_entry_once(spark, row_bytes):
    rows = spark.range(6).withColumnRenamed("id", "customer_id")
    listed = spark.range(1, 24).select(F.col("id").alias("article_id"), F.col("id").cast("int").alias("position"))
    got = pair_with_list(rows, listed, "position", 10, "customer_id", row_bytes)
    assert got.count() == got.select("customer_id", "article_id").distinct().count() == 6 * 23
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)


def test_replay_equals_one_history_per_week(spark):
    params = RecoParams(n_weeks=3, hist_days=20)
    end = date(2001, 8, 2)
    rows = [(i, end - timedelta(days=i)) for i in range(60)]
    trans = spark.createDataFrame(rows, "article_id int, t_dat date")
    got = as_set(replay(trans, end, params, 1, 20), "week", "article_id", "age_days")
    want = set()
    for week, ds in enumerate(reference_days(end, params)):
        want |= {(week, *r) for r in as_set(history(trans, ds, 20), "article_id", "age_days")}
    assert got == want
    plan = plan_of(replay(trans, end, params, 1, 20))
    assert "Join" not in plan


def test_windows_are_nested_and_pairs_roll_up(tables):
    hist, lengths = tables.hist(), window_lengths(tables.params)
    raw = activity.measures(hist, lengths, ["customer_id", "article_id"])
    merged = activity.roll_up(raw, ["article_id"])
    bad = merged.where("n_yesterday > n_recent or n_recent > n_short or n_short > n_mid or n_mid > n_hist")
    assert bad.isEmpty()
    pairs = activity.roll_up(raw, ["customer_id", "article_id"])
    counts = ["article_id", "n_hist", "n_short", "n_mid", "n_recent", "channel_hist", "last_age", "first_age"]
    assert as_set(merged, *counts) == as_set(activity.roll_up(pairs, ["article_id"]), *counts)


def test_extra_day_makes_longer_windows():
    params = RecoParams()
    assert window_lengths(params, 1) == {"yesterday": 1, "recent": 7, "short": 31, "mid": 91, "hist": 367}


# --- rounding, and parts that follow what is made


def test_rounding_equals_that_of_the_text(spark):
    rng = random.Random(11)
    values = [0.0, -0.0, 0.5, -0.5, 1e-7, -1e-7, 5e-7, 1.0000005, 2.5e-6, 0.1 + 0.2, 1 / 3, 1e300, -1e12, 123456789.1234565, float("nan"), float("inf")]
    values += [rng.uniform(-10, 10) * 10 ** rng.randrange(-8, 9) for _ in range(20_000)]
    values += [(rng.randrange(10**9) + 0.5) / 10**6 for _ in range(20_000)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (2, 6):
        both = df.select(scalars.round_half_up("x", digits).alias("a"), F.round("x", digits).alias("b"))
        assert both.where(~F.col("a").cast("string").eqNullSafe(F.col("b").cast("string"))).isEmpty()


def test_few_customers_with_a_long_list_fill_several_parts(spark):
    from shelfrank.plans.candidates import customers_by_articles

    customers = spark.range(900).selectExpr("id % 300 as customer_id").distinct()
    listed = spark.range(15000).selectExpr("id as article_id", "cast(id + 1 as int) as position")
    made = customers_by_articles(customers, listed, RecoParams())
    parts = made.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in parts) == 300 * 15000 and max(r["n"] for r in parts) < 2_000_000


# --- attributes beside rows


def test_attributes_travel_as_a_number(spark, monkeypatch):
    """A number in place of the article's attributes goes on to the customer, or the attributes if too many differ."""
    values = lambda i: [None if i == 2 else f"v{i % 3}" for _ in clean.ARTICLE_COLUMNS]
    articles = spark.createDataFrame([(a, *values(a)) for a in range(9)], "article_id long, " + ", ".join(f"{c} string" for c in clean.ARTICLE_COLUMNS))
    people = clean.CUSTOMER_COLUMNS + clean.CUSTOMER_BINS
    customers = spark.createDataFrame([(c, *[c * 10] * len(people)) for c in range(3)], "customer_id long, " + ", ".join(f"{c} int" for c in people))
    trans = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (2, 8, 3.0), (1, 99, 4.0), (7, 3, 5.0), (None, None, 6.0)], "customer_id long, article_id long, price double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = clean.enrich(trans, articles, customers, bins=True)
    plan, rows = plan_of(got), {tuple(r) for r in got.collect()}
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    plain = clean.enrich(trans, articles, customers, bins=True)
    plain_plan, plain_rows = plan_of(plain), {tuple(r) for r in plain.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    look = lambda a: tuple(values(a) if a is not None and a < 9 else [None] * len(clean.ARTICLE_COLUMNS))
    own = lambda c: tuple([c * 10 if c is not None and c < 3 else None] * len(people))
    assert rows == plain_rows == {tuple(r) + look(r[1]) + own(r[0]) for r in trans.collect()}
    assert got.columns == plain.columns and got.dtypes == plain.dtypes
    assert "BroadcastHashJoin [_look" in plan and "_look" not in plain_plan

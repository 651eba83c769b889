"""SQL that each registered query must agree with, run by DuckDB over the same tables."""

from shelfrank.plans.catalogue import (
    ATTRIBUTE_KEYS, PAIR,
)
from shelfrank.sources.bindings import PARAMS

# Columns by what a missing value becomes, written out here so that an omission elsewhere shows.
OWN_SETS = ("prod", "ptype", "graph", "col", "dep", "idx", "idxg", "sec", "garm", "code_pcol", "idxg_sec", "idxg_gram")
TREND_SUFFIXES = ("ptype", "graph", "col", "dep", "idx", "idxg", "sec", "garm")
CHANNEL_RATES = (
    "rate_sales_channel_hist", "rate_sales_channel_recent", "art_rate_sales_channel_hist", "art_rate_sales_channel_recent",
)
ZERO_FILLED = [
    *"n_buy_hist n_buy_recent n_buy_hist_short n_buy_hist_mid n_buy_hist_all n_buy_recent_all n_buy_hist_short_all".split(),
    *"n_buy_hist_mid_all n_buy_hist_short_dep n_buy_hist_mid_dep n_buy_hist_short_sec n_buy_hist_mid_sec".split(),
    *(f"n_buy_{window}_{key}" for key in OWN_SETS for window in ("hist", "recent")),
    *"art_buy_hist art_buy_hist_short art_buy_hist_mid art_buy_recent art_buy_yesterday art_buy_hist_ch1".split(),
    *"art_buy_hist_ch2 code_buy_hist code_buy_recent code_buy_yesterday age_id_n_buy_hist age_id_n_buy_recent".split(),
    *"rebuy_rate code_rebuy_rate cust_rebuy_rate".split(),
]
STALE_FILLED = [
    *"days_after_buy days_after_buy_all days_from_oldest_buy_all art_days_after_buy art_days_from_oldest_buy".split(),
    "art_days_from_mode_buy", *(f"days_after_buy_{key}" for key in OWN_SETS),
]

DS = "DATE '2001-07-26'"
AFTER = "DATE '2001-08-02'"
N = PARAMS.n_popular

BASE = f"""
tx_raw AS (
  SELECT o_custkey AS customer_id, l_partkey AS article_id, CAST(o_orderdate AS DATE) AS t_dat,
    l_extendedprice AS price, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS sales_channel_id,
    l_orderkey, l_linenumber, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tx AS (
  SELECT customer_id, article_id, t_dat, price, sales_channel_id FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_id, article_id, t_dat
      ORDER BY l_orderkey, l_linenumber, price, l_linestatus) AS rn FROM tx_raw) WHERE rn = 1),
art_raw AS (
  SELECT p_partkey AS article_id, p_name AS product_code, p_size AS product_type_no,
    p_type AS product_group_name, p_size % 10 AS graphical_appearance_no,
    split_part(p_name, ' ', 1) AS colour_group_code, p_size % 8 AS perceived_colour_value_id,
    p_size % 20 AS perceived_colour_master_id, p_brand AS department_no, p_type AS index_code,
    p_size // 10 AS index_group_no, p_size % 7 AS section_no,
    split_part(p_name, ' ', 2) AS garment_group_no
  FROM part),
art AS (
  SELECT * REPLACE (
    CAST(dense_rank() OVER (ORDER BY product_group_name) - 1 AS INTEGER) AS product_group_name,
    CAST(dense_rank() OVER (ORDER BY index_code) - 1 AS INTEGER) AS index_code) FROM art_raw),
cust_raw AS (
  SELECT c_custkey AS customer_id,
    CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE 16 + floor((c_acctbal + 1000) / 150) END AS age,
    CASE WHEN c_custkey % 3 = 0 THEN 1 END AS FN,
    CASE WHEN c_custkey % 5 = 0 THEN 1 END AS Active,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'ACTIVE' WHEN 'MACHINERY' THEN 'PRE-CREATE' END
      AS club_member_status,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'NONE' WHEN 'AUTOMOBILE' THEN 'Regularly' END
      AS fashion_news_frequency,
    CASE WHEN c_custkey % 20 = 0 THEN 'R' || (c_custkey % 200) ELSE 'N' || c_nationkey END
      AS postal_code
  FROM customer),
postal AS (
  SELECT postal_code, cnt, CASE WHEN cnt <= 10 THEN 0 ELSE
      row_number() OVER (PARTITION BY cnt <= 10 ORDER BY cnt DESC, postal_code) END AS code
  FROM (SELECT postal_code, count(*) AS cnt FROM cust_raw GROUP BY 1)),
cust_aged AS (
  SELECT * REPLACE (CAST(trunc(coalesce(age, (SELECT avg(age) FROM cust_raw))) AS INTEGER) AS age)
  FROM cust_raw),
cust AS (
  SELECT customer_id, age, age // 10 AS age_id, least(age, 61) // 10 AS age_id_1,
    least(age, 61) // 5 AS age_id_2, coalesce(FN, 0) AS FN, coalesce(Active, 0) AS Active,
    CASE WHEN club_member_status = 'ACTIVE' THEN 1 ELSE 0 END AS club_member_status,
    CASE WHEN fashion_news_frequency = 'NONE' THEN 0 ELSE 1 END AS fashion_news_frequency,
    p.code AS postal_code, p.cnt AS postal_code_ce
  FROM cust_aged c LEFT JOIN postal p ON c.postal_code = p.postal_code),
hist AS (
  SELECT *, date_diff('day', t_dat, {DS}) AS age_days FROM tx
  WHERE t_dat BETWEEN {DS} - 366 AND {DS} - 1),
lab AS (SELECT * FROM tx WHERE t_dat BETWEEN {DS} AND {DS} + 6),
labcust AS (SELECT DISTINCT customer_id FROM lab),
pop AS (
  SELECT article_id, cnt, row_number() OVER (ORDER BY cnt DESC, article_id) AS position FROM (
    SELECT article_id, count(*) AS cnt FROM tx WHERE t_dat BETWEEN {DS} - 35 AND {DS} - 1 GROUP BY 1)
  QUALIFY position <= {N}),
weeks AS (
  SELECT w AS week, {AFTER} - CAST(7 + 7 * w AS INTEGER) AS ds FROM range(10) r(w)),
popw AS (
  SELECT week, article_id, cnt,
    row_number() OVER (PARTITION BY week ORDER BY cnt DESC, article_id) AS position FROM (
    SELECT week, article_id, count(*) AS cnt FROM weeks JOIN tx ON t_dat BETWEEN ds - 28 AND ds + 6
    GROUP BY 1, 2)
  QUALIFY position <= {N}),
pos AS (
  SELECT DISTINCT week, customer_id, article_id, round(CAST(1 - 0.05 * week AS DOUBLE), 6) AS target
  FROM weeks JOIN tx ON t_dat BETWEEN ds AND ds + 6 JOIN popw USING (week, article_id)),
buyers AS (
  SELECT week, customer_id, size, customer_id % 2147483647 AS num
  FROM (SELECT DISTINCT week, customer_id FROM pos)
  JOIN (SELECT week, max(position) AS size FROM popw GROUP BY 1) USING (week)),
steps AS ( -- the first 1009 primes from 15485863 on
  SELECT p FROM range(15485863, 15485863 + 40360) t(p)
  WHERE NOT EXISTS (SELECT 1 FROM range(2, 3941) u(d) WHERE p % d = 0) ORDER BY p LIMIT 1009),
neg AS (
  SELECT week, customer_id, article_id, CAST(0 AS DOUBLE) AS target FROM (
    SELECT week, customer_id,
      (num * 7919 + week * 104729 + {PARAMS.seed}
        + d * list_extract((SELECT list(p ORDER BY p) FROM steps), (num * 31 + week * 17) % 1009 + 1)) % size + 1 AS position
    FROM buyers JOIN range({PARAMS.n_negatives}) r(d) ON d < size)
  JOIN popw USING (week, position)),
train AS (
  SELECT week, customer_id, article_id, max(target) AS target,
    CASE WHEN week = 0 THEN 'validation' ELSE 'train' END AS part
  FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg) GROUP BY ALL),
f19 AS (
  SELECT article_id, count(*) AS art_buy_hist,
    count(*) FILTER (age_days <= 7) AS art_buy_recent,
    count(*) FILTER (age_days <= 1) AS art_buy_yesterday,
    round(sum(1.0 / (1 + date_diff('day', t_dat, (SELECT max(t_dat) FROM hist)) // 7)), 6)
      AS art_buy_hist_decay
  FROM hist GROUP BY 1),
s_recent AS (
  SELECT customer_id, article_id, pred FROM labcust, (
    SELECT article_id, CAST(art_buy_recent AS DOUBLE) AS pred FROM f19 WHERE art_buy_recent > 0
    ORDER BY pred DESC, article_id LIMIT 40)),
s_decay AS (
  SELECT customer_id, article_id, pred FROM labcust, (
    SELECT article_id, art_buy_hist_decay AS pred FROM f19 WHERE art_buy_hist_decay > 0
    ORDER BY pred DESC, article_id LIMIT 40)),
s_repeat AS (
  SELECT customer_id, article_id, CAST(count(*) + CAST(1 AS DOUBLE) / (1 + min(age_days)) AS DOUBLE) AS pred
  FROM hist SEMI JOIN labcust USING (customer_id) GROUP BY 1, 2),
s_hash AS (
  SELECT customer_id, article_id, h / CAST(1009 AS DOUBLE) AS pred FROM (
    SELECT customer_id, article_id, (customer_id * 7919 + article_id * 104729) % 1009 AS h
    FROM labcust, pop WHERE position <= 100) WHERE h <> 0),
scores AS (
  SELECT customer_id, lpad(CAST(article_id AS VARCHAR), 10, '0') AS article_id, pred, model FROM (
    SELECT *, 'pop_recent' AS model FROM s_recent UNION ALL SELECT *, 'pop_decay' FROM s_decay
    UNION ALL SELECT *, 'repeat' FROM s_repeat UNION ALL SELECT *, 'hash' FROM s_hash)),
stack0 AS (
  SELECT * FROM scores
  QUALIFY row_number() OVER (PARTITION BY model, customer_id ORDER BY pred DESC, article_id) <= 24),
stack AS (
  SELECT *, dense_rank() OVER (PARTITION BY model, customer_id ORDER BY pred DESC) AS pred_rank,
    (pred - avg(pred) OVER g) / NULLIF(stddev_samp(pred) OVER g, 0) AS pred_norm
  FROM stack0 WINDOW g AS (PARTITION BY model, customer_id)),
hash_scores AS (SELECT customer_id, article_id, pred FROM scores WHERE model = 'hash'),
truth AS (SELECT customer_id, lpad(CAST(article_id AS VARCHAR), 10, '0') AS article_id, t_dat FROM lab)
"""

MODELS = ["pop_recent", "pop_decay", "repeat", "hash"]


def _pivot_columns() -> list[str]:
    cols = []
    for m in MODELS:
        for kind in ("pred", "pred_rank", "pred_norm"):
            cols.append(f"avg({kind}) FILTER (model = '{m}') AS {kind}_{m}")
    return cols


def _stats() -> list[str]:
    out = []
    for kind, tail in (("pred", ""), ("pred_rank", "_rank"), ("pred_norm", "_norm")):
        names = [f"{kind}_{m}" for m in MODELS]
        total = " + ".join(f"coalesce({c}, 0.0)" for c in names)
        out += [
            f"{total} AS preds_sum{tail}",
            f"least({', '.join(names)}) AS preds_min{tail}",
            f"greatest({', '.join(names)}) AS preds_max{tail}",
        ]
        if kind == "pred":
            out.append(" + ".join(f"CAST({c} IS NOT NULL AS BIGINT)" for c in names) + " AS preds_cnt")
    return out


WIDE = f"""
wide0 AS (SELECT customer_id, article_id, {', '.join(_pivot_columns())} FROM stack GROUP BY 1, 2),
wide AS (SELECT *, {', '.join(_stats())} FROM wide0)
"""


def _sql(body: str, *more: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join([BASE.strip(), *[m.strip() for m in more]]) + "\n" + body


def _round(cols: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _counts(prefix: str, windows: dict[str, int | None]) -> str:
    parts = []
    for tail, days in windows.items():
        where = f" FILTER (age_days <= {days})" if days else ""
        parts.append(f"count(*){where} AS {prefix}_{tail}")
    return ", ".join(parts)


ALL_WINDOWS = {"hist": None, "hist_short": 30, "hist_mid": 90, "recent": 7}


def _channel(prefix: str) -> str:
    return (
        f"avg(sales_channel_id) AS {prefix}rate_sales_channel_hist, "
        f"avg(sales_channel_id) FILTER (age_days <= 7) AS {prefix}rate_sales_channel_recent"
    )


def _price(prefix: str) -> str:
    return ", ".join(
        [f"avg(price) AS {prefix}_mean", f"median(price) AS {prefix}_median",
         f"max(price) AS {prefix}_max", f"min(price) AS {prefix}_min"]
    )


def _rebuy(source: str, key: str, target: str, name: str, ref: str = "") -> str:
    return (
        f"SELECT {ref}{key}, count(*) FILTER (n >= 2) * 1.0 / (count(*) + 5) AS {name} FROM "
        f"(SELECT {ref}{key}, {target}, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY ALL"
    )


ARTICLE_COUNTS = (
    _counts("art_buy", {**ALL_WINDOWS, "yesterday": 1})
    + ", count(*) FILTER (sales_channel_id = 1) AS art_buy_hist_ch1"
    + ", count(*) FILTER (sales_channel_id = 2) AS art_buy_hist_ch2, " + _channel("art_")
)
AGES = (
    "avg(age) AS art_age_hist_mean, median(age) AS art_age_hist_median, "
    "CAST(max(age) AS DOUBLE) AS art_age_hist_max, CAST(min(age) AS DOUBLE) AS art_age_hist_min"
)
RECENCY = "min(age_days) AS art_days_after_buy, max(age_days) AS art_days_from_oldest_buy"
def _modal(ref: str = "", h: str = "hist") -> str:
    return (
        f"SELECT {ref}article_id, age_days AS art_days_from_mode_buy FROM "
        f"(SELECT {ref}article_id, age_days, count(*) AS n FROM {h} GROUP BY ALL) "
        f"QUALIFY row_number() OVER (PARTITION BY {ref}article_id ORDER BY n DESC, age_days) = 1"
    )


def _code(ref: str = "", h: str = "hist") -> str:
    return (
        f"SELECT {ref}product_code, count(*) AS code_buy_hist, count(*) FILTER (age_days <= 7) AS code_buy_recent, "
        f"count(*) FILTER (age_days <= 1) AS code_buy_yesterday FROM {h} JOIN art_raw USING (article_id) GROUP BY ALL"
    )


def _age_group(ref: str = "", h: str = "hist") -> str:
    return (
        f"SELECT {ref}age_id, avg(sales_channel_id) AS age_id_rate_sales_channel_hist, "
        f"{_price('age_id_price_hist')}, count(*) AS age_id_n_buy_hist_all "
        f"FROM {h} JOIN cust USING (customer_id) GROUP BY ALL"
    )


def _age_article(ref: str = "", h: str = "hist") -> str:
    return (
        f"SELECT {ref}age_id, article_id, {_counts('age_id_n_buy', {'hist': None, 'recent': 7})} "
        f"FROM {h} JOIN cust USING (customer_id) GROUP BY ALL"
    )


def _customer(ref: str = "", source: str = "hist SEMI JOIN labcust USING (customer_id)") -> str:
    return (
        f"SELECT {ref}customer_id, {_channel('')}, {_price('user_price_hist')}, "
        "count(*) AS n_buy_hist_all, count(*) FILTER (age_days <= 30) AS n_buy_hist_short_all, "
        "count(*) FILTER (age_days <= 90) AS n_buy_hist_mid_all, count(*) FILTER (age_days <= 7) AS n_buy_recent_all, "
        f"min(age_days) AS days_after_buy_all, max(age_days) AS days_from_oldest_buy_all FROM {source} GROUP BY ALL"
    )


def _attribute(
    key, source: str = "hist JOIN art USING (article_id)", text: bool = True, ref: str = ""
) -> str:
    cols = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if text else c for c in key.columns)
    days = {"n_hist": None, "n_recent": 7, "n_short": 30, "n_mid": 90}
    counts = ", ".join(
        f"count(*){f' FILTER (age_days <= {days[m]})' if days[m] else ''} AS {name}"
        for name, m in key.counts.items()
    )
    return (
        f"SELECT {ref}customer_id, {cols}, {counts}, min(age_days) AS {key.recency} "
        f"FROM {source} GROUP BY ALL"
    )


def _assembled(candidates: str, ref: str = "", h: str = "hist", *more: str) -> str:
    """Candidates with one join per key-set, then fills, then derived columns. In a replay every
    key-set also has the week."""
    ctes = [
        *more,
        f"hart AS (SELECT * FROM {h} JOIN art USING (article_id))",
        f"f1 AS (SELECT {ref}article_id, {ARTICLE_COUNTS}, {RECENCY}, {_price('art_price_hist')} FROM {h} GROUP BY ALL)",
        f"f1age AS (SELECT {ref}article_id, {AGES} FROM {h} JOIN cust USING (customer_id) GROUP BY ALL)",
        f"f1mode AS ({_modal(ref, h)})",
        f"f1rate AS ({_rebuy(h, 'article_id', 'customer_id', 'rebuy_rate', ref)})",
        f"f2 AS ({_code(ref, h)})",
        f"f2rate AS ({_rebuy('hart', 'product_code', 'customer_id', 'code_rebuy_rate', ref)})",
        f"f3 AS ({_age_group(ref, h)})",
        f"f4 AS ({_age_article(ref, h)})",
        f"f5 AS ({_customer(ref, h)})",
        f"f5rate AS ({_rebuy(h, 'customer_id', 'article_id', 'cust_rebuy_rate', ref)})",
    ]
    keys = {
        "f1": "article_id", "f1age": "article_id", "f1mode": "article_id", "f1rate": "article_id",
        "f2": "product_code", "f2rate": "product_code", "f3": "age_id", "f4": "age_id, article_id",
        "f5": "customer_id", "f5rate": "customer_id",
    }
    joins = [f"LEFT JOIN {name} USING ({ref}{key})" for name, key in keys.items()]
    for i, key in enumerate((PAIR, *ATTRIBUTE_KEYS)):
        ctes.append(f"k{i} AS ({_attribute(key, 'hart', text=False, ref=ref)})")
        joins.append(f"LEFT JOIN k{i} USING ({ref}customer_id, {', '.join(key.columns)})")
    fills = {**dict.fromkeys(ZERO_FILLED, 0), **dict.fromkeys(STALE_FILLED, 376),
             **dict.fromkeys(CHANNEL_RATES, 1.5)}
    filled = ", ".join(f"coalesce({c}, {v}) AS {c}" for c, v in fills.items())
    ctes.append(
        "cand AS (SELECT * EXCLUDE (age_id_1, age_id_2) FROM " + candidates + " "
        "JOIN art USING (article_id) JOIN cust USING (customer_id) " + " ".join(joins) + ")"
    )
    ctes.append(f"filled AS (SELECT * REPLACE ({filled}) FROM cand)")
    d = []
    for ch in ("ch1", "ch2"):
        for w in ("hist", "recent"):
            d.append(f"art_buy_hist_{ch} * rate_sales_channel_{w} AS art_buy_hist_{ch}_x_u_{w}")
    for a, users in {"median": ("median", "max", "min"), "max": ("max", "median"), "min": ("min", "median")}.items():
        for u in users:
            d.append(f"round(art_price_hist_{a} - user_price_hist_{u}, 6) AS diff_price_hist_{a}_{u}")
    for small, large in (("yesterday", "recent"), ("recent", "hist"), ("recent", "hist_short"), ("recent", "hist_mid")):
        d.append(f"art_buy_{small} * 1.0 / NULLIF(art_buy_{large}, 0) AS art_buy_{small}_{large}_rate")
        d.append(f"art_buy_{large} - art_buy_{small} AS art_buy_{small}_{large}_diff")
    d.append("n_buy_recent * 1.0 / NULLIF(n_buy_hist, 0) AS n_buy_recent_hist_rate")
    d.append("rate_sales_channel_recent / NULLIF(rate_sales_channel_hist, 0) AS rate_sales_channel_recent_hist_rate")
    for s in TREND_SUFFIXES:
        d.append(f"n_buy_recent_{s} * 1.0 / NULLIF(n_buy_hist_{s}, 0) AS n_buy_rate_{s}")
    body = f"""
SELECT * REPLACE ({_round(['rebuy_rate', 'code_rebuy_rate', 'cust_rebuy_rate', *CHANNEL_RATES,
  'art_age_hist_mean', 'age_id_rate_sales_channel_hist', 'art_buy_hist_ch1_x_u_hist', 'art_buy_hist_ch1_x_u_recent',
  'art_buy_hist_ch2_x_u_hist', 'art_buy_hist_ch2_x_u_recent', 'art_buy_yesterday_recent_rate',
  'art_buy_recent_hist_rate', 'art_buy_recent_hist_short_rate', 'art_buy_recent_hist_mid_rate',
  'n_buy_recent_hist_rate', 'rate_sales_channel_recent_hist_rate', *[f'n_buy_rate_{s}' for s in TREND_SUFFIXES]])},
  {_round([f'{p}_price_hist_{s}' for p in ('art', 'user', 'age_id') for s in ('mean', 'median', 'max', 'min')])})
FROM (SELECT *, {', '.join(d)} FROM filled)"""
    return _sql(body, *ctes)


AP = """
shown AS (
  SELECT *, row_number() OVER (PARTITION BY model, customer_id ORDER BY pred DESC, article_id) AS place
  FROM scores),
n_truth AS (SELECT customer_id, count(*) AS n_actual FROM truth GROUP BY 1),
ap AS (
  SELECT model, k, customer_id, max(n_actual) AS n_actual, sum(hit) AS n_hits,
    coalesce(sum(hit * hits_so_far * 1.0 / place) / least(max(n_actual), k), 0) AS ap
  FROM (
    SELECT s.model, k, s.customer_id, s.place, CAST(t.article_id IS NOT NULL AS BIGINT) AS hit,
      coalesce(n_actual, 0) AS n_actual,
      sum(CAST(t.article_id IS NOT NULL AS BIGINT)) OVER (PARTITION BY s.model, k, s.customer_id ORDER BY place)
        AS hits_so_far
    FROM shown s JOIN (VALUES (10), (12)) ks(k) ON place <= k
    LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM truth) t USING (customer_id, article_id)
    LEFT JOIN n_truth USING (customer_id))
  GROUP BY 1, 2, 3)
"""


# What a pair pulls: the change of average precision if its rows change places, times how wrong it is.
GRADIENTS = """
scored AS (
  SELECT 'equal' AS scores, week, customer_id, article_id, target, 0::DOUBLE AS s FROM train
  UNION ALL SELECT 'mixed', week, customer_id, article_id, target, ((customer_id * 31 + article_id * 17) % 101) / 101.0::DOUBLE FROM train),
numbered AS (
  SELECT *, (target > 0)::INT AS hit, row_number() OVER (PARTITION BY scores, week, customer_id ORDER BY s DESC, article_id) AS place FROM scored),
placed AS (
  SELECT *, sum(hit) OVER w AS hits, sum(hit::DOUBLE / place) OVER w AS inverse,
    sum(hit) OVER (PARTITION BY scores, week, customer_id) AS all_hits
  FROM numbered WINDOW w AS (PARTITION BY scores, week, customer_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
pairs AS (
  SELECT h.scores, h.week, h.customer_id, h.article_id AS a, m.article_id AS b, 1 / (1 + exp(h.s - m.s)) AS odds,
    (h.target - m.target) / h.all_hits * CASE WHEN h.place < m.place
      THEN h.hits::DOUBLE / h.place - m.hits::DOUBLE / m.place + m.inverse - h.inverse
      ELSE (m.hits + 1)::DOUBLE / m.place - h.hits::DOUBLE / h.place + h.inverse - 1.0::DOUBLE / h.place - m.inverse END AS weight
  FROM placed h JOIN placed m ON h.scores = m.scores AND h.week = m.week AND h.customer_id = m.customer_id
  WHERE h.hit = 1 AND m.hit = 0),
pulls AS (
  SELECT scores, week, customer_id, article_id, sum(pull) AS pull, sum(bend) AS bend FROM (
    SELECT scores, week, customer_id, a AS article_id, weight * odds AS pull, weight * odds * (1 - odds) AS bend FROM pairs
    UNION ALL SELECT scores, week, customer_id, b, -weight * odds, weight * odds * (1 - odds) FROM pairs)
  GROUP BY ALL)
"""


def _fill(sizes: str) -> str:
    """Groups by falling size, one after another, into the lightest of ten folds (of as many as there are groups)."""
    return f"""
groups AS (SELECT *, row_number() OVER (ORDER BY n DESC, customer_id) AS p FROM ({sizes})),
fill AS (
  SELECT 0::BIGINT AS p, list_transform(range(least(10, (SELECT count(*) FROM groups))), lambda x: 0::BIGINT) AS loads, NULL::BIGINT AS fold
  UNION ALL
  SELECT p, list_transform(loads, lambda x, i: CASE WHEN i = lightest THEN x + n ELSE x END), lightest - 1
  FROM (SELECT g.p, g.n, loads, list_position(loads, list_min(loads)) AS lightest FROM fill JOIN groups g ON g.p = fill.p + 1))
"""


def oracles() -> dict[str, str]:
    out = {
        "transactions_dedup": _sql("SELECT * FROM tx"),
        "transactions_enriched": _sql(
            "SELECT * FROM tx LEFT JOIN art USING (article_id) LEFT JOIN cust USING (customer_id)"
        ),
        "customers_clean": _sql("SELECT * FROM cust"),
        "postal_count_encoding": _sql(
            "SELECT customer_id, postal_code, count(*) OVER (PARTITION BY postal_code) AS postal_code_ce FROM cust_raw"
        ),
        "postal_rare_grouping": _sql("SELECT * FROM postal"),
        "label_encode_index_code": _sql(
            "SELECT index_code, count(*) AS n_articles, CAST(dense_rank() OVER (ORDER BY index_code) - 1 AS INTEGER) AS code "
            "FROM art_raw GROUP BY 1"
        ),
        "schema_narrowing_report": _sql(
            "SELECT column_name, min_value, max_value, CASE WHEN column_name = 'price' THEN 'float' "
            "WHEN min_value > -128 AND max_value < 127 THEN 'tinyint' "
            "WHEN min_value > -32768 AND max_value < 32767 THEN 'smallint' "
            "WHEN min_value > -2147483648 AND max_value < 2147483647 THEN 'int' ELSE 'bigint' END AS chosen_type FROM ("
            + " UNION ALL ".join(
                f"SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM tx"
                for c in ("customer_id", "article_id", "price", "sales_channel_id")
            ) + ")"
        ),
        "article_id_padded": _sql(
            "SELECT article_id, lpad(CAST(article_id AS VARCHAR), 10, '0') AS article_key FROM art_raw"
        ),
        "week_calendar": _sql(
            "SELECT week, " + ", ".join(
                f"strftime({expr}, '%Y-%m-%d') AS {name}" for name, expr in {
                    "ds": "b", "de": "b + 6", "der": "b - 1", "dsr": "b - 7", "dsh_short": "b - 30",
                    "dsh_mid": "b - 90", "dsh": "b - 366", "ds_popular": "b - 28"}.items()
            ) + ", count(*) FILTER (t_dat BETWEEN b AND b + 6) AS n_label,"
            " count(*) FILTER (t_dat BETWEEN b - 366 AND b - 1) AS n_hist"
            " FROM (SELECT w AS week, (SELECT max(t_dat) FROM tx) - CAST(6 + 7 * w AS INTEGER) AS b FROM range(10) r(w))"
            " JOIN tx ON t_dat BETWEEN b - 366 AND b + 6 GROUP BY week, b"
        ),
        "popular_articles_topn": _sql("SELECT * FROM pop"),
        "popular_articles_by_week": _sql("SELECT * FROM popw"),
        "article_window_counts": _sql(
            "SELECT * REPLACE (" + _round(["art_rate_sales_channel_hist", "art_rate_sales_channel_recent"])
            + f") FROM (SELECT article_id, {ARTICLE_COUNTS} FROM hist GROUP BY 1)"
        ),
        "article_recency": _sql(f"SELECT article_id, {RECENCY} FROM hist GROUP BY 1"),
        "article_modal_day": _sql(_modal()),
        "article_price_age_stats": _sql(
            f"SELECT * REPLACE (round(art_price_hist_mean, 6) AS art_price_hist_mean, "
            f"round(art_price_hist_median, 6) AS art_price_hist_median, round(art_age_hist_mean, 6) AS art_age_hist_mean) "
            f"FROM (SELECT article_id, {_price('art_price_hist')}, {AGES} "
            "FROM hist JOIN cust USING (customer_id) GROUP BY 1)"
        ),
        "article_rebuy_rate": _sql(
            f"SELECT * REPLACE (round(rebuy_rate, 6) AS rebuy_rate) FROM ({_rebuy('hist', 'article_id', 'customer_id', 'rebuy_rate')})"
        ),
        "code_rebuy_rate": _sql(
            "SELECT * REPLACE (round(code_rebuy_rate, 6) AS code_rebuy_rate) FROM ("
            + _rebuy("(SELECT * FROM hist JOIN art_raw USING (article_id))", "product_code", "customer_id", "code_rebuy_rate") + ")"
        ),
        "customer_rebuy_rate": _sql(
            f"SELECT * REPLACE (round(cust_rebuy_rate, 6) AS cust_rebuy_rate) FROM ({_rebuy('hist', 'customer_id', 'article_id', 'cust_rebuy_rate')})"
        ),
        "article_decayed_count": _sql("SELECT * FROM f19"),
        "code_features": _sql(
            f"SELECT c.*, round(code_rebuy_rate, 6) AS code_rebuy_rate FROM ({_code()}) c JOIN ("
            + _rebuy("(SELECT * FROM hist JOIN art_raw USING (article_id))", "product_code", "customer_id", "code_rebuy_rate")
            + ") USING (product_code)"
        ),
        "age_group_features": _sql(
            "SELECT * REPLACE (round(age_id_rate_sales_channel_hist, 6) AS age_id_rate_sales_channel_hist, "
            f"round(age_id_price_hist_mean, 6) AS age_id_price_hist_mean, "
            f"round(age_id_price_hist_median, 6) AS age_id_price_hist_median) FROM ({_age_group()})"
        ),
        "age_group_article_features": _sql(_age_article()),
        "customer_features": _sql(
            "SELECT * REPLACE (" + _round(["rate_sales_channel_hist", "rate_sales_channel_recent", "user_price_hist_median", "cust_rebuy_rate"])
            + f", round(user_price_hist_mean, 6) AS user_price_hist_mean) FROM ({_customer()}) JOIN ("
            + _rebuy("hist", "customer_id", "article_id", "cust_rebuy_rate") + ") USING (customer_id)"
        ),
        "customer_article_features": _sql(
            "SELECT * REPLACE (CAST(article_id AS BIGINT) AS article_id) FROM (" + _attribute(PAIR, "hist", text=False) + ")"
        ),
        "candidate_cross_join": _sql("SELECT customer_id, article_id, position FROM labcust, pop"),
        "candidate_features_assembled": _assembled("(SELECT customer_id, article_id FROM labcust, pop)"),
        "training_features": _assembled(
            "train", "week, ", "whist",
            "whist AS (SELECT week, tx.*, date_diff('day', t_dat, ds) AS age_days "
            "FROM weeks JOIN tx ON t_dat BETWEEN ds - 366 AND ds - 1)",
        ),
        "positives_decayed": _sql("SELECT * FROM pos"),
        "negatives_sampled": _sql("SELECT * FROM neg"),
        "training_set": _sql("SELECT * FROM train"),
        "group_ids": _sql(
            "SELECT customer_id, week, count(*) AS group_size, row_number() OVER (ORDER BY customer_id, week) - 1 AS group_id "
            "FROM train WHERE part = 'train' GROUP BY 1, 2"
        ),
        "grouped_folds": _sql(
            "SELECT customer_id, n AS group_size, fold FROM groups JOIN fill USING (p)",
            _fill("SELECT customer_id, count(DISTINCT article_id) AS n FROM scores GROUP BY 1"), recursive=True
        ),
        "score_tables_normalised": _sql("SELECT * REPLACE (round(pred, 6) AS pred) FROM scores"),
        "list_format_scores": _sql(
            "SELECT customer_id, article_id, CAST(1 - row_number() OVER (PARTITION BY customer_id ORDER BY pred DESC, article_id) AS DOUBLE) AS pred, "
            "'listed' AS model FROM scores WHERE model = 'pop_recent' QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY scores.pred DESC, article_id) <= 12"
        ),
        "model_registry": _sql(
            "SELECT model, count(*) AS n_scores, count(DISTINCT customer_id) AS n_customers, CAST(lb AS DOUBLE) AS lb, CAST(cv AS DOUBLE) AS cv, CAST(round(cv - lb, 6) AS DOUBLE) AS cv_lb_gap "
            "FROM scores JOIN (VALUES ('pop_recent', 0.021, 0.0234), ('pop_decay', 0.02, 0.0229), ('repeat', 0.017, 0.0201), "
            "('hash', NULL, 0.0011)) r(model, lb, cv) USING (model) GROUP BY model, lb, cv"
        ),
        "duplicate_audit": _sql(
            "SELECT model, count(*) AS n_keys, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (n > 1) AS n_duplicated FROM ("
            "SELECT model, customer_id, article_id, count(*) AS n FROM (SELECT model, customer_id, article_id FROM scores "
            "UNION ALL SELECT 'purchases', customer_id, lpad(CAST(article_id AS VARCHAR), 10, '0') FROM tx_raw) GROUP BY 1, 2, 3) GROUP BY 1"
        ),
        "top24_rank_zscore": _sql("SELECT * REPLACE (round(pred, 6) AS pred, round(pred_norm, 6) AS pred_norm) FROM stack"),
        "pivot_scores": _sql(
            "SELECT customer_id, article_id, " + _round([f"{k}_{m}" for m in MODELS for k in ("pred", "pred_rank", "pred_norm")]) + " FROM wide0", WIDE
        ),
        "row_wise_score_stats": _sql(
            "SELECT customer_id, article_id, preds_cnt, "
            + _round([f"preds_{f}{t}" for t in ("", "_rank", "_norm") for f in ("sum", "min", "max")]) + " FROM wide", WIDE
        ),
        "stack_features_assembled": _sql(
            "SELECT * REPLACE ("
            + ", ".join(f"round(coalesce({c}, 100000), 6) AS {c}" for c in
                        [f"pred_rank_{m}" for m in MODELS] + [f"preds_{f}_rank" for f in ("sum", "min", "max")]) + ", "
            + _round([f"{k}_{m}" for m in MODELS for k in ("pred", "pred_norm")]
                     + [f"preds_{f}{t}" for t in ("", "_norm") for f in ("sum", "min", "max")]) + ", "
            + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("art_buy_hist", "art_buy_recent", "art_buy_yesterday", "art_buy_hist_decay"))
            + ") FROM wide LEFT JOIN (SELECT * REPLACE (lpad(CAST(article_id AS VARCHAR), 10, '0') AS article_id) FROM art) USING (article_id) "
            "LEFT JOIN cust USING (customer_id) "
            "LEFT JOIN (SELECT * REPLACE (lpad(CAST(article_id AS VARCHAR), 10, '0') AS article_id) FROM f19) USING (article_id)", WIDE
        ),
        "stack_truth_open_ended": _sql(
            f"SELECT customer_id, article_id, count(*) AS n_days, max(t_dat) AS newest FROM tx WHERE t_dat > {DS} - 22 GROUP BY 1, 2"
        ),
        "stack_labelled": _sql(
            "SELECT customer_id, article_id, CAST((customer_id, article_id) IN (SELECT (customer_id, article_id) FROM truth) AS BIGINT) AS target FROM wide0", WIDE
        ),
        "recall_coverage": _sql(
            "SELECT sum(h)::BIGINT AS hits, (SELECT count(*) FROM truth) AS label_rows, count(*) FILTER (h > 0) AS covered, count(*) AS customers, "
            "round(sum(h) * 1.0 / (SELECT count(*) FROM truth), 6) AS recall, round(count(*) FILTER (h > 0) * 1.0 / count(*), 6) AS user_coverage "
            "FROM (SELECT customer_id, sum(CAST((customer_id, article_id) IN (SELECT (customer_id, article_id) FROM truth) AS BIGINT)) AS h FROM wide0 GROUP BY 1)", WIDE
        ),
        "topk_customer": _sql(
            f"SELECT customer_id, article_id, round(pred, 6) AS pred, row_number() OVER (PARTITION BY customer_id ORDER BY hash_scores.pred DESC, article_id) AS place FROM hash_scores QUALIFY place <= {PARAMS.keep}"
        ),
        "topk_customer_tiebreak": _sql(
            "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY pred DESC, art_buy_recent DESC, article_id) AS place FROM ("
            "SELECT customer_id, h.article_id, CAST(floor(h.pred * 10) AS BIGINT) AS pred, coalesce(art_buy_recent, 0) AS art_buy_recent "
            "FROM hash_scores h LEFT JOIN f19 ON CAST(h.article_id AS BIGINT) = f19.article_id) QUALIFY place <= 12"
        ),
        "mean_score_dedup": _sql("SELECT customer_id, article_id, round(avg(pred), 6) AS pred FROM scores GROUP BY 1, 2"),
        "recommendation_strings": _sql(
            "SELECT customer_id, string_agg(article_id, ' ' ORDER BY pred DESC, article_id) AS prediction FROM ("
            "SELECT * FROM hash_scores QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY pred DESC, article_id) <= 12) GROUP BY 1"
        ),
        "ground_truth_lists": _sql(
            "SELECT customer_id, string_agg(article_id, ' ' ORDER BY article_id) AS articles, count(*) AS n_articles FROM truth GROUP BY 1"
        ),
        "ap_at_k": _sql(
            "SELECT customer_id, n_actual, CAST(n_hits AS BIGINT) AS n_hits, round(ap, 6) AS ap FROM ap WHERE model = 'hash' AND k = 12", AP
        ),
        "map_at_k": _sql(
            "SELECT model, CAST(k AS BIGINT) AS k, round(avg(ap), 6) AS map_at_k, count(*) AS n_customers FROM ap GROUP BY 1, 2", AP
        ),
        "map_by_candidate_cutoff": _sql(
            "SELECT CAST(cutoff AS BIGINT) AS cutoff, round(avg(ap), 6) AS map_at_k, count(*) AS n_customers FROM ("
            "SELECT cutoff, customer_id, sum(hit * hits * 1.0 / place) / least(max(n_actual), 12) AS ap FROM ("
            "SELECT *, sum(hit) OVER (PARTITION BY cutoff, customer_id ORDER BY place) AS hits FROM ("
            "SELECT cutoff, c.customer_id, place, n_actual, CAST(t.article_id IS NOT NULL AS BIGINT) AS hit FROM ("
            "SELECT cutoff, customer_id, article_id, row_number() OVER (PARTITION BY cutoff, customer_id ORDER BY "
            "cnt + (customer_id * 7919 + article_id * 104729) % 1009 / 1009.0 DESC, article_id) AS place "
            "FROM labcust, pop JOIN (VALUES (25), (50), (100), (200)) cs(cutoff) ON position <= cutoff QUALIFY place <= 12) c "
            "LEFT JOIN (SELECT DISTINCT customer_id, article_id FROM lab) t USING (customer_id, article_id) "
            "JOIN (SELECT customer_id, count(*) AS n_actual FROM lab GROUP BY 1) USING (customer_id))) GROUP BY 1, 2) GROUP BY 1"
        ),
        "ensemble_mean": _sql(
            "SELECT customer_id, article_id, round(sum(coalesce(pred_norm, 0.0)) / 4, 6) AS pred FROM stack GROUP BY 1, 2"
        ),
        "flagship_recommendations": _sql(
            "SELECT customer_id, string_agg(lpad(CAST(article_id AS VARCHAR), 10, '0'), ' ' ORDER BY pred DESC, article_id) AS prediction FROM ("
            "SELECT customer_id, article_id, coalesce(a.n, 0) + 50 * coalesce(p.n, 0) AS pred FROM labcust CROSS JOIN pop "
            "LEFT JOIN (SELECT article_id, count(*) AS n FROM hist GROUP BY 1) a USING (article_id) "
            "LEFT JOIN (SELECT customer_id, article_id, count(*) AS n FROM hist GROUP BY 1, 2) p USING (customer_id, article_id) "
            "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY pred DESC, article_id) <= 12) GROUP BY 1"
        ),
        "recommendations_for_everyone": _sql(
            "SELECT customer_id, string_agg(lpad(CAST(article_id AS VARCHAR), 10, '0'), ' ' ORDER BY pred DESC, article_id) AS prediction FROM ("
            "SELECT customer_id, article_id, coalesce(a.n, 0) + 50 * coalesce(p.n, 0) AS pred FROM (SELECT c_custkey AS customer_id FROM customer) CROSS JOIN pop "
            "LEFT JOIN (SELECT article_id, count(*) AS n FROM hist GROUP BY 1) a USING (article_id) "
            "LEFT JOIN (SELECT customer_id, article_id, count(*) AS n FROM hist GROUP BY 1, 2) p USING (customer_id, article_id) "
            "QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY pred DESC, article_id) <= 12) GROUP BY 1"
        ),
        "transactions_from_csv": _sql(
            "SELECT customer_id, article_id, t_dat, price, sales_channel_id FROM tx_raw WHERE t_dat >= DATE '1998-01-01' "
            "QUALIFY row_number() OVER (PARTITION BY customer_id, article_id, t_dat ORDER BY price, sales_channel_id) = 1"
        ),
        "transactions_from_damaged_csv": _sql(
            "SELECT customer_id, article_id, t_dat, price, sales_channel_id FROM tx_raw WHERE t_dat >= DATE '1998-01-01' "
            "AND article_id % 97 <> 5 "
            "QUALIFY row_number() OVER (PARTITION BY customer_id, article_id, t_dat ORDER BY price, sales_channel_id) = 1"
        ),
        "csv_inferred_types": _sql(
            "SELECT column_name, inferred, loaded, n_sound, CASE WHEN column_name = 'price' THEN n - n_sound ELSE 0 END AS n_aside "
            "FROM (SELECT count(*) AS n, count(*) FILTER (WHERE article_id % 97 <> 5) AS n_sound, "
            "CASE WHEN max(customer_id) < 2147483648 THEN 'int' ELSE 'bigint' END AS customers, "
            "CASE WHEN max(article_id) < 2147483648 THEN 'int' ELSE 'bigint' END AS articles, "
            "CASE WHEN bool_or(article_id % 97 = 5) THEN 'string' ELSE 'double' END AS prices FROM tx_raw), "
            "LATERAL (VALUES ('t_dat', 'date', 'string'), ('customer_id', customers, 'string'), ('article_id', articles, 'bigint'), "
            "('price', prices, 'double'), ('sales_channel_id', 'int', 'int'), ('bought_in', 'int', 'int')) v(column_name, inferred, loaded)"
        ),
        "transactions_since": _sql("SELECT * FROM tx WHERE t_dat >= DATE '1998-01-01'"),
        "grouped_folds_hash": _sql(
            "SELECT DISTINCT customer_id, (('0x' || substr(md5(customer_id || ':46'), 1, 15))::BIGINT % 10)::INTEGER AS fold FROM scores"
        ),
        "ranker_gradients": _sql(
            "SELECT scores, week, customer_id, article_id, target, round(coalesce(pull, 0) + 1e-8, 6) AS gradient, round(coalesce(bend, 0) + 1e-8, 6) AS curvature "
            "FROM placed LEFT JOIN pulls USING (scores, week, customer_id, article_id)", GRADIENTS
        ),
        "ranker_oof_folds": _sql(
            "SELECT customer_id, article_id, fold, true AS scored FROM wide0 JOIN groups USING (customer_id) JOIN fill USING (p)",
            WIDE, _fill("SELECT customer_id, count(*) AS n FROM wide0 GROUP BY 1"), recursive=True
        ),
        "stack_recommendations": _sql(
            "SELECT customer_id, least(12, count(*)) AS n_listed, least(30, count(*)) AS n_shared, true AS in_order FROM wide0 GROUP BY 1", WIDE
        ),
        "unfinished_customers": _sql("SELECT customer_id FROM cust_raw ANTI JOIN hash_scores USING (customer_id)"),
        "intermediate_round_trip": _sql(
            "SELECT * EXCLUDE (age_days, age_id_1, age_id_2) FROM hist LEFT JOIN art USING (article_id) LEFT JOIN cust USING (customer_id)"
        ),
    }
    for key in ATTRIBUTE_KEYS:
        kind = "attr_pair" if len(key.columns) > 1 else "attr"
        out[f"customer_{kind}_features_{key.suffix}"] = _sql(_attribute(key))
    return out

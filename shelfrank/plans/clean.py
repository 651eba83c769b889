"""Cleaned dimensions and enriched transactions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.scalars import capped_bin, flag_if, flag_unless
from shelfrank.operators.encode import frequency_codes, mean_filled, ordinal_encode, value_counts
from shelfrank.operators.joins import distinct_values, lookup
from shelfrank.params import RecoParams

ARTICLE_COLUMNS = [
    "product_code", "product_type_no", "product_group_name", "graphical_appearance_no",
    "colour_group_code", "perceived_colour_value_id", "perceived_colour_master_id",
    "department_no", "index_code", "index_group_no", "section_no", "garment_group_no",
]
CUSTOMER_COLUMNS = [
    "age", "age_id", "FN", "Active", "club_member_status", "fashion_news_frequency",
    "postal_code", "postal_code_ce",
]
CUSTOMER_BINS = ["age_id_1", "age_id_2"]


def clean_articles(articles: DataFrame) -> DataFrame:
    """Text attributes that have an order become 0, 1 ... in that order."""
    for c in ("index_code", "product_group_name"):
        articles = ordinal_encode(articles, c)
    return articles.select("article_id", *ARTICLE_COLUMNS)


def customer_ages(customers: DataFrame, age_groups: DataFrame) -> DataFrame:
    """Whole ages, missing ones at the mean, with their groups."""
    aged = customers.withColumn("age", mean_filled(customers, "age").cast("int"))
    return lookup(aged, age_groups, "age")


def clean_customers(customers: DataFrame, age_groups: DataFrame, params: RecoParams) -> DataFrame:
    """Ages, 0/1 flags, and postal codes by frequency."""
    flat = customer_ages(customers, age_groups).withColumns(
        {
            "FN": F.coalesce(F.col("FN"), F.lit(0)),
            "Active": F.coalesce(F.col("Active"), F.lit(0)),
            "club_member_status": flag_if("club_member_status", "ACTIVE"),
            "fashion_news_frequency": flag_unless("fashion_news_frequency", "NONE"),
            "age_id_1": capped_bin("age", 61, 10),
            "age_id_2": capped_bin("age", 61, 5),
        }
    )
    postal = frequency_codes(
        value_counts(customers, "postal_code"), "postal_code", "_code", params.rare_limit
    ).withColumnRenamed("cnt", "postal_code_ce")
    coded = lookup(flat, postal, "postal_code")
    return coded.drop("postal_code").withColumnRenamed("_code", "postal_code").select(
        "customer_id", *CUSTOMER_COLUMNS, *CUSTOMER_BINS
    )


def enrich(
    rows: DataFrame, articles: DataFrame, customers: DataFrame, bins: bool = False
) -> DataFrame:
    """Article and customer attributes beside every row. Rows go on to their customer with a number for the
    article's attributes, unless more of these differ than can be broadcast."""
    people = customers.select("customer_id", *CUSTOMER_COLUMNS, *(CUSTOMER_BINS if bins else []))
    split = distinct_values(articles, "article_id", ARTICLE_COLUMNS, "_look")
    if split is None:
        rows = lookup(rows, articles.select("article_id", *ARTICLE_COLUMNS), "article_id")
        return lookup(rows, people, "customer_id")
    numbered, looks = split
    known = lookup(lookup(rows, numbered, "article_id"), people, "customer_id")
    others = [c for c in rows.columns if c not in ("customer_id", "article_id")]
    return lookup(known, looks, "_look").select(
        "customer_id", "article_id", *others, *ARTICLE_COLUMNS, *[c for c in people.columns if c != "customer_id"]
    )

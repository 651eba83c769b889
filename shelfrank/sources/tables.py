"""Input tables: declared schemas, text and parquet scans, and the text sink."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from shelfrank.functions.scalars import parse_day
from shelfrank.operators.dedup import first_per_key

# fixed values: column names and types of the input tables
SCHEMAS = {
    "transactions": "t_dat string, customer_id string, article_id bigint, price double, sales_channel_id int",
    "articles": (
        "article_id bigint, product_code int, product_type_no int, product_group_name string, "
        "graphical_appearance_no int, colour_group_code int, perceived_colour_value_id int, "
        "perceived_colour_master_id int, department_no int, index_code string, "
        "index_group_no int, section_no int, garment_group_no int"
    ),
    "customers": (
        "customer_id string, FN double, Active double, club_member_status string, "
        "fashion_news_frequency string, age double, postal_code string"
    ),
    "age_groups": "age int, age_id int",
    "submission": "customer_id string, prediction string",
    "scores": "customer_id string, article_id bigint, pred double",
}

_RECORD = "_damaged_record"


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).option("header", True).csv(path)


def scan_csv(spark: SparkSession, path: str, table: str) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """A text table whose types are inferred over all its records: the sound rows, the records set
    aside (``record`` as it stands in the file, ``faults`` as names of columns) and the inferred type by column.

    Columns that ``table`` declares get the declared type, whatever was inferred, so that identifiers
    of digits keep their zeros and one bad value does not turn a column into text. Other columns keep
    the inferred type. A record is set aside if a value does not fit its column's type or the number
    of its values is not that of the header; it then has the fault ``record``. Empty values are NULL and
    no fault. A declared column that the header lacks is a ValueError."""
    guessed = spark.read.option("header", True).option("inferSchema", True).csv(path)
    inferred = dict(guessed.dtypes)
    declared = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(SCHEMAS[table])}
    lacking = [c for c in declared if c not in inferred]
    if lacking:
        raise ValueError(f"{path} lacks the columns {lacking} of {table}")
    types = {c: declared.get(c, t) for c, t in inferred.items()}
    texts = StructType([StructField(c, StringType()) for c in [*types, _RECORD]])
    raw = spark.read.schema(texts).option("header", True).option("columnNameOfCorruptRecord", _RECORD).csv(path)
    value = {c: F.col(f"`{c}`").try_cast(t) for c, t in types.items()}
    fault = [F.when(F.col(f"`{c}`").isNotNull() & value[c].isNull(), F.lit(c)) for c in types]
    broken = F.when(F.col(_RECORD).isNotNull(), F.lit("record"))
    marked = raw.withColumn("_faults", F.array_compact(F.array(broken, *fault)))
    whole = F.coalesce(_RECORD, F.concat_ws(",", *[F.coalesce(f"`{c}`", F.lit("")) for c in types]))
    sound = marked.where(F.size("_faults") == 0).select(*[v.alias(c) for c, v in value.items()])
    aside = marked.where(F.size("_faults") > 0).select(whole.alias("record"), F.col("_faults").alias("faults"))
    return sound, aside, inferred


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def load_transactions(raw: DataFrame, oldest: date, order: list[str], unique: bool = False) -> DataFrame:
    """Days parsed, older purchases left out, one row per customer, article and day. ``order``
    names the columns that decide which of several rows stays; see ``first_per_key``."""
    dated = raw.withColumn("t_dat", parse_day("t_dat")) if dict(raw.dtypes)["t_dat"] == "string" else raw
    recent = dated.where(F.col("t_dat") >= F.lit(oldest))
    keys = ["customer_id", "article_id", "t_dat"]
    return first_per_key(recent, keys, [F.col(c) for c in order], ["price", "sales_channel_id"], unique)

"""From documents to token ids in five stages. Each works on all that its predecessor kept."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.llm.bpe import encode_documents, tokenizer_json
from shelfrank.llm.decontaminate import decontaminate
from shelfrank.llm.jaccard_join import one_per_class
from shelfrank.llm.line_dedup import drop_boilerplate
from shelfrank.llm.scratch import Scratch
from shelfrank.llm.toxicity import learn, without_toxic

REMEMBERED = 60_000  # words of the tokenizer; a worker that earlier stages used holds them too

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from those with labels, rejects go."""
    return without_toxic(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many documents of a source have go; n_chars follows the text."""
    cleaned = drop_boilerplate(docs, host="source", counts=False)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_per_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their digest and that of the text decoded from them."""
    return encode_documents(docs, tokenizer_json(), with_ids=True, remembered=REMEMBERED)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe", bpe),
]

#: Scores, sampled paths and the tokenizer are beyond SQL: the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if place:
            scratch.drop(STAGES[place - 1][0])
    return docs

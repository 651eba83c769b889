"""Registered queries of this package: each takes (session, folder) and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelfrank.llm.bpe import encode_documents, tokenizer_json
from shelfrank.llm.bpe_transducer import encode_ranked, rank_file
from shelfrank.llm.chat_format import chat_digests, format_chats
from shelfrank.llm.decontaminate import find_items
from shelfrank.llm.hamming_search import sign_codes, top_k
from shelfrank.llm.jaccard_join import classify
from shelfrank.llm.line_dedup import drop_boilerplate
from shelfrank.llm.periodic_runs import periodic_runs, run_digests, with_planted_runs
from shelfrank.llm.sharding import place
from shelfrank.llm.spelling_variants import group_variants, vocabulary
from shelfrank.llm.substring_dedup import repeated_runs
from shelfrank.llm.toxicity import learn, score
from shelfrank.llm.warc import archive_pages
from shelfrank.session import tune

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

SHARDS = [f"shard-{i:02d}" for i in range(64)]
PROBE = "</s>[INST] ok [/INST]"


_REGISTRY["pipeline"] = lambda spark, folder: corpus_pipeline.run(tune(spark), folder.rstrip("/"))


def query(build: Query) -> Query:
    _REGISTRY[build.__name__] = lambda spark, folder: build(tune(spark), folder.rstrip("/"))
    return build


def registered() -> dict[str, Query]:
    return dict(_REGISTRY)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@query
def op5_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations, and one whose texts are control strings of the template."""
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text"))
        for i, role in enumerate(("user", "assistant"))
    ])).alias("row")).select("row.*")
    return chat_digests(format_chats(turns.unionByName(probe)))


@query
def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    documents = read(spark, folder, "documents").select("doc_id", "source", "text")
    return drop_boilerplate(documents, host="source")


@query
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document."""
    return place(read(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id", SHARDS)


@query
def op10_hamming_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest rows, by signs of components, of every row whose id is divisible by 20."""
    codes = sign_codes(read(spark, folder, "embeddings"), "vec_id", "embedding", bits=64)
    return top_k(codes.where(F.col("id") % 20 == 0), codes, k=10)


@query
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return archive_pages(read(spark, folder, "pages"))


@query
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded."""
    return encode_documents(read(spark, folder, "documents"), tokenizer_json())


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a model learned from the labels that are not held out."""
    documents = read(spark, folder, "documents")
    return score(documents, learn(documents, read(spark, folder, "labels")))


@query
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated passages of all documents."""
    return repeated_runs(read(spark, folder, "documents"))


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return find_items(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """The class and the number of near duplicates of every document."""
    return classify(read(spark, folder, "documents")).drop("text_hash", "class_key")


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its more frequent form."""
    return group_variants(vocabulary(read(spark, folder, "documents")))


@query
def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded by the rank file."""
    return encode_ranked(read(spark, folder, "documents"), rank_file())


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The periodic runs of every document, about every tenth of which is made to repeat itself."""
    return run_digests(periodic_runs(with_planted_runs(read(spark, folder, "documents"))))

"""A training corpus from raw documents: what is toxic or poor or said before goes, the rest is mixed and packed."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.mixing import mixed, shuffled_shards
from adtally.llm.ngram_join import similar_components
from adtally.llm.packing import pack
from adtally.llm.quality import GOOD_FROM, fit_quality, quality_score
from adtally.llm.toxicity import TOXIC_FROM, fit_chain, toxicity_scores
from adtally.session import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not take for toxic."""
    chain = fit_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity_scores(chain)["toxic"] < TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality_score(model) >= GOOD_FROM)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of similar ones, once; rows with a null id all stay."""
    names = similar_components(docs).where("_id = component_id").select("_id").distinct()
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(own.alias("own"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    kept = rows.join(names, rows["id"] == names["_id"], "left_semi").dropDuplicates(["id", "hash"])
    return kept.select("own.*").unionByName(docs.where(F.col("doc_id").isNull()))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard."""
    return shuffled_shards(mixed(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its ids."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", one_of_similar),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, components and packing have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

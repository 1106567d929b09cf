"""The queries of this package's operators, over whole tables and with production settings."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.features import id_remainder
from adtally.llm.metric_tree import tree_search
from adtally.llm.mixing import mixed
from adtally.llm.multi_index import search as multi_index_search
from adtally.llm.ngram_join import similar_components
from adtally.llm.oracle import ORACLE
from adtally.llm.packing import pack
from adtally.llm.ptolemy import clusters
from adtally.llm.quality import GOOD_FROM, fit_quality, quality_score
from adtally.llm.recurrent import document_scores
from adtally.llm.resampling import importance_resample
from adtally.llm.resharding import even_shards
from adtally.llm.token_files import encode_documents, read_token_files, token_digest, write_token_files
from adtally.llm.toxicity import TOXIC_FROM, fit_chain, toxicity_scores
from adtally.llm.warc import archive_records, read_warc, write_warc
from adtally.session import fresh_path
from corpus_pipeline import run as pipeline_run

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return multi_index_search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chain = fit_chain(docs, table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), toxicity_scores(chain).alias("scores")
    )
    return scored.select("doc_id", "held_out", "scores.*", (F.col("scores.toxic") >= TOXIC_FROM).alias("rejected"))


@query
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixed(table(spark, folder, "documents"), keep=False)
    return rows.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.size("_shards")).alias("taken"), F.col("_shards").alias("shards"),
    )


@query
def op4_recurrent(spark: SparkSession, folder: str) -> DataFrame:
    return document_scores(table(spark, folder, "documents")).withColumnRenamed("_id", "doc_id")


@query
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    write_warc(archive_records(table(spark, folder, "pages")), path)
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return read_warc(spark, path, columns, verify=True)


@query
def op6_metric_tree(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return tree_search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    rows = similar_components(table(spark, folder, "documents"))
    return rows.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id")


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_quality(docs, table(spark, folder, "labels"))
    scored = docs.select(
        "doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), quality_score(model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= GOOD_FROM).cast("int"))


@query
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    # The first sixteenth of a text's bytes, in ids about its first quarter, is given and bears no loss.
    prompt = F.floor(F.octet_length("text") / 16).alias("prompt")
    docs = table(spark, folder, "documents").select("doc_id", "text", prompt)
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), 1, loss=1792, keep_ids=False, prompt_column="prompt")
    return pieces.drop("ids")


@query
def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    write_token_files(encode_documents(table(spark, folder, "documents"), vocabulary, 0), path)
    return token_digest(read_token_files(spark, path))


@query
def op11_ptolemaic_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters(table(spark, folder, "embeddings")).drop("computed")


@query
def op12_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op13_resharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = even_shards(table(spark, folder, "documents"))
    return rows.select(
        "doc.doc_id", "size", F.crc32(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline_run(spark, folder)

"""Token ids as Parquet list columns, in ascending document order, for selective reads."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adtally.llm.encoding import kept_encoder

TOKEN_SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def encode_documents(docs: DataFrame, vocabulary: str, end_id: int, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``, in files' order: ids, their number, and where they start in their shard.

    Documents are dealt to shards by ranges of their id and sorted in them; rows with one id
    follow by a hash of their text. A null text is an empty one and a null id sorts first.
    Other columns are left out. ``end_id`` follows each text.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, done = kept_encoder(vocabulary, end_id), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, ids, counts in encoder.encode(batch.column("text")):
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(counts)),
                        pa.array(np.full(len(counts), shard, np.int32)),
                        pa.array(done + ends - counts),
                        pa.array(counts),
                        pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids.view(np.int32)),
                    ],
                    names=["doc_id", "shard", "shard_start", "n_tokens", "ids"],
                )
                done += int(ends[-1])

    return ordered.mapInArrow(encoded, TOKEN_SCHEMA)


def write_token_files(encoded: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 32 << 20,
                      page_bytes: int = 256 << 10, page_rows: int = 2_000) -> None:
    """Write rows of ``encode_documents`` as they lie.

    ``encoding`` is that of the ids: ``dictionary`` suits ids of a vocabulary, ``delta`` suits
    ids that lie close together. Document numbers and starts ascend, so they are always delta
    coded. Row groups are cut at ``row_group_bytes`` and pages at ``page_bytes`` or
    ``page_rows``; the page index lets a reader of a few documents skip the other pages.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is dictionary or delta")
    settings = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": page_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": str(encoding == "dictionary").lower(),
        "parquet.page.write-checksum.enabled": "true",
    }
    encoded.write.options(**settings).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. Select columns and filter by ``doc_id``: only their pages are read."""
    return spark.read.schema(TOKEN_SCHEMA).parquet(path)


def document_starts(files: DataFrame) -> DataFrame:
    """``shard`` and ``before``: the ids in all earlier shards. One row per file, so one window will do."""
    totals = files.groupBy("shard").agg(F.max(F.col("shard_start") + F.col("n_tokens")).alias("total"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))


def token_digest(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files alone.

    ``start`` counts the ids of all documents before it; the checksum is over little-endian
    unsigned 32-bit ids. Rows that repeat an id are documents of their own.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets, flat = lists.offsets.to_numpy(), np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("shard"), batch.column("shard_start"),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"],
            )

    sums = files.select("doc_id", "shard", "shard_start", "ids").mapInArrow(
        summed, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long"
    )
    # One row per file: bounded by the number of shuffle partitions.
    starts = F.broadcast(document_starts(files))
    return sums.join(starts, "shard").select(
        "doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32"
    )

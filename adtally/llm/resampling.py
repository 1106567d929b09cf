"""Resampling documents towards a target text by hashed n-gram importance weights."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.prefix_crc import ngram_crcs, slices
from adtally.operators.numbering import with_row_index
from adtally.session import discard, materialize

#: Text that is scanned at a time.
SLICE_BYTES = 4 << 20

RESULT = ("doc_id", "n_features", "weight", "score", "rank")


def hashed_features(rows: DataFrame, buckets: int, orders: tuple[int, ...], id_column: str | None, text_column: str) -> DataFrame:
    """``doc_id, n_words, n_features, features`` per row: the features' buckets, two bytes each, as one binary value.

    Whole texts are scanned once; what follows reads these buckets.
    """
    if buckets > 1 << 16:
        raise ValueError("a bucket is kept in two bytes")
    ids = F.col(id_column).cast("long") if id_column else F.lit(None).cast("long")
    rows = rows.select(ids.alias("doc_id"), F.col(text_column).cast("string").cast("binary").alias("text"))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column("text"), SLICE_BYTES):
                words, features, crcs = ngram_crcs(texts, orders)
                kept = (crcs % np.uint32(buckets)).astype("<u2")
                ends = np.append(0, 2 * np.cumsum(features)).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(words), pa.array(features), packed],
                    names=["doc_id", "n_words", "n_features", "features"],
                )

    return rows.mapInArrow(scanned, "doc_id long, n_words long, n_features long, features binary")


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All buckets of a batch in a row, and where each row's begin and end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
    data = column.buffers()[2]
    return (np.frombuffer(data, "<u2") if data else np.zeros(0, "<u2"))[ends[0] : ends[-1]], ends - ends[0]


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; added up in every task before anything is shuffled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            n += np.bincount(_buckets(batch.column("features"))[0], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

    parts = features.select("features").mapInArrow(counted, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket ``floor(1000 ln)`` of its smoothed share in the target over that in the source."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * float(s_all + size) / (float(s + 1) * float(t_all + size))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def importance_resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, orders: tuple[int, ...] = (1, 2),
                        percent: int = 25, least_words: int = 20, seed: int = 7, id_column: str = "doc_id",
                        text_column: str = "text", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn.

    ``weight`` is the floored mean gain of a document's n-grams (0 without any); ``score`` adds Gumbel
    noise from a hash of the id, so the ``floor(percent * N / 100)`` highest scores of the N
    documents with ``least_words`` words are a draw without replacement by weight, the same each time.

    A null text has no words, a null id is hashed as an empty one and ranks first among equal
    scores. Repeated rows are rows of their own. No documents give no rows; without a target
    all counts of it are 0. Other columns are left out.
    """
    features = materialize(hashed_features(docs, buckets, orders, id_column, text_column), "ngram-buckets")
    wanted = hashed_features(target, buckets, orders, None, target_text)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = _buckets(batch.column("features"))
            sums = np.append(0, np.cumsum(gain[found]))[ends]
            n = np.diff(ends)
            weight = np.diff(sums) // np.maximum(n, 1)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch.column("h").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight), pa.array(weight + np.array(noise, np.int64))],
                names=["doc_id", "n_words", "n_features", "weight", "score"],
            )

    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashed = features.select("doc_id", "n_words", "features", F.conv(F.substring(mark, 1, 8), 16, 10).cast("long").alias("h"))
    scored = hashed.mapInArrow(weighed, "doc_id long, n_words long, n_features long, weight long, score long")
    scored = materialize(scored.withColumn("_place", F.monotonically_increasing_id()), "resample-scores")
    discard(features)
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = percent * fit.count() // 100
    # Equal scores and ids are parted by the row's place, so no range of the sort is one key's.
    ordered = with_row_index(fit.withColumn("_down", -F.col("score")), ["_down", "doc_id", "_place"])
    ranked = ordered.withColumn("rank", F.when(F.col("idx") < drawn, F.col("idx") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*RESULT).unionByName(rest.select(*RESULT))

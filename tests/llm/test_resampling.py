"""Prefix CRCs and importance resampling against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from adtally.llm.prefix_crc import ngram_crcs, shift
from adtally.llm.registered import QUERIES
from adtally.llm.resampling import importance_resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text, orders=(1, 2)):
    words = WORD.findall((text or "").translate(SMALL))
    return words, [" ".join(words[i : i + n]) for n in orders for i in range(len(words) - n + 1)]


@given(st.lists(st.one_of(st.none(), st.text()), max_size=6), st.sampled_from([(1, 2), (2,), (1, 3, 5)]))
@settings(max_examples=150, deadline=None)
def test_ngram_crcs_are_those_of_the_ngrams(texts, orders):
    texts = [t and t.encode("utf-8", "ignore").decode() for t in texts]
    words, features, crcs = ngram_crcs(pa.array([t and t.encode() for t in texts], pa.binary()), orders)
    want = [grams(t, orders) for t in texts]
    assert words.tolist() == [len(w) for w, _ in want] and features.tolist() == [len(g) for _, g in want]
    assert crcs.tolist() == [zlib.crc32(g.encode()) for _, each in want for g in each]


def test_long_words_and_long_texts():
    texts = ["a" * 100_000 + " b", "word " * 40_000, "É" * 70]
    _, _, crcs = ngram_crcs(pa.array([t.encode() for t in texts], pa.binary()), (1, 2))
    assert crcs.tolist() == [zlib.crc32(g.encode()) for t in texts for g in grams(t)[1]]


def test_shift_adds_zero_bytes():
    crc = np.array([zlib.crc32(b"abc")] * 5, np.uint32)
    lengths = np.array([0, 1, 63, 64, 5_000])
    # zlib's own register starts inverted: what is left is the empty tail's CRC.
    want = [zlib.crc32(b"abc" + b"\0" * n) ^ zlib.crc32(b"\0" * n) for n in lengths]
    assert shift(crc, lengths).tolist() == want


def brute(docs, target, percent=25, least=20, buckets=10_000):
    found = [(n, *grams(t)) for n, t in docs]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(bucket(g) for _, _, each in found for g in each), Counter(bucket(g) for x in target for g in grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for n, words, each in found:
        weight = sum(gain[bucket(g)] for g in each) // len(each) if each else 0
        h = int(hashlib.sha256(f"7:{'' if n is None else n}".encode()).hexdigest()[:8], 16)
        rows.append((n, len(each), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0]))
    drawn = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_registered_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_resampling"](spark, small)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    assert rows_of(got) == brute(docs, target)


def test_odd_rows(spark):
    """Nulls, empty texts, copies of one document for a third of all rows, and names that clash."""
    docs = [(n, f"Wort {n} " * (n % 30)) for n in range(60)] + [(100, "the very same words " * 9)] * 30
    docs += [(None, None), (None, "x " * 25), (201, ""), (202, "-- ..."), (203, "ä" * 50_000)]
    frame = spark.createDataFrame([(n, t, "a", 1.5, 2) for n, t in docs], "doc_id long, text string, score string, rank double, h int")
    target = spark.createDataFrame([("the very words",), (None,)], "text string")
    got = importance_resample(frame.repartition(6), target)
    assert rows_of(got) == brute(docs, ["the very words"])
    ranks = sorted(r.rank for r in got.collect() if r.rank)
    assert ranks == list(range(1, len(ranks) + 1))
    assert rows_of(importance_resample(frame, target.limit(0))) == brute(docs, [])
    assert importance_resample(frame.limit(0), target).count() == 0


def test_resampling_moves_towards_the_target(spark):
    rng = np.random.default_rng(1)
    near, far = [f"near{i}" for i in range(40)], [f"far{i}" for i in range(40)]
    docs = [(n, " ".join(rng.choice(near if n % 4 == 0 else far, 40))) for n in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(rng.choice(near, 200)),)], "text string")
    drawn = [r.doc_id for r in importance_resample(frame, target).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 100 and sum(n % 4 == 0 for n in drawn) >= 50  # 25 by chance


@pytest.mark.parametrize("buckets", [1, 1 << 16])
def test_bucket_numbers(spark, buckets):
    docs = [(n, f"a{n} b{n} " * 12) for n in range(20)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance_resample(frame, frame.limit(3), buckets=buckets)
    assert rows_of(got) == brute(docs, [t for _, t in docs[:3]], buckets=buckets)

"""The n-gram join against all pairs of sets, and components against a union-find."""

import os
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from adtally.llm.components import join_components
from adtally.llm.ngram_join import Shingler, similar_components
from adtally.llm.registered import QUERIES, table
from adtally.llm.shuffles import small_batches

SCHEMA = "doc_id long, text string, n int, node int, comp int, signature string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(n, shingles(t)) for n, t in rows]
    parent = {n: n for n, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return sorted((n, len(s), find(n)) for n, s in sets)


def text_of(rng, size):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(size)]


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(8), []
    passage = text_of(rng, 60)
    for n in range(120):
        words = text_of(rng, rng.randrange(1, 150))
        out.append(words + passage if n % 3 == 0 else words)
    for base in (10, 40, 41, 70):  # near copies of several degrees, some of copies
        for edits in (1, 1, 2, 3, 4, 5, 6, 8):
            words = list(out[base])
            for _ in range(min(edits, len(words))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            out.append(words)
    texts = [" ".join(w) for w in out]
    texts += [texts[3]] * 40 + [texts[3].upper().replace(" ", "\t\n")] + ["", "  ", "a b", "A  b", "one", "ONE", "one two three four five"]
    texts += ["one two three four five six", " ".join(passage), " ".join(passage[:-1]), "long " * 30_000 + texts[5]]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("share", [0.01, 1.0])
def test_components_of_all_pairs(spark, rows, share):
    frame = spark.createDataFrame([(n, t, 0, 0, 0, "") for n, t in rows], SCHEMA).repartition(5)
    got = similar_components(frame, share=share).collect()
    assert sorted((r._id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_nulls_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten"
    data = [(5, text), (5, text), (None, text), (3, None), (3, None), (9, text.upper()), (None, None)]
    frame = spark.createDataFrame([(n, t, 0, 0, 0, "") for n, t in data], SCHEMA)
    got = sorted(map(repr, (tuple(r) for r in similar_components(frame).collect())))
    assert got == sorted(map(repr, [(5, 6, 5), (5, 6, 5), (None, 6, None), (3, 0, 3), (3, 0, 3), (9, 6, 5), (None, 0, None)]))
    assert similar_components(frame.limit(0)).count() == 0


def test_documents_of_a_table(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op7_ngram_join"](spark, small).collect())) == brute(rows)


def test_chains_and_stars_become_components(spark):
    links = [(n, n + 1) for n in range(0, 60)] + [(100, n) for n in range(101, 140)] + [(139, 30)]
    labels = spark.createDataFrame([(n, n) for n in range(160)], "node long, comp long")
    got = {r.node: r.comp for r in join_components(labels, spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[n] == (0 if n <= 60 or 100 <= n < 140 else n) for n in range(160))


def test_shingles_of_texts():
    import pyarrow as pa

    texts = ["a b c d e f", "A B  C d e F ", "a b c d", "", None, "a b c d e a b c d e a b c d e"]
    sets = [s for part in Shingler().slices(pa.array(texts), 10) for s in part]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert (sets[0] == sets[1]).all()


@pytest.mark.parametrize("name", ["op6_metric_tree", "op7_ngram_join"])
def test_queries_equal_their_sql(spark, small, name):
    from oracle_check import compare, connect

    from adtally.llm.registered import ORACLE

    assert compare(spark, QUERIES[name], ORACLE[name], small, connect(small)) is None


def test_a_slice_leaves_nothing_with_its_worker(spark):
    """Freed blocks of the heap between ones in use go back to the machine, and jobs get their texts in small batches."""
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    blocks = [np.ones(8_000) for _ in range(4_000)]
    full = resident()
    kept = blocks[::50]
    del blocks
    list(Shingler().slices(pa.array(["a b c d e f"])))
    assert full - resident() > 150 and len(kept) == 80
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    small_batches(lambda docs: seen.append(spark.conf.get(key)) or docs)(spark.range(1))
    assert int(seen[0]) <= 8 << 20 and spark.conf.get(key) == before

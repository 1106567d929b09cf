"""Quality and toxicity: learning, held-out accuracy, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from adtally.llm.features import TextFeatures, labelled_sample
from adtally.llm.quality import GOOD_FROM, fit_quality, hinge_weights, quality_score
from adtally.llm.registered import QUERIES, table
from adtally.llm.toxicity import FEATURES, TOXIC_FROM, Chain, Link, fit_chain, toxicity_scores

LARGER = "/root/testdata/sf0.01"
ODD = "doc_id long, text string, score int, label int"


def test_features_are_distinct_and_whole():
    import pyarrow as pa

    reader = TextFeatures(bits=22)
    texts = pa.array(["A b a b", "", None, " a  b\n", "x " * 50_000])
    of, found = reader.pairs(texts)
    assert len(set(zip(of.tolist(), found.tolist()))) == len(of)
    assert set(of.tolist()) == {0, 3, 4}
    one, two = found[of == 3], reader.pairs(pa.array(["a b"]))[1]
    assert set(one) == set(two)


def test_hinge_weights_part_what_can_be_parted():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    signs = np.sign(x @ [1, -2, 0.5, 0, 1] + 0.1)
    rows = [(np.arange(5), row) for row in x]
    weights = hinge_weights(rows, signs, 5, cost=100.0, rounds=300)
    assert (np.sign(x @ weights[:-1] + weights[-1]) == signs).mean() > 0.97


def test_hinge_weights_reach_the_plain_optimum():
    """The dual's coordinate steps against projected gradients over the whole dual, on classes that overlap."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    signs = np.where(x[:, 0] + rng.normal(size=60) > 0.6, 1.0, -1.0)
    costs = 0.5 / np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    z = signs[:, None] * np.column_stack([x, np.ones(60)])
    alphas, rate = np.zeros(60), 1 / np.linalg.norm(z @ z.T, 2)
    for _ in range(50_000):
        alphas = np.clip(alphas - rate * (z @ (z.T @ alphas) - 1), 0, costs)

    def loss(w):
        return w @ w / 2 + costs @ np.maximum(0, 1 - z @ w)

    best = loss(z.T @ alphas)
    assert best - (alphas.sum() - (z.T @ alphas) @ (z.T @ alphas) / 2) < 1e-6 * best  # no gap: the optimum
    weights = hinge_weights([(np.arange(4), row) for row in x], signs, 4, cost=1.0, rounds=2_000)
    assert loss(weights) < 1.001 * best


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op8_quality"](spark, LARGER).join(table(spark, LARGER, "labels"), "doc_id", "left").collect()
    assert len(rows) == table(spark, LARGER, "documents").count()
    for row in rows:
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= GOOD_FROM)
    tested = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in tested]) > 0.95
    assert np.mean([r.predicted for r in tested if r.quality == 1]) > 0.97


def test_toxicity_of_held_out_documents(spark):
    rows = QUERIES["op2_toxicity"](spark, LARGER).join(table(spark, LARGER, "labels").select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    clean = [r.rejected for r in rows if r.truth == 0]
    assert np.mean(clean) < 0.005
    # Some toxic labels are noise: nothing in those texts tells them from clean ones.
    assert np.mean([r.rejected for r in rows if r.truth == 1 and r.held_out]) > 0.5
    assert all(r.rejected == (r.toxic >= TOXIC_FROM) for r in rows)
    # The narrower category is likelier in toxic rows.
    assert np.mean([r.severe for r in rows if r.truth == 1]) > 5 * np.mean([r.severe for r in rows if r.truth == 0])


def test_toxic_documents_of_every_language_are_found(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op2_toxicity"](spark, folder).join(table(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.join(table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("truth")), "doc_id").where("held_out").collect()
    for lang in ("en", "fr", "de", "es"):
        assert np.mean([r.rejected for r in rows if r.lang == lang and r.truth == 1]) > 0.8, lang
        assert np.mean([r.rejected for r in rows if r.lang == lang and r.truth == 0]) < 0.02, lang


def test_beginnings_of_words_are_counted_once_and_twice():
    import pyarrow as pa

    reader = TextFeatures(bits=22, bigrams=False, shapes=False, bare=True, stems=(4,))
    once, twice, other = (set(reader.pairs(pa.array([t]))[1]) for t in ("Badoner!", "badoner badoxe", "xyz abc"))
    assert len(once) == 2 and len(twice) == 4 and len(other) == 2 and once < twice
    keep = np.zeros(1 << 22, bool)
    for feature in twice:
        keep[:] = False
        keep[feature] = True
        of, found = reader.pairs(pa.array(["badoner", None, "badoner badoxe", "badoner"]), keep)
        assert set(found) == {feature} and 2 in of


def test_the_last_link_decides_by_earlier_probabilities(spark):
    docs, labels = table(spark, LARGER, "documents"), table(spark, LARGER, "labels")
    chain = fit_chain(docs, labels)
    assert chain.categories == ["severe", "toxic"]
    assert [len(link.earlier) for link in chain.links] == [0, 1] and chain.links[1].earlier[0] > 0

    def toxic(used):
        scores = docs.select("doc_id", toxicity_scores(used)["toxic"].alias("p")).collect()
        return np.array([p for _, p in sorted(scores)])

    last = chain.links[1]
    cut = Chain(chain.categories, [chain.links[0], Link(last.known, last.weights, 0 * last.earlier, last.offset)])
    with_all, without = toxic(chain), toxic(cut)
    assert (np.abs(with_all - without) > 0.1).any()
    assert ((with_all >= TOXIC_FROM) != (without >= TOXIC_FROM)).any()


def test_chain_scores_are_those_of_a_plain_reading(spark, small):
    """Every score from a text's features one by one, by the links in turn."""
    import pyarrow as pa

    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    chain = fit_chain(docs, labels, degrees=("extreme", "severe"))
    assert chain.categories == ["extreme", "severe", "toxic"]
    reader = TextFeatures(**FEATURES)
    for row in docs.select("text", toxicity_scores(chain).alias("got")).limit(60).collect():
        features, odds = set(reader.pairs(pa.array([row.text], pa.string()))[1].tolist()), []
        for name, link in zip(chain.categories, chain.links):
            z = link.offset + sum(w for f, w in zip(link.known.tolist(), link.weights) if f in features)
            z += sum(w * o for w, o in zip(link.earlier, odds))
            p = 1 / (1 + np.exp(-z))
            assert abs(row.got[name] - p) < 1e-9
            odds.append(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))


def test_hinge_weights_reach_the_least_loss():
    """The dual's solution against plain steps down the primal, and no gap between the two."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    signs = np.sign(x @ [1, -1, 0.5, 2] + rng.normal(size=120))
    weights = hinge_weights([(np.arange(4), row) for row in x], signs, 4, cost=0.5, rounds=3_000)
    costs = 0.25 / np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    wide = np.column_stack([x, np.ones(120)])

    def loss(w):
        return w @ w / 2 + (costs * np.maximum(0, 1 - signs * (wide @ w))).sum()

    best, w = np.inf, np.zeros(5)
    for step in range(1, 40_001):
        open_rows = signs * (wide @ w) < 1
        w = w - (w - (wide * (costs * signs * open_rows)[:, None]).sum(axis=0)) / (step + 10)
        best = min(best, loss(w))
    assert abs(loss(weights) - best) < 2e-3 * best


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", "good words here", "BAD!! BAD!! BAD!!", "good words here", "x " * 100_000]
    return spark.createDataFrame([(n if n != 2 else None, t, 0, 1) for n, t in enumerate(texts)], ODD)


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(n, n % 2) for n in range(40)], [(1, None), (None, 1)]])
def test_odd_rows_and_few_labels(spark, odd, labels):
    rows = spark.createDataFrame(labels, "doc_id long, quality int")
    scores = odd.withColumn("q", quality_score(fit_quality(odd, rows))).collect()
    assert len(scores) == 6 and all(0 <= r.q <= 1 for r in scores)
    assert scores[2].q == scores[4].q and scores[0].q == scores[1].q
    chain = fit_chain(odd, rows.withColumnRenamed("quality", "toxic"))
    assert all(0 <= r.t.toxic <= 1 for r in odd.withColumn("t", toxicity_scores(chain)).collect())
    assert odd.limit(0).withColumn("q", quality_score(fit_quality(odd.limit(0), rows))).count() == 0


def test_held_out_rows_teach_nothing(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    outside = labels.where("crc32(cast(doc_id as string)) % 4 <> 2")
    every = labelled_sample(docs, labels, "quality", {"bits": 18}, 1_000, (4, 2))
    part = labelled_sample(docs, outside, "quality", {"bits": 18}, 1_000, (4, 2))
    assert every.rows == part.rows and (every.features == part.features).all()
    assert labelled_sample(docs, labels, "quality", {"bits": 18}, 7, (4, 2)).rows <= 7

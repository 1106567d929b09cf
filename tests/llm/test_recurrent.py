"""The recurrent model: gradients, probabilities that add up, scores against plain counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from adtally.llm import recurrent
from adtally.llm.recurrent import END, NAMES, Coder, Gru, Vocabulary, class_sizes, document_scores, packed, score_texts, unpacked
from adtally.llm.registered import table


def vocabulary(count=12):
    classes = np.concatenate([[0, 1], 2 + np.repeat(np.arange(3), [2, 4, count - 8])]).astype(int)
    return Vocabulary([f"w{n}" for n in range(count - 2)], np.arange(count, 0, -1.0), classes, 100, 40)


def test_chances_of_all_words_add_up_to_one():
    model = Gru(vocabulary(), 4, 5)
    h = np.random.default_rng(1).normal(size=(3, 5)).astype(np.float32)
    total = sum(np.exp(model.chances(h, np.full(3, w))[0]) for w in range(12))
    np.testing.assert_allclose(total, 1, rtol=1e-5)


def test_chances_of_states_of_any_size_are_numbers():
    """Small softmaxes are not shifted; those that could overflow are."""
    model = Gru(vocabulary(), 4, 5)
    h = np.random.default_rng(1).normal(size=(3, 5)).astype(np.float32)
    for much in (1, 1e4):
        logs = [model.chances(h * np.float32(much), np.full(3, w))[0] for w in range(12)]
        assert np.isfinite(logs).all()
        np.testing.assert_allclose(np.exp(logs).sum(axis=0), 1, rtol=1e-4)


def test_gradients_are_those_of_the_loss():
    model = Gru(vocabulary(), 4, 5)
    model.p = {n: p.astype(float) for n, p in model.p.items()}
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 12, (3, 6))
    inputs = np.concatenate([np.full((3, 1), END), tokens[:, :-1]], axis=1)
    real = np.ones((3, 6), bool)
    real[0, 4:] = False
    h = np.zeros((3, 5))
    g, _, _ = model.gradients(h, inputs, tokens, real)
    for name, p in model.p.items():
        flat = p.reshape(-1)
        for at in rng.integers(0, flat.size, 4):
            kept = flat[at]
            losses = []
            for step in (1e-5, -1e-5):
                flat[at] = kept + step
                losses.append(model.gradients(h, inputs, tokens, real)[2])
            flat[at] = kept
            assert g[name].reshape(-1)[at] == pytest.approx((losses[0] - losses[1]) / 2e-5, rel=1e-3, abs=1e-6), name


def test_state_is_carried_over_windows_of_any_length():
    model = unpacked(Gru(vocabulary(), 4, 5), packed(Gru(vocabulary(), 4, 5, seed=9)))
    texts = [np.append(np.random.default_rng(n).integers(1, 12, n), END) for n in (0, 1, 5, 40, 3)]
    whole = score_texts(model, texts, window=1_000, streams=1)
    np.testing.assert_allclose(score_texts(model, texts, window=3, streams=2), whole, rtol=1e-5)
    assert class_sizes(100)[0] == 8 and sum(class_sizes(100)) == 100


def test_windows_hold_every_token_of_whole_texts():
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(1, 12, n), END) for n in (0, 300, 2, 40, 7, 7, 90)]
    got, h = [], {}
    for inputs, targets, real, fresh in recurrent.windows_of(texts, 3, 8):
        for row in range(len(targets)):
            for t in np.flatnonzero(real[row]):
                if fresh[row, t]:
                    h[row] = []
                    got.append(h[row])
                assert inputs[row, t] == (h[row][-1] if h[row] else END)
                h[row].append(targets[row, t])
    assert sorted(map(list, got)) == sorted(t.tolist() for t in texts)


def test_a_fresh_state_parts_texts_in_a_stream():
    model = Gru(vocabulary(), 4, 5)
    model.p = {n: p.astype(float) for n, p in model.p.items()}
    texts = [np.append(np.random.default_rng(n).integers(1, 12, n), END) for n in (3, 6, 2)]
    total, loss = {n: 0 for n in model.p}, 0
    for text in texts:
        inputs = np.append(END, text[:-1])[None]
        g, _, own = model.gradients(np.zeros((1, 5)), inputs, text[None], np.ones((1, len(text)), bool))
        total, loss = {n: total[n] + g[n] for n in g}, loss + own
    (inputs, targets, real, fresh), = recurrent.windows_of(texts, 1, 100)
    g, _, own = model.gradients(np.zeros((1, 5)), inputs, targets, real, fresh)
    assert own == pytest.approx(loss)
    for name in g:
        np.testing.assert_allclose(g[name], total[name], atol=1e-9)


def test_the_weights_learn_from_every_training_token(spark, monkeypatch):
    fit, fitted = recurrent.fit_recurrent, []
    monkeypatch.setattr(recurrent, "fit_recurrent", lambda *own: fitted.append(fit(*own)) or fitted[-1])
    data = [(n, "a b c " * (n * n)) for n in range(60)] + [(None, "a b"), (61, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    rows = document_scores(docs).collect()
    assert fitted[0].seen == sum(r.n_tokens for r in rows if not r.held_out) == rows[0].train_tokens


def test_scores_of_a_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    words = {n: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None] for n, t in rows.items()}
    held = {n: zlib.crc32(str(n).encode()) % 10 == 0 for n in rows}
    counts = Counter(w for n, own in words.items() if not held[n] for w in own)
    total, distinct = sum(counts.values()), len(counts)
    got = document_scores(docs, listed=300, known=1_000, rounds=2).collect()
    assert len(got) == len(rows)
    for r in got:
        own = words[r._id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r._id], len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own) and r.base_score == pytest.approx(base, rel=1e-9)
        assert math.isfinite(r.score) and r.score < 0


def test_the_model_beats_the_counts_on_held_out_documents(spark):
    got = document_scores(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() + 0.02 * got.n_tokens.sum()
    assert (got.score > got.base_score).mean() > 0.6


def test_odd_rows(spark):
    schema = "doc_id long, text string, row int, word string, n int"
    data = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a unseen"), (4, "b " * 50_000), (10, " \t\n")]
    got = document_scores(spark.createDataFrame([(n, t, 0, "", 0) for n, t in data], schema), listed=5, known=5).collect()
    assert len(got) == 7 and sorted(r.n_tokens for r in got) == [1, 1, 1, 3, 3, 3, 50_001]
    twice = [r for r in got if r._id == 1]
    assert twice[0].score == pytest.approx(twice[1].score, rel=1e-6)
    assert document_scores(spark.createDataFrame([], schema)).count() == 0


def test_scores_are_the_loss_of_the_training():
    """Scoring has its own steps, with states in rows."""
    model = Gru(vocabulary(), 4, 5)
    texts = [np.append(np.random.default_rng(n).integers(1, 12, n), END) for n in (3, 60, 2, 17)]
    (inputs, targets, real, fresh), = recurrent.windows_of(texts, 2, 100)
    loss = model.gradients(np.zeros((2, 5), np.float32), inputs, targets, real, fresh)[2]
    assert -score_texts(model, texts, window=7, streams=3).sum() == pytest.approx(loss, rel=1e-5)


def test_gates_of_any_size_are_numbers():
    with np.errstate(over="ignore"):
        gates = np.array([-1e4, -3, 0, 3, 1e4], np.float32)
        recurrent._gate(gates)
    np.testing.assert_allclose(gates, [1, 1 / (1 + math.exp(-3)), 0.5, 1 / (1 + math.exp(3)), 0], rtol=1e-6)


def test_large_classes_are_worked_on_in_parts(monkeypatch):
    model, rng = Gru(vocabulary(40), 4, 5), np.random.default_rng(3)
    states, targets = rng.normal(size=(50, 5)).astype(np.float32), rng.integers(0, 40, 50)
    inputs, tokens = rng.integers(0, 40, (2, 4, 9))
    whole = model.chances(states, targets)[0], model.gradients(np.zeros((4, 5), np.float32), inputs, tokens, np.ones((4, 9), bool))
    monkeypatch.setattr(recurrent, "SOFTMAX_ENTRIES", 70)
    parts = model.chances(states, targets)[0], model.gradients(np.zeros((4, 5), np.float32), inputs, tokens, np.ones((4, 9), bool))
    np.testing.assert_allclose(parts[0], whole[0], rtol=1e-5)
    for name in NAMES:
        np.testing.assert_allclose(parts[1][0][name], whole[1][0][name], atol=1e-4)


def test_adam_takes_its_known_steps():
    p, m, v = ({"w": np.full(3, x)} for x in (1.0, 0.0, 0.0))
    want, mean, square = np.ones(3), np.zeros(3), np.zeros(3)
    for step in range(1, 6):
        g = np.array([0.3, -2.0, 40.0]) / step
        clipped = np.clip(g * 0.5, -1, 1)
        mean, square = 0.9 * mean + 0.1 * clipped, 0.99 * square + 0.01 * clipped**2
        want = want - 0.03 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        recurrent._adam(p, {"w": g}, m, v, step, 0.5, 0.03)
        np.testing.assert_allclose(p["w"], want, rtol=1e-9)


def test_numbers_without_a_dictionary_are_the_same():
    coder = Coder(vocabulary())
    texts = pa.array(["w3 W4  other", None, "", " \t\n", "w0\x1cw1 w9 \x0bw2 ", "other", "w5"], pa.string())
    for part in (texts, texts.slice(3, 2), texts.slice(0, 0)):
        got, want = coder.numbers(part), coder.code(part)[0]
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
    assert coder.numbers(texts)[0].tolist() == [5, 6, recurrent.OTHER, END]


def test_rare_words_are_joined_by_hashing(spark):
    """The setting holds while the operator runs, and is put back."""
    from adtally.llm.shuffles import hashing_parts

    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    before, seen = spark.conf.get(key), []

    @hashing_parts
    def build(docs):
        seen.append(spark.conf.get(key))
        words = docs.selectExpr("cast(id as string) as word", "id")
        joined = words.repartition(3).join(words.repartition(4), "word", "left")
        joined.collect()
        return joined

    conf = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = build(spark.range(5_000))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, value in conf.items():
            spark.conf.set(k, value)
    assert seen == ["64MB"] and spark.conf.get(key) == before
    assert "ShuffledHashJoin" in plan.split("Initial Plan")[0]

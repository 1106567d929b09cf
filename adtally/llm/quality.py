"""Quality scores by naive Bayes support vectors over n-gram indicators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.features import Sample, TextFeatures, labelled_sample

#: A document is good from this score on.
GOOD_FROM = 0.7
FEATURES = {"bits": 22, "bigrams": True, "shapes": True}


@dataclass
class QualityModel:
    """Log-count ratios of the known features, their weights times these, an offset and a calibration."""

    known: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray
    offset: float
    slope: float
    shift: float


def log_count_ratios(sample: Sample, rows: np.ndarray, least_rows: int, smoothing: float) -> tuple[np.ndarray, np.ndarray]:
    """Features in at least ``least_rows`` of ``rows`` and the log of their class shares' ratio."""
    among = np.isin(sample.row_numbers(), rows)
    label = sample.labels[sample.row_numbers()[among]]
    size = 1 << FEATURES["bits"]
    good = np.bincount(sample.features[among][label == 1], minlength=size)
    bad = np.bincount(sample.features[among][label == 0], minlength=size)
    known = np.flatnonzero(good + bad >= least_rows)
    p, q = good[known] + smoothing, bad[known] + smoothing
    return known, np.log(p / p.sum()) - np.log(q / q.sum())


def hinge_weights(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, width: int, cost: float, rounds: int,
                  seed: int = 7) -> np.ndarray:
    """Linear weights of least hinge loss, by dual coordinate descent; the last weight is the offset."""
    weights, alphas = np.zeros(width + 1), np.zeros(len(rows))
    squares = np.array([values @ values + 1.0 for _, values in rows])
    # Rows of the scarcer class cost as much together as those of the other.
    share = np.array([max(1, (signs == s).sum()) for s in signs]) / len(signs)
    costs = cost * 0.5 / share
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            places, values = rows[i]
            gradient = signs[i] * (weights[places] @ values + weights[-1]) - 1.0
            alpha = min(max(alphas[i] - gradient / squares[i], 0.0), costs[i])
            if alpha != alphas[i]:
                step = (alpha - alphas[i]) * signs[i]
                weights[places] += step * values
                weights[-1] += step
                moved = max(moved, abs(alpha - alphas[i]))
                alphas[i] = alpha
        if moved < 1e-3:
            break
    return weights


def _rows(sample: Sample, chosen: np.ndarray, known: np.ndarray, ratios: np.ndarray) -> list:
    place = np.full(1 << FEATURES["bits"], -1, np.int64)
    place[known] = np.arange(len(known))
    rows = []
    for at in chosen:
        places = place[sample.row(at)]
        places = places[places >= 0]
        values = ratios[places]
        rows.append((places, values / max(1e-9, np.sqrt(values @ values))))
    return rows


def _calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to labels, by Newton's method."""
    slope, shift = 1.0, 0.0
    # Smoothed targets keep the curve finite when the classes part cleanly.
    good, bad = (labels == 1).sum(), (labels == 0).sum()
    targets = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ (slope, shift), -30, 30)))
        h = x.T @ (x * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - targets))
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(slope, 1e-6), shift


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 6_000, least_rows: int = 3,
                smoothing: float = 1.0, cost: float = 1.0, rounds: int = 30, held_out: tuple[int, int] = (4, 2),
                id_column: str = "doc_id", text_column: str = "text") -> QualityModel:
    """Learn from at most ``rows`` labelled documents outside the held-out share.

    Indicators of n-grams are scaled by the log-count ratios of the classes, rows are brought
    to length one, and a linear hinge-loss model is fitted. Margins of five folds, each scored
    by a model of the others, set the curve that turns margins into scores. With no labels,
    or of one class, every score is that class's smoothed share.
    """
    sample = labelled_sample(docs, labels, label, FEATURES, rows, held_out, id_column, text_column)
    every = np.arange(sample.rows)
    classes = np.bincount(sample.labels, minlength=2)
    if classes.min() < 2:
        nothing = np.zeros(0)
        return QualityModel(nothing.astype(np.int64), nothing, nothing, 0.0, 1.0, float(np.log((classes[1] + 1) / (classes[0] + 1))))

    def fitted(chosen: np.ndarray):
        known, ratios = log_count_ratios(sample, chosen, least_rows, smoothing)
        signs = 2.0 * sample.labels[chosen] - 1.0
        return known, ratios, hinge_weights(_rows(sample, chosen, known, ratios), signs, len(known), cost, rounds)

    margins = np.zeros(sample.rows)
    for fold in range(5):
        own, rest = every[sample.folds == fold], every[sample.folds != fold]
        if not len(own) or np.bincount(sample.labels[rest], minlength=2).min() < 1:
            continue
        known, ratios, weights = fitted(rest)
        margins[own] = [weights[p] @ v + weights[-1] for p, v in _rows(sample, own, known, ratios)]
    known, ratios, weights = fitted(every)
    return QualityModel(known, ratios, weights[:-1] * ratios, float(weights[-1]), *_calibrate(margins, sample.labels))


def quality_score(model: QualityModel, text_column: str = "text") -> Column:
    """The probability of the good class for each whole text; a null text is an empty one."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, size = TextFeatures(**FEATURES), 1 << FEATURES["bits"]
        # A feature's place among the known ones.
        keep, place = np.zeros(size, bool), np.zeros(size, np.int32)
        keep[model.known], place[model.known] = True, np.arange(len(model.known), dtype=np.int32)
        squares = model.ratios**2
        for texts in batches:
            margins = [np.zeros(0)]
            for part in reader.slices(texts):
                of, found = reader.pairs(part, keep)
                at = place[found]
                total = np.bincount(of, model.weights[at], len(part))
                margins.append(total / np.sqrt(np.maximum(np.bincount(of, squares[at], len(part)), 1e-18)))
            curve = model.slope * (np.concatenate(margins) + model.offset) + model.shift
            yield pa.array(1 / (1 + np.exp(-np.clip(curve, -500, 500))))

    return F.arrow_udf(scored, "double")(F.col(text_column).cast("string"))

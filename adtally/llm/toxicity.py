"""Toxicity categories by a chain of linear classifiers.

Narrower categories come first. The one that decides comes last and sees what the others make of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.features import Sample, TextFeatures, labelled_sample

#: A document goes from this probability of being toxic on.
TOXIC_FROM = 0.8
#: Beginnings of words beside whole ones: where endings vary, no single word is frequent.
FEATURES = {"bits": 22, "bigrams": False, "shapes": False, "bare": True, "stems": (4, 5, 6, 7)}
FOLDS = 5


@dataclass
class Link:
    """One category's linear model: weights of known words and beginnings, of the earlier links' log odds, an offset."""

    known: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    offset: float


@dataclass
class Chain:
    categories: list[str]
    links: list[Link]


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def telling_words(sample: Sample, labels: np.ndarray, rows: np.ndarray, least_surety: float, most: int) -> np.ndarray:
    """The at most ``most`` words or beginnings that tell the classes apart by a likelihood ratio.

    Labels are noisy and most words rare: a word seen in a few rows of one class only by
    chance has a small ratio, however lopsided its share. The ratio asked for is
    ``least_surety``, and less when few rows are marked: a word can be in no more than these,
    and what is there by chance is left to the penalty.
    """
    least_surety = min(least_surety, 7 + (labels[rows] == 1).sum() / 50)
    size = 1 << FEATURES["bits"]
    inside, outside = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for row in rows:
        # A row has a feature once.
        (inside if labels[row] == 1 else outside)[sample.row(row)] += 1
    known = np.flatnonzero(inside + outside)
    n, m = max(1, (labels[rows] == 1).sum()), max(1, (labels[rows] == 0).sum())
    surety = np.zeros(len(known))
    for at in range(0, len(known), 1 << 16):
        part = slice(at, at + (1 << 16))
        i, o = inside[known[part]].astype(float), outside[known[part]].astype(float)
        counts, share = np.stack([i, n - i, o, m - o]), (i + o) / (n + m)
        expected = np.stack([n * share, n * (1 - share), m * share, m * (1 - share)])
        surety[part] = 2 * (counts * np.log(np.maximum(counts, 1e-12) / np.maximum(expected, 1e-12))).sum(axis=0)
    best = known[np.lexsort((known, -surety))][: min(most, int((surety >= least_surety).sum()))]
    return np.sort(best)


@dataclass
class Entries:
    """What is not 0 of a matrix: most words are in few rows."""

    rows: np.ndarray
    places: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    @classmethod
    def of(cls, sample: Sample, chosen: np.ndarray, known: np.ndarray, earlier: np.ndarray) -> Entries:
        """Known words' presence in the chosen rows, and the earlier links' columns beside it."""
        place = np.full(1 << FEATURES["bits"], -1, np.int32)
        place[known] = np.arange(len(known), dtype=np.int32)
        each = [np.sort(found[found >= 0]) for found in (place[sample.row(row)] for row in chosen)]
        width, depth = len(known), earlier.shape[1]
        rows = np.repeat(np.arange(len(chosen)), [len(x) for x in each])
        words = np.concatenate([*each, np.zeros(0, np.int32)]).astype(np.int64)
        beside = np.repeat(np.arange(len(chosen)), depth)
        return cls(
            np.concatenate([rows, beside]), np.concatenate([words, np.tile(np.arange(width, width + depth), len(chosen))]),
            np.concatenate([np.ones(len(words)), earlier[chosen].ravel() / 10]), (len(chosen), width + depth),
        )

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * v[self.places], self.shape[0])

    def turned(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.places, self.values * u[self.rows], self.shape[1])


def _fit_link(x: Entries, labels: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of least penalised logistic loss, by accelerated gradient steps; classes weigh alike."""
    n, width = x.shape
    share = np.where(labels == 1, (labels == 1).mean(), (labels == 0).mean())
    each = 0.5 / share / n
    # The greatest curvature, from a few rounds of the power method.
    v = np.ones(width + 1)
    top = 1.0
    for _ in range(20):
        xv = x.times(v[:-1]) + v[-1]
        u = np.append(x.turned(each * xv), (each * xv).sum()) / 4
        top = np.linalg.norm(u) / max(np.linalg.norm(v), 1e-12)
        v = u / max(np.linalg.norm(u), 1e-12)
    rate = 1 / (1.1 * top + penalty)
    w, last = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(steps):
        ahead = w + t / (t + 3) * (w - last)
        error = each * (_logistic(x.times(ahead[:-1]) + ahead[-1]) - labels)
        gradient = np.append(x.turned(error) + penalty * ahead[:-1], error.sum())
        w, last = ahead - rate * gradient, w
    return w[:-1], float(w[-1])


def _marker_hits(sample: Sample, known: list[np.ndarray], places: list[np.ndarray]) -> np.ndarray:
    """How many marker words each row has: words four times as frequent in the category as outside it.

    A row's markers are those of the other folds' rows, so none is a marker because of the row itself.
    """
    hits, every = np.zeros(sample.rows), np.arange(sample.rows)
    for fold, words in enumerate(known):
        rest = Entries.of(sample, every[sample.folds != fold], words, np.zeros((sample.rows, 0)))
        kinds = sample.labels[sample.folds != fold]
        inside, outside = (
            np.bincount(rest.places[kinds[rest.rows] == kind], minlength=len(words)) / max(1, (kinds == kind).sum())
            for kind in (1, 0)
        )
        found = Entries.of(sample, places[fold], words[inside > 4 * outside], np.zeros((sample.rows, 0)))
        hits[places[fold]] = np.bincount(found.rows, minlength=len(places[fold]))
    return hits


def fit_chain(docs: DataFrame, labels: DataFrame, label: str = "toxic", degrees: tuple[str, ...] = ("severe",),
              rows: int = 6_000, words: int = 1_024, least_surety: float = 12.0, penalty: float = 1e-4, steps: int = 300,
              held_out: tuple[int, int] = (4, 2), id_column: str = "doc_id", text_column: str = "text") -> Chain:
    """Learn each of ``degrees``, narrowest first, and ``label`` last, from at most ``rows`` labelled documents.

    The label table only tells toxic from clean, so the degrees are shares of the toxic rows by
    their number of marker words: of one degree, the half above the median. A link sees the
    presence of the ``words`` most telling words and beginnings of words and, for every
    earlier category, the log odds given to the row by models of the *other* folds, so it
    learns from probabilities as inexact as those it will meet. With no labels, or of one
    class, the probability is the class's smoothed share.
    """
    sample = labelled_sample(docs, labels, label, FEATURES, rows, held_out, id_column, text_column)
    every, folds = np.arange(sample.rows), sample.folds
    places = [every[folds == fold] for fold in range(FOLDS)]
    hits = np.zeros(sample.rows)
    if np.bincount(sample.labels, minlength=2).min() >= FOLDS:
        known = [telling_words(sample, sample.labels, every[folds != fold], least_surety, words) for fold in range(FOLDS)]
        hits = _marker_hits(sample, known, places)
    earlier, links = np.zeros((sample.rows, 0)), []
    for depth in range(1 + len(degrees)):
        target = sample.labels
        if depth < len(degrees) and target.any():
            least = np.quantile(hits[target == 1], 1 - (depth + 1) / (1 + len(degrees)))
            target = ((target == 1) & (hits > least)).astype(np.int64)
        if np.bincount(target, minlength=2).min() < FOLDS:
            share = (target.sum() + 1) / (len(target) + 2)
            links.append(Link(np.zeros(0, np.int64), np.zeros(0), np.zeros(depth), float(_log_odds(share))))
            earlier = np.column_stack([earlier, np.full(sample.rows, _log_odds(share))])
            continue

        def fitted(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            known = telling_words(sample, target, chosen, least_surety, words)
            return known, *_fit_link(Entries.of(sample, chosen, known, earlier), target[chosen], penalty, steps)

        outside = np.zeros(sample.rows)
        # No link comes after the last, so nothing asks what it makes of other folds.
        for own in places if depth < len(degrees) else []:
            rest = np.setdiff1d(every, own)
            if len(own) and np.bincount(target[rest], minlength=2).min():
                known, weights, offset = fitted(rest)
                outside[own] = _log_odds(_logistic(Entries.of(sample, own, known, earlier).times(weights) + offset))
        known, weights, offset = fitted(every)
        links.append(Link(known, weights[: len(known)], weights[len(known) :] / 10, offset))
        earlier = np.column_stack([earlier, outside])
    return Chain([*degrees, label], links)


def toxicity_scores(chain: Chain, text_column: str = "text") -> Column:
    """A struct with one probability per category, in the chain's order; a null text is an empty one."""

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader, size = TextFeatures(**FEATURES), 1 << FEATURES["bits"]
        known = np.unique(np.concatenate([link.known for link in chain.links]))
        # A feature's place among the known ones, and the links' weights there.
        keep, place = np.zeros(size, bool), np.zeros(size, np.int32)
        keep[known], place[known] = True, np.arange(len(known), dtype=np.int32)
        weights = np.zeros((len(chain.links), len(known)))
        for own, link in zip(weights, chain.links):
            own[place[link.known]] = link.weights
        for texts in batches:
            columns: list[list[np.ndarray]] = [[np.zeros(0)] for _ in chain.links]
            for part in reader.slices(texts):
                of, found = reader.pairs(part, keep)
                earlier = np.zeros((len(part), 0))
                for at, link in enumerate(chain.links):
                    z = np.bincount(of, weights[at][place[found]], len(part)) + link.offset + earlier @ link.earlier
                    columns[at].append(_logistic(z))
                    earlier = np.column_stack([earlier, _log_odds(columns[at][-1])])
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=chain.categories)

    kind = "struct<" + ", ".join(f"{name}: double" for name in chain.categories) + ">"
    return F.arrow_udf(scored, kind)(F.col(text_column).cast("string"))

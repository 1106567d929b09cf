"""Log-likelihoods of whole documents under a gated recurrent language model with a class-factored softmax."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.features import id_remainder
from adtally.llm.prefix_crc import slices
from adtally.llm.shuffles import dropping_shuffles, hashing_parts
from adtally.session import materialize

#: Place of the end mark and of all words outside the model's list.
END, OTHER = 0, 1
#: Text that is coded at a time: whole texts, however many or long.
SLICE_BYTES = 8 << 20
#: Exponentials of as much, and sums of very many of them, are numbers of single precision, as are their inverses.
SAFE = 60.0
#: Entries of a class's softmaxes that are worked on at a time: they stay near the processor.
SOFTMAX_ENTRIES = 1 << 16
NAMES = ("embed", "w", "b", "u", "uh", "vc", "ac", "vw", "aw")


@dataclass
class Vocabulary:
    """The model's words by falling count, each in a class of a square root's size; counts of all the corpus."""

    words: list[str]
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    distinct: int

    @property
    def members(self) -> list[slice]:
        """Each class's words, which stand side by side."""
        edges = np.searchsorted(self.classes, np.arange(self.classes.max() + 2)).tolist()
        return [slice(a, b) for a, b in zip(edges, edges[1:])]


def class_sizes(count: int, first: int = 8, growth: float = 1.25) -> list[int]:
    """Sizes of classes over words by falling count: frequent classes are small, so they cost little."""
    sizes, size = [], float(first)
    while sum(sizes) < count:
        sizes.append(min(int(size), count - sum(sizes)))
        size *= growth
    return sizes


def build_vocabulary(counted: DataFrame, most: int) -> Vocabulary:
    """From ``word, n`` of all training tokens; the end mark is the null word."""
    facts = counted.agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct")).first()
    top = counted.where(F.col("word").isNotNull()).orderBy(F.desc("n"), "word").limit(most).collect()
    end = counted.where(F.col("word").isNull()).agg(F.sum("n")).first()[0] or 0
    tokens = facts["tokens"] or 0
    counts = np.array([end, tokens - end - sum(r["n"] for r in top), *[r["n"] for r in top]], float)
    # The end mark and the words outside the list have a class each.
    classes = np.concatenate([[0, 1], 2 + np.repeat(np.arange(len(s := class_sizes(len(top)))), s)]).astype(int)
    return Vocabulary([r["word"] for r in top], counts, classes, tokens, facts["distinct"])


class Gru:
    """Forward and backward steps in numpy, over many streams at once."""

    def __init__(self, vocabulary: Vocabulary, embed: int, hidden: int, seed: int = 5) -> None:
        self.v, self.hidden = vocabulary, hidden
        #: Tokens the weights were trained on.
        self.seen = 0
        self.members = vocabulary.members
        # Few bytes a number: sorted by counting.
        self.kinds = vocabulary.classes.astype(np.min_scalar_type(len(self.members)))
        self.place = np.arange(len(vocabulary.classes)) - np.array([own.start for own in self.members])[vocabulary.classes]
        r = np.random.default_rng(seed)
        count, classes = len(vocabulary.classes), len(self.members)
        smooth = vocabulary.counts + 0.5
        by_class = np.array([smooth[m].sum() for m in self.members])
        shapes = {"embed": (count, embed), "vc": (hidden, classes), "vw": (count, hidden)}
        # Update gate, reset gate and candidate side by side.
        shapes |= {"w": (embed, 3 * hidden), "u": (hidden, 2 * hidden), "uh": (hidden, hidden)}
        self.p = {n: (r.normal(0, 0.3 if n == "embed" else 0.5 / math.sqrt(s[0]) if n[0] in "wu" else 0.02, s)).astype(np.float32) for n, s in shapes.items()}
        self.p["b"] = np.zeros(3 * hidden, np.float32)
        # Without a state the output is the corpus's own distribution.
        self.p["ac"] = np.log(by_class / by_class.sum()).astype(np.float32)
        self.p["aw"] = np.log(smooth / by_class[vocabulary.classes]).astype(np.float32)

    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the gates and of the candidate, for columns of an input, a one and a state.

        Those of the gates are negative, as a gate is one over one more than the exponential of its negative argument.
        """
        p, n = self.p, 2 * self.hidden
        gates, choice = np.concatenate([p["w"], p["b"][None]]), np.concatenate([p["u"], p["uh"]], axis=1)
        both = np.concatenate([gates, choice]).T
        return -both[:n], both[n:].copy()

    def outputs(self) -> tuple[np.ndarray, ...]:
        """Weights of classes and of words with their constants, and how far a state of ones could take each word."""
        outer = np.append(self.p["vc"], self.p["ac"][None], axis=0).T
        words = np.append(self.p["vw"], self.p["aw"][:, None], axis=1)
        return outer, words, np.abs(words).sum(axis=1)

    def by_class(self, states: np.ndarray, targets: np.ndarray):
        """Tokens in the order of their classes, so each class's are a slice: the order, the tokens, their classes, their states."""
        order = np.argsort(self.kinds[targets], kind="stable")
        wanted = targets[order]
        # A last column of ones takes up what does not depend on the state.
        sorted_states = np.empty((len(order), self.hidden + 1), states.dtype)
        sorted_states[:, :-1], sorted_states[:, -1] = np.take(states, order, axis=0), 1
        return order, wanted, self.v.classes[wanted], sorted_states

    def word_chances(self, sorted_states: np.ndarray, wanted: np.ndarray, kinds: np.ndarray, outputs: tuple, most: float):
        """Of some tokens of a class at a time: which, the class's words, and their softmaxes as ``_log_picked`` has them.

        Softmaxes have the tokens side by side, and are left undivided, with their sums.
        """
        _, words, reach = outputs
        edges = np.searchsorted(kinds, np.arange(len(self.members) + 1)).tolist()
        places = self.place[wanted]
        for first, last, own in zip(edges, edges[1:], self.members):
            if own.stop - own.start > 1:
                shift, step = most * reach[own].max() > SAFE, max(1, SOFTMAX_ENTRIES // (own.stop - own.start))
                for start in range(first, last, step):
                    rows = slice(start, min(start + step, last))
                    b = words[own] @ sorted_states[rows].T
                    yield rows, own, b, places[rows], *_log_picked(b, places[rows], shift)

    def chances(self, states: np.ndarray, targets: np.ndarray, outputs: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probabilities of targets; in the order of their classes, and which target is where."""
        outputs = outputs or self.outputs()
        order, wanted, kinds, sorted_states = self.by_class(states, targets)
        most, outer = max(1.0, float(np.abs(states).max(initial=0))), outputs[0]
        found = _log_picked(outer @ sorted_states.T, kinds, most * np.abs(outer).sum(axis=1).max() > SAFE)[0].astype(float)
        for rows, _, _, _, part, _ in self.word_chances(sorted_states, wanted, kinds, outputs, most):
            found[rows] += part
        log = np.empty(len(targets))
        log[order] = found
        return log, order

    def gradients(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray, fresh: np.ndarray | None = None):
        """Gradients of the summed loss over a window (streams by steps), and the state after it.

        Before steps marked ``fresh`` the state is zero again: a text starts.
        """
        p, steps, n, g = self.p, inputs.shape[1], self.hidden, {}
        to_gates, to_choice = self.turned()
        fixed = p["embed"].shape[1] + 1
        # What each step's gates and candidate are made of: inputs, ones, and the state before or what is kept of it.
        heard, kept = np.empty((2, steps, fixed + n, len(h)), h.dtype)
        heard[:, : fixed - 1], heard[:, fixed - 1] = p["embed"][inputs.T].transpose(0, 2, 1), 1
        kept[:, :fixed] = heard[:, :fixed]
        some = ~real.all(axis=0)
        starts = np.zeros(steps, bool) if fresh is None else fresh.any(axis=0)
        gates = np.empty((steps, 2 * n, len(h)), h.dtype)
        choices, gaps, afters = np.empty((3, steps, n, len(h)), h.dtype)
        befores, resets = heard[:, fixed:], kept[:, fixed:]
        state = h.T
        with np.errstate(over="ignore"):
            for t in range(steps):
                before, after, gap = befores[t], afters[t], gaps[t]
                before[...] = state
                if starts[t]:
                    before[:, fresh[:, t]] = 0
                np.dot(to_gates, heard[t], out=gates[t])
                _gate(gates[t])
                np.multiply(gates[t, n:], before, out=resets[t])
                np.dot(to_choice, kept[t], out=choices[t])
                np.tanh(choices[t], out=choices[t])
                np.subtract(choices[t], before, out=gap)
                np.multiply(gates[t, :n], gap, out=after)
                after += before
                state = np.where(real[:, t], after, before) if some[t] else after
        states, mask = afters.transpose(0, 2, 1).reshape(-1, n), real.T.ravel()
        outputs = self.outputs()
        order, wanted, kinds, sorted_states = self.by_class(states, targets.T.ravel())
        weight = mask[order].astype(h.dtype)
        most = max(1.0, float(np.abs(states).max(initial=0)))
        a = outputs[0] @ sorted_states.T
        part, sums = _log_picked(a, kinds, most * np.abs(outputs[0]).sum(axis=1).max() > SAFE)
        loss = -float(part @ weight)
        # Softmaxes become what the loss falls by in each of their arguments.
        a *= weight / sums
        a[kinds, np.arange(len(kinds))] -= weight
        outer = a @ sorted_states
        g["vc"], g["ac"] = np.ascontiguousarray(outer[:, :-1].T), outer[:, -1].copy()
        dsorted = a.T @ p["vc"].T
        words = np.zeros((len(p["vw"]), n + 1), h.dtype)
        for rows, own, b, places, part, sums in self.word_chances(sorted_states, wanted, kinds, outputs, most):
            loss -= float(part @ weight[rows])
            b *= weight[rows] / sums
            b[places, np.arange(len(places))] -= weight[rows]
            words[own] += b @ sorted_states[rows]
            dsorted[rows] += b.T @ p["vw"][own]
        g["vw"], g["aw"] = words[:, :-1].copy(), words[:, -1].copy()
        dstates = np.empty_like(dsorted)
        dstates[order] = dsorted
        dstates = np.ascontiguousarray(dstates.reshape(steps, len(h), n).transpose(0, 2, 1))
        carried = np.zeros((n, len(h)), h.dtype)
        deltas = np.empty((steps, 3 * n, len(h)), h.dtype)
        # What each step's slopes are but for the loss's own.
        slopes, rest = 1 - gates, choices
        left = slopes[:, :n].copy()
        slopes *= gates
        slopes[:, :n] *= gaps
        slopes[:, n:] *= befores
        rest *= rest
        np.subtract(1, rest, out=rest)
        rest *= gates[:, :n]
        x, through, back = np.empty((3, n, len(h)), h.dtype)
        for t in range(steps - 1, -1, -1):
            d, delta = dstates[t], deltas[t]
            d += carried
            if some[t]:
                d *= real[:, t]
            chosen = delta[2 * n :]
            np.multiply(rest[t], d, out=chosen)
            np.dot(p["uh"], chosen, out=through)
            np.multiply(slopes[t, :n], d, out=delta[:n])
            np.multiply(slopes[t, n:], through, out=delta[n : 2 * n])
            np.multiply(d, left[t], out=back)
            through *= gates[t, n:]
            back += through
            np.dot(p["u"], delta[: 2 * n], out=x)
            back += x
            if some[t]:
                back = np.where(real[:, t], back, carried)
            carried, back = back, carried
            if starts[t]:
                carried[:, fresh[:, t]] = 0
        # Sums over all steps at once.
        by_gates = (deltas[:, : 2 * n] @ heard.transpose(0, 2, 1)).sum(axis=0).T
        by_choice = (deltas[:, 2 * n :] @ kept.transpose(0, 2, 1)).sum(axis=0).T
        both = np.concatenate([by_gates[:fixed], by_choice[:fixed]], axis=1)
        g["w"], g["b"] = both[:-1], both[-1]
        g["u"], g["uh"] = np.ascontiguousarray(by_gates[fixed:]), np.ascontiguousarray(by_choice[fixed:])
        words, moved = inputs.T.ravel(), p["w"] @ deltas
        sums = [np.bincount(words, moved[:, k].ravel(), len(p["embed"])) for k in range(fixed - 1)]
        g["embed"] = np.stack(sums, axis=1).astype(h.dtype)
        return g, state.T, loss


def _gate(a: np.ndarray) -> None:
    """One over one more than the exponentials, in their arguments' place; exponentials out of range leave 0."""
    np.exp(a, out=a)
    a += 1
    np.reciprocal(a, out=a)


def _log_picked(a: np.ndarray, picked: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray]:
    """Logarithms of one softmax entry a column, and the sums; ``a`` becomes the softmaxes, undivided.

    ``shift`` if exponentials could leave the range of numbers.
    """
    if shift:
        a -= a.max(axis=0)
    log = np.take(a, picked * a.shape[1] + np.arange(a.shape[1]))
    np.exp(a, out=a)
    sums = np.ones(len(a), a.dtype) @ a
    return log - np.log(sums), sums


def windows_of(texts: list[np.ndarray], streams: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Inputs, targets, which of them are real, where texts start, and how many streams still run, window by window.

    Each text stands whole in one stream, from its first word to its end; streams are of like
    length, and the longest come first, so those that are at their end are the last.
    """
    order = np.random.default_rng(11)
    loads, own = [(0, n) for n in range(streams)], [[] for _ in range(streams)]
    for at in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        load, n = heapq.heappop(loads)
        own[n].append(at)
        heapq.heappush(loads, (load + len(texts[at]), n))
    rows = []
    for mine in sorted((o for o in own if o), key=lambda o: -sum(len(texts[i]) for i in o)):
        mine = [texts[i] for i in order.permutation(mine)]
        starts = np.zeros(sum(map(len, mine)), bool)
        starts[np.cumsum([0, *map(len, mine[:-1])])] = True
        rows.append((np.concatenate(mine), starts))
    sizes = np.array([len(row) for row, _ in rows], int)
    for start in range(0, int(sizes.max(initial=0)), length):
        live = int((sizes > start).sum())
        steps = min(length, int(sizes[0]) - start)
        inputs, targets = np.full((live, steps), END), np.full((live, steps), END)
        real, fresh = np.zeros((live, steps), bool), np.zeros((live, steps), bool)
        for n, (row, starts) in enumerate(rows[:live]):
            part = row[start : start + steps]
            targets[n, : len(part)], real[n, : len(part)] = part, True
            fresh[n, : len(part)] = starts[start : start + steps]
            # What stands before a text is the end of another, or nothing.
            before = row[max(0, start - 1) : start + len(part) - 1]
            inputs[n, len(part) - len(before) : len(part)] = before
        yield inputs, targets, real, fresh


def train_texts(model: Gru, texts: Iterator[np.ndarray], length: int, streams: int, rate: float, steps: int = 128) -> int:
    """Adam steps over every token of whole texts, and their number.

    The state goes on from window to window, the backward pass ends within one. Some texts at a
    time are held, at most ``streams`` windows wide and about ``steps`` long; of few texts the
    steps are narrower instead of fewer.
    """
    m, v, step = {n: np.zeros_like(x) for n, x in model.p.items()}, {n: np.zeros_like(x) for n, x in model.p.items()}, 0
    held, size, total = [], 0, 0

    def learn() -> None:
        nonlocal step
        wide = max(8, min(streams, size // (length * steps)))
        h = np.zeros((wide, model.hidden), np.float32)
        for inputs, targets, real, fresh in windows_of(held, wide, length):
            # Backward within the window only; forward the state goes on.
            g, h, _ = model.gradients(h[: len(inputs)], inputs, targets, real, fresh)
            seen, step = int(real.sum()), step + 1
            # Windows at the end of long texts hold few streams, and move the weights less.
            own = rate * math.sqrt(min(1.0, seen / (wide * length)))
            _adam(model.p, g, m, v, step, 32 / seen, own)

    for text in texts:
        held.append(text)
        size += len(text)
        total += len(text)
        if size >= streams * length * steps:
            learn()
            held, size = [], 0
    if held:
        learn()
    return total


def _adam(p: dict, g: dict, m: dict, v: dict, step: int, scale: float, rate: float) -> None:
    """Adam's step number ``step`` by gradients that are scaled and clipped; it is made in their place."""
    # The corrections for early steps stand with the rate and with the least divisor.
    late = math.sqrt(1 - 0.99**step)
    rate, least = rate * late / (1 - 0.9**step), 1e-6 * late
    for n, d in g.items():
        d *= scale
        np.clip(d, -1, 1, out=d)
        d *= 0.1
        m[n] *= 0.9
        m[n] += d
        # A hundredth of the gradient's square.
        d *= d
        v[n] *= 0.99
        v[n] += d
        np.sqrt(v[n], out=d)
        d += least
        np.divide(m[n], d, out=d)
        d *= rate
        p[n] -= d


def packed(model: Gru) -> bytes:
    return b"".join(model.p[n].astype("<f4").tobytes() for n in NAMES)


def unpacked(model: Gru, raw: bytes) -> Gru:
    at = 0
    for n in NAMES:
        size = model.p[n].size * 4
        model.p[n] = np.frombuffer(raw[at : at + size], "<f4").reshape(model.p[n].shape).copy()
        at += size
    return model


def places_in(words: pa.Array, table: pa.Array) -> np.ndarray:
    """Where each word stands in the table; the table's length for those that it lacks."""
    return pc.fill_null(pc.index_in(words, value_set=table), len(table)).to_numpy().astype(np.int64)


class Coder:
    """Texts to numbers of the model's words, with the corpus counts of each word for what the model leaves out."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = pa.array(vocabulary.words, pa.string())

    def numbers(self, texts: pa.Array) -> list[np.ndarray]:
        """Numbers of each text with its end, where nothing else of its words is wanted."""
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        words = cut.flatten()
        numbers = places_in(words, self.words).astype(np.int32) + 2
        numbers[numbers == len(self.words) + 2] = OTHER
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
        if empty.any():
            numbers, offsets = numbers[~empty], np.append(0, np.cumsum(~empty))[offsets]
        end = np.array([END], np.int32)
        return [np.concatenate([numbers[a:b], end]) for a, b in zip(offsets, offsets[1:])]

    def code(self, texts: pa.Array) -> tuple[list[np.ndarray], pa.Array, np.ndarray, np.ndarray]:
        """Numbers of each text with its end, and all words, their codes and the text each is of."""
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
        coded = cut.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy()
        texts_of = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
        real = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)
        if len(codes) and not real.all():
            texts_of, codes = texts_of[real[codes]], codes[real[codes]]
        numbers = places_in(distinct, self.words) + 2
        numbers[numbers == len(self.words) + 2] = OTHER
        counts = np.bincount(texts_of, minlength=len(cut)) if len(codes) else np.zeros(len(cut), int)
        ends = np.cumsum(counts)
        flat = numbers[codes] if len(codes) else np.zeros(0, np.int64)
        return [np.append(flat[b - n : b], END) for n, b in zip(counts, ends)], distinct, codes, texts_of


def score_texts(model: Gru, texts: list[np.ndarray], window: int = 64, streams: int = 512) -> np.ndarray:
    """Natural log-probability of each text's listed words and class choices, from its first word to its end.

    Texts of like length run side by side; what a text has read stays in its state from one
    window to the next, so a text of any length is scored whole.
    """
    totals, n = np.zeros(len(texts)), model.hidden
    # Every word's share of the next step, once for all texts; that of the gates is negative.
    added = model.p["embed"] @ model.p["w"] + model.p["b"]
    to_gates, to_choice = -added[:, : 2 * n], added[:, 2 * n :].copy()
    u, uh, outputs = -model.p["u"], model.p["uh"], model.outputs()
    order = np.array(sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)), int)
    lengths = np.array([len(texts[i]) for i in order], int)
    for first in range(0, len(order), streams):
        group, sizes = order[first : first + streams], lengths[first : first + streams]
        h = np.zeros((len(group), n), np.float32)
        last = np.full(len(group), END)
        gates, choice, reset = np.empty((len(group), 2 * n), np.float32), *np.empty((2, len(group), n), np.float32)
        for start in range(0, int(sizes[0]) if len(sizes) else 0, window):
            stop = min(start + window, int(sizes[0]))
            # How many texts are left at each step.
            lives = np.searchsorted(-sizes, -np.arange(start, stop), "left").tolist()
            tokens = np.full((stop - start, lives[0]), END)
            for row in range(lives[0]):
                own = texts[group[row]][start:stop]
                tokens[: len(own), row] = own
            states = np.empty((sum(lives), n), np.float32)
            at = 0
            for t, live in enumerate(lives):
                # States in rows, where the softmaxes read them.
                h, z, c = h[:live], gates[:live], choice[:live]
                np.dot(h, u, out=z)
                z += np.take(to_gates, last[:live], axis=0)
                with np.errstate(over="ignore"):
                    _gate(z)
                np.multiply(z[:, n:], h, out=reset[:live])
                np.dot(reset[:live], uh, out=c)
                c += np.take(to_choice, last[:live], axis=0)
                np.tanh(c, out=c)
                c -= h
                c *= z[:, :n]
                h = np.add(h, c, out=states[at : at + live])
                last = tokens[t, :live]
                at += live
            rows = np.concatenate([np.arange(live) for live in lives])
            log = model.chances(states, np.concatenate([tokens[t, :live] for t, live in enumerate(lives)]), outputs)[0]
            totals[group[: lives[0]]] += np.bincount(rows, log, lives[0])
    return totals


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a part's weights, averaged by the tokens they come from."""
    n, total = 0, 0.0
    for batch in batches:
        for k, w in zip(batch.column("n").to_pylist(), batch.column("weights")):
            n, total = n + k, total + np.frombuffer(w.as_buffer(), "<f4").astype(float) * k
    if n:
        weights = (total / n).astype("<f4").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([weights], pa.binary())], names=["n", "weights"])


def fit_recurrent(training: DataFrame, vocabulary: Vocabulary, embed: int, hidden: int, window: int, streams: int,
                  rate: float, rounds: int, steps: int = 128, fall: float = 0.5) -> Gru:
    """Train on every training text whole, once, in rounds of parallel workers whose weights are averaged.

    A hash of the id parts the texts by rounds. In each round every part of the table is a
    worker: it starts from the last average and reads its texts of the round from their first
    word to their end. Workers grow with the table, and small parts are put together. Averages
    are taken in two steps, so the driver gets about the square root of the workers' number.
    """
    model, seen = Gru(vocabulary, embed, hidden), 0
    # Enough tokens for each that its windows are as wide as they may be.
    workers = max(1, vocabulary.tokens // (rounds * streams * window * steps))
    turn = F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(rounds))

    def worked(number: int):
        start = packed(model)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, mine = Coder(vocabulary), unpacked(Gru(vocabulary, embed, hidden), start)
            texts = (
                text
                for batch in batches
                for _, part in slices(batch.column("_text"), SLICE_BYTES)
                for text in coder.numbers(part)
            )
            n = train_texts(mine, texts, window, streams, rate * fall**number, steps)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([packed(mine)], pa.binary())], names=["n", "weights"])

        return work

    for number in range(rounds):
        own = training.where(turn == number).select("_text").coalesce(workers)
        parts = own.mapInArrow(worked(number), "n long, weights binary").repartition(math.isqrt(workers))
        parts = parts.mapInArrow(_mean, "n long, weights binary").toArrow()
        for mean in _mean(parts.combine_chunks().to_batches()):
            unpacked(model, mean.column("weights")[0].as_py())
            seen += mean.column("n")[0].as_py()
    model.seen = seen
    return model


@dropping_shuffles
@hashing_parts
def document_scores(docs: DataFrame, held_out: tuple[int, int] = (10, 0), listed: int = 4_096, known: int = 1 << 16,
                    embed: int = 16, hidden: int = 24, window: int = 64, streams: int = 128, rate: float = 0.03,
                    rounds: int = 2, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Whole-document log10 probabilities of each row under the recurrent model, and under word counts alone.

    Counts cover every token of all documents whose ``id_remainder`` is not the held-out one.
    The model spells the ``listed`` most frequent words; any other is its class's event, made
    a word by the counts: ``(c + 0.1) / Z`` over the words outside the list, with one 0.1 for all
    words never seen. Counts of the ``known`` most frequent words go to every task; those of
    the rarer words are joined. The recurrent weights are trained on every token of these
    documents, too, each read once from its start to its end.

    A null text is an empty one: its only token is the end. A null id counts as an empty id
    text. Repeated rows are scored each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    modulus, kept_back = held_out
    texts = docs.select(
        F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"),
        (id_remainder(id_column, modulus) == kept_back).alias("_held_out"),
    )
    training = texts.where(~F.col("_held_out"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pc.ascii_lower(pc.fill_null(batch.column("_text"), ""))
            for _, part in slices(column, SLICE_BYTES):
                found = pc.ascii_split_whitespace(part).flatten()
                pairs = found.filter(pc.not_equal(found, "")).value_counts()
                ends = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pairs.field("values"), pa.array([None], pa.string())]),
                     pa.concat_arrays([pairs.field("counts"), pa.array([ends], pa.int64())])],
                    names=["word", "n"],
                )

    counts = training.select("_text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "recurrent-counts")
    vocabulary = build_vocabulary(counts, listed)
    model = fit_recurrent(training, vocabulary, embed, hidden, window, streams, rate, rounds)
    # A bounded part of the counts; the rest stays a table.
    often = counts.where(F.col("word").isNotNull()).orderBy(F.desc("n"), "word").limit(known).toArrow()
    often_words = often.column("word").combine_chunks().cast(pa.string())
    often_counts = np.append(often.column("n").to_numpy().astype(float), 0)
    tokens, distinct = vocabulary.tokens, vocabulary.distinct
    end_count = vocabulary.counts[END]
    others = vocabulary.counts[OTHER] + 0.1 * (distinct - len(vocabulary.words) - (end_count > 0)) + 0.1
    weights = packed(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, own_model = Coder(vocabulary), unpacked(Gru(vocabulary, embed, hidden), weights)
        for batch in batches:
            column = batch.column("_text")
            for at, part in slices(column, SLICE_BYTES):
                numbers, words, codes, texts_of = coder.code(part)
                size = len(part)
                counts_of = often_counts[places_in(words, often_words)]
                in_list = places_in(words, coder.words) < len(coder.words)
                log = np.log10(counts_of + 0.1)
                told = counts_of[codes] > 0
                mine = texts_of[told]
                base = np.bincount(mine, log[codes][told], size) + math.log10(end_count + 0.1)
                outside = ~in_list[codes]
                other_log = np.bincount(texts_of[told & outside], log[codes][told & outside], size)
                n_other = np.bincount(texts_of[outside], minlength=size)
                n_known = np.bincount(mine, minlength=size) + (end_count > 0)
                # Words rarer than the bounded part, with their numbers in each text.
                keys = texts_of[~told].astype(np.int64) * len(words) + codes[~told]
                keys, times = np.unique(keys, return_counts=True)
                offsets = np.searchsorted(keys, np.arange(size + 1) * len(words)) if len(words) else np.zeros(size + 1, int)
                rare_words = words.take(pa.array(keys % len(words) if len(words) else keys))
                rare = pa.ListArray.from_arrays(
                    offsets.astype(np.int32),
                    pa.StructArray.from_arrays([rare_words, pa.array(times)], names=["word", "k"]),
                )
                gru = score_texts(own_model, numbers) / math.log(10)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").slice(at, size), batch.column("_held_out").slice(at, size),
                     pa.array(np.array([len(x) for x in numbers], np.int64)), pa.array(n_known.astype(np.int64)),
                     pa.array(base), pa.array(gru + other_log - n_other * math.log10(others)), rare],
                    names=["_id", "_held_out", "n_tokens", "n_known", "base", "gru", "rare"],
                )

    schema = (
        "_id long, _held_out boolean, n_tokens long, n_known long, base double, gru double, "
        "rare array<struct<word: string, k: long>>"
    )
    read = texts.mapInArrow(scored, schema).withColumn("row", F.monotonically_increasing_id())
    read = materialize(read, "recurrent-documents")
    # Rare words only, so no word is common enough to crowd a task.
    rare = read.select("row", F.inline("rare")).join(counts.where(F.col("word").isNotNull()), "word", "left")
    sums = rare.groupBy("row").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rare_log"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("rare_known"),
    )
    sums = materialize(sums, "recurrent-rare")
    log_all = math.log10(tokens + 0.1 * (distinct + 1))
    joined = read.drop("rare").join(sums, "row", "left")
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return joined.select(
        "_id", F.col("_held_out").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + rare_log - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("gru") + rare_log).alias("score"),
    )

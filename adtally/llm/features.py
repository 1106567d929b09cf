"""Hashed indicator features of whole texts, and bounded labelled samples to learn from."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RUNS = re.compile(r"(.)\1+")
_EDGES = ".,;:!?\"'()[]"
#: Odd multipliers that keep the streams of features apart.
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def give_back() -> None:
    """Return what is free in this process to the machine: of Arrow's pool, and of the heap that numpy's arrays lie in."""
    pa.default_memory_pool().release_unused()
    # Looked up each time, as what travels with a job holds no pointers. Other C libraries have no such call.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class _Shapes(dict):
    """What str.translate writes for a character: letters by case, digits as one, others as they are."""

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        kind = "A" if letter.isupper() else "a" if letter.isalpha() else "0" if letter.isdigit() else letter
        self[code] = kind
        return kind


class TextFeatures:
    """Distinct hashed n-grams of words and, if asked for, of their shapes.

    A shape is a word's runs of letters, digits and signs; a word that repeats the one before
    it has a shape of its own. Words are parted by ASCII white space and lower-cased, and
    stripped of marks at their edges if ``bare``. Each length in ``stems`` adds two features a
    beginning of that many letters: that words of the text begin so, and that two or more do.
    About ``held`` words are remembered at most.
    """

    def __init__(self, bits: int = 22, bigrams: bool = True, shapes: bool = True, bare: bool = False,
                 stems: tuple[int, ...] = (), held: int = 200_000) -> None:
        self.bits, self.bigrams, self.shapes, self.bare, self._held = bits, bigrams, shapes, bare, held
        self.stems = stems
        self._kinds = _Shapes()
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._words = np.zeros(1 << 14, np.uint64)
        self._forms = np.zeros(1 << 14, np.uint64)
        # Hashes of a word's beginnings; 0 where it is too short.
        self._begins = np.zeros((1 << 14, len(self.stems)), np.uint64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self._known) > self._held:
            self._forget()
        known = self._known
        for word in words:
            if word not in known:
                at = known[word] = len(known)
                if at >= len(self._words):
                    self._words = np.concatenate([self._words, np.zeros_like(self._words)])
                    self._forms = np.concatenate([self._forms, np.zeros_like(self._forms)])
                    self._begins = np.concatenate([self._begins, np.zeros_like(self._begins)])
                lower = word.lower()
                lower = (lower.strip(_EDGES) or lower) if self.bare else lower
                self._words[at] = xxhash.xxh64_intdigest(lower, 1)
                for place, length in enumerate(self.stems):
                    if len(lower) >= length:
                        self._begins[at, place] = xxhash.xxh64_intdigest(lower[:length], 3) or 1
                if self.shapes:
                    self._forms[at] = xxhash.xxh64_intdigest(_RUNS.sub(r"\1", word.translate(self._kinds)), 2)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def pairs(self, texts: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Text numbers and feature numbers, each pair once, sorted; only features that ``keep`` marks."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        words = numbers[codes]
        texts_of = np.repeat(np.arange(len(cut)), np.diff(cut.offsets.to_numpy()))
        begun = self._stem_pairs(numbers, codes, texts_of, keep)
        # ASCII splitting leaves empty strings at the edges of a text.
        empty = self._known.get("")
        if empty is not None:
            texts_of, words = texts_of[words != empty], words[words != empty]
        streams = [self._words[words]]
        same_text = texts_of[1:] == texts_of[:-1] if len(texts_of) else np.zeros(0, bool)
        if self.shapes:
            again = np.zeros(len(words), np.uint64)
            again[1:] = same_text & (words[1:] == words[:-1])
            streams.append(self._forms[words] ^ again * _SECOND)
        found, where = [], []
        with np.errstate(over="ignore"):
            for stream in streams:
                found.append(stream * _FIRST)
                where.append(texts_of)
                if self.bigrams:
                    found.append(((stream[:-1] * _SECOND ^ stream[:-1] >> np.uint64(29)) + stream[1:] * _FIRST)[same_text])
                    where.append(texts_of[:-1][same_text] if len(texts_of) else texts_of)
        features = (np.concatenate(found) >> np.uint64(64 - self.bits)).astype(np.int64)
        of = np.concatenate(where)
        if keep is not None:
            wanted = keep[features]
            features, of = features[wanted], of[wanted]
        both = np.unique(np.concatenate([of << self.bits | features, *begun]))
        return both >> self.bits, both & (1 << self.bits) - 1

    def _stem_pairs(self, numbers: np.ndarray, codes: np.ndarray, texts_of: np.ndarray, keep: np.ndarray | None) -> list[np.ndarray]:
        """Text and feature in one number, for words' beginnings and for those that a text repeats."""
        size, pairs = (1 << self.bits) - 1, []
        for place in range(len(self.stems)):
            hashes = self._begins[numbers, place]
            with np.errstate(over="ignore"):
                once = (hashes * _FIRST >> np.uint64(64 - self.bits)).astype(np.int64)
            again = once * 0x9E3779B1 + 0x27D4EB4F & size
            used = hashes != 0
            if keep is not None:
                used &= keep[once] | keep[again]
            here = used[codes]
            both, times = np.unique(texts_of[here] << self.bits | once[codes[here]], return_counts=True)
            twice = both[times > 1]
            twice = twice & ~size | (twice & size) * 0x9E3779B1 + 0x27D4EB4F & size
            pairs += [both, twice] if keep is None else [both[keep[both & size]], twice[keep[twice & size]]]
        return pairs

    def slices(self, texts: pa.Array, slice_bytes: int = 1 << 20) -> Iterator[pa.Array]:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + slice_bytes, "right")))
            yield texts.slice(at, stop - at)
            at = stop
            # What a slice took would stay with the worker until it ends.
            give_back()


def id_remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


@dataclass
class Sample:
    """Features of labelled texts in rows' order: ``starts`` parts ``features`` by row."""

    labels: np.ndarray
    starts: np.ndarray
    features: np.ndarray
    folds: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.labels)

    def row(self, at: int) -> np.ndarray:
        return self.features[self.starts[at] : self.starts[at + 1]]

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows, dtype=np.int32), np.diff(self.starts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, features: dict, rows: int,
                    held_out: tuple[int, int], id_column: str = "doc_id", text_column: str = "text") -> Sample:
    """At most ``rows`` labelled documents, chosen by a hash of their id, as features.

    Rows whose ``id_remainder(modulus)`` is ``held_out``'s second number are never among them.
    Rows with a null id or a null label teach nothing. A document listed twice counts twice.
    What reaches the driver is bounded: the sample's distinct feature numbers.
    """
    modulus, kept_back = held_out
    chosen = (
        labels.select(F.col(id_column).cast("long").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (id_remainder("_id", modulus) != kept_back))
        .withColumn("_order", F.xxhash64("_id", F.lit(17)))
        .orderBy("_order", "_id", "_label")
        .limit(rows)
    )
    texts = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).cast("string").alias("_text"))
    # The sample is bounded by its number of rows.
    joined = texts.join(F.broadcast(chosen), "_id").select("_id", "_order", "_label", "_text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TextFeatures(**features)
        for batch in batches:
            at = 0
            for part in reader.slices(batch.column("_text")):
                of, found = reader.pairs(part)
                ends = np.append(0, np.cumsum(np.bincount(of, minlength=len(part)))).astype(np.int32)
                rest = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays(
                    [rest.column("_id"), rest.column("_order"), rest.column("_label"),
                     pa.ListArray.from_arrays(ends, pa.array(found.astype(np.int32)))],
                    names=["_id", "_order", "_label", "found"],
                )
                at += len(part)

    sent = joined.mapInArrow(featured, "_id long, _order long, _label int, found array<int>").toArrow()
    sent = sent.take(pc.sort_indices(sent, [("_order", "ascending"), ("_id", "ascending"), ("_label", "ascending")]))
    found = sent.column("found").combine_chunks()
    if isinstance(found, pa.ChunkedArray):
        found = found.chunk(0) if found.num_chunks else pa.array([], pa.list_(pa.int32()))
    counts = np.asarray(pc.fill_null(pc.list_value_length(found), 0), np.int64)
    return Sample(
        np.asarray(sent.column("_label"), np.int64),
        np.append(0, np.cumsum(counts)),
        np.asarray(found.flatten(), np.int32),
        np.asarray(sent.column("_order"), np.int64) % 5,
    )

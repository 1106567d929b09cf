"""Whole texts to token ids, with every distinct word of a task encoded once.

The vocabularies split a text before they merge, and never inside a change from a character
that is not white space to one that is. So a text may be cut at such changes and its pieces
be encoded apart: the ids are those of the whole text. Words repeat, so most pieces are
looked up instead of encoded. A text with other spacing than single blanks and line ends is
cut by a slower rule, and a piece outside the Latin letters is left to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space as the vocabularies' own patterns have it; Python's \s also holds U+001C to U+001F.
_CUT = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
# A blank or line end that follows white space.
_RUN = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}][ \\n]"
_BEYOND = re.compile("[^\\x00-ɏ]|<\\|")
# The vocabularies' split patterns, for characters below U+0250.
_LETTERS, _NUMBERS, _SPACE = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACED = re.compile(
    f"{_CONTRACTIONS}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)
_BARE = re.compile(f"{_CONTRACTIONS}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter a byte-level vocabulary writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


_BYTE_LETTERS = np.array([ord(letter) for _, letter in sorted(_byte_letters().items())], "<u2")
_STOPS = (".", ",")
# A blank, letters, a stop: most pieces. Letters whose lower case is one letter, too.
_PLAIN = f"^ ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+[{''.join(_STOPS)}]?$"


class _Numbers(dict):
    """Numbers pieces in the order they are first asked for."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


class _Runs:
    """Runs of ids by number, in one array that grows."""

    def __init__(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used, known = self.used + len(ids), self.known + len(lengths)
        self.flat, self.starts, self.lengths = _room(self.flat, used), _room(self.starts, known), _room(self.lengths, known)
        self.flat[self.used : used] = ids
        self.lengths[self.known : known] = lengths
        self.starts[self.known : known] = self.used + np.cumsum(lengths) - lengths
        self.used, self.known = used, known

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs' ids one after another, and where each run ends."""
        return _joined(self.flat, self.starts, self.lengths, numbers)


def _joined(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = lengths[numbers]
    ends = np.cumsum(lengths)
    steps = np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)
    return flat[np.repeat(starts[numbers] - ends + lengths, lengths) + steps], ends


class PieceEncoder:
    """Encodes texts by a byte-level vocabulary file, each text followed by ``end_id``.

    About ``held`` parts of pieces are remembered at most. Pieces are not: the same words come
    with and without a stop, and most pieces of a slice are not among those of the slices before.
    A vocabulary either has tokens for white space or drops it; one that drops it also lower-cases.
    """

    def __init__(self, vocabulary: str, end_id: int, held: int = 400_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._model = self._tokenizer.model
        self._keeps_space = bool(self._tokenizer.encode(" ", add_special_tokens=False).ids)
        self._end_id, self._held = end_id, held
        self._forget_parts()

    def _forget_parts(self) -> None:
        self._part_numbers, self._parts = _Numbers(), _Runs()

    def _split(self, text: str) -> list:
        """A piece's parts; a tuple stands for a text that the library takes whole."""
        if _BEYOND.search(text):
            return [(text,)]
        if not self._keeps_space:
            text = text.lower()
        core = text[1:] if self._keeps_space and text[:1] == " " else text
        if core.isalpha():
            return [text]
        return (_SPACED if self._keeps_space else _BARE).findall(text)

    def _learn(self, parts: list) -> None:
        """Ids of parts seen for the first time."""
        # What the library takes whole is an empty string among the others.
        plain = [part if isinstance(part, str) else "" for part in parts]
        spelled = _lettered("\0".join(plain)).split(_lettered("\0"))
        if len(spelled) != len(parts):
            spelled = list(map(_lettered, plain))
        ids, ends, tokenize = array("I"), array("q", [0]), self._model.tokenize
        for part, letters in zip(parts, spelled):
            if letters:
                ids.extend([token.id for token in tokenize(letters)])
            elif part:
                ids.extend(self._tokenizer.encode(part[0], add_special_tokens=False).ids)
            ends.append(len(ids))
        self._parts.add(np.frombuffer(ids, np.uint32), np.diff(np.frombuffer(ends, np.int64)))

    def _numbered(self, parts: list) -> np.ndarray:
        numbers = np.fromiter(map(self._part_numbers.__getitem__, parts), np.int64, len(parts))
        if self._part_numbers.new:
            self._learn(self._part_numbers.new)
            self._part_numbers.new.clear()
        return numbers

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after another, and the number for each: plain ones by columns, the others one by one."""
        if len(self._part_numbers) > self._held:
            self._forget_parts()
        stops = self._numbered([*_STOPS])
        plain = pc.match_substring_regex(pieces, _PLAIN)
        words, others = pieces.filter(plain), list(map(self._split, _strings(pieces.filter(pc.invert(plain)))))
        stop = np.full(len(words), -1)
        for number, mark in zip(stops, _STOPS):
            stop[pc.ends_with(words, mark).to_numpy(zero_copy_only=False)] = number
        words = pc.ascii_rtrim(words, "".join(_STOPS))
        words = (words if self._keeps_space else pc.utf8_lower(words)).dictionary_encode()
        words = self._numbered(_strings(words.dictionary))[words.indices.to_numpy()]
        # Parts in pieces' order.
        plain = plain.to_numpy(zero_copy_only=False)
        per_piece = np.zeros(len(pieces), np.int64)
        per_piece[plain], per_piece[~plain] = 1 + (stop >= 0), [len(parts) for parts in others]
        ends = np.cumsum(per_piece)
        parts = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        parts[np.repeat(~plain, per_piece)] = self._numbered([*chain.from_iterable(others)])
        first = (ends - per_piece)[plain]
        parts[first] = words
        parts[first[stop >= 0] + 1] = stop[stop >= 0]
        ids, part_ends = self._parts.joined(parts)
        return ids, np.diff(np.append(0, part_ends)[ends], prepend=0)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        if not self._keeps_space:
            return pc.ascii_split_whitespace(texts)
        mark = next(m for m in map(chr, chain(range(9), range(0xE000, 0xF8FF))) if not pc.any(pc.match_substring(texts, m)).as_py())
        spaced = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", mark + "\n")
        unusual = pc.match_substring_regex(texts, _RUN)
        if pc.any(unusual).as_py():
            cut = [mark.join(_CUT.findall(t.as_py())) for t in texts.filter(unusual)]
            spaced = pc.replace_with_mask(spaced, unusual, pa.array(cut, pa.string()))
        return pc.split_pattern(spaced, mark)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = self._cut(pc.fill_null(texts, ""))
        coded = cut.flatten().dictionary_encode()
        ids, lengths = self._piece_ids(coded.dictionary)
        # The end is one more piece, and follows each text.
        ids, lengths = np.append(ids, np.uint32(self._end_id)), np.append(lengths, 1)
        per_text = np.diff(cut.offsets.to_numpy())
        pieces = np.full(len(coded) + len(texts), len(lengths) - 1, np.int64)
        place = np.ones(len(pieces), bool)
        place[np.cumsum(per_text + 1) - 1] = False
        pieces[place] = coded.indices.to_numpy()
        ids, ends = _joined(ids, np.cumsum(lengths) - lengths, lengths, pieces)
        return ids, np.diff(ends[np.cumsum(per_text + 1) - 1], prepend=0)

    def encode(self, texts: pa.Array, slice_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Slices of whole texts: the first text's place, the ids of all in a row, the number for each."""
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
        at = 0
        while at < len(texts):
            before = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + slice_bytes, "right")))
            yield (at, *self._encode(texts.slice(at, stop - at)))
            at = stop
            # What a slice took would stay with the worker until it ends.
            pa.default_memory_pool().release_unused()


def kept_encoder(vocabulary: str, end_id: int) -> PieceEncoder:
    """The encoder of this Python worker, which the tasks it runs one after another share.

    What travels with a job is unpacked for every task, so the encoder is kept where all of them
    find it: beside the modules. One is kept; its pieces are bounded by itself.
    """
    kept = sys.modules.setdefault("adtally_kept_encoder", types.ModuleType("adtally_kept_encoder")).__dict__
    if kept.get("made_for") != (vocabulary, end_id):
        kept["encoder"], kept["made_for"] = PieceEncoder(vocabulary, end_id), (vocabulary, end_id)
    return kept["encoder"]


def _lettered(text: str) -> str:
    """The text as a byte-level vocabulary writes it."""
    return _BYTE_LETTERS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def _room(values: np.ndarray, needed: int) -> np.ndarray:
    if needed <= len(values):
        return values
    return np.concatenate([values, np.zeros(max(needed, 2 * len(values)) - len(values), values.dtype)])

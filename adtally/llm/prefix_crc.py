"""CRC-32 of every n-gram of a text from running CRCs of its prefixes.

CRC-32 is linear over GF(2): crc(A + B) = shift(crc(A), len(B)) ^ crc(B), where ``shift`` is the
register's map for that many zero bytes. So a text is scanned once, the CRC after each word is
kept, and any run of words has crc(B) = crc(A + B) ^ shift(crc(A), len(B)), whatever its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lengths below this have a table of their own; longer ones add powers of two.
_NEAR = 64


def _byte_table() -> np.ndarray:
    """The register's change by one byte, from the polynomial of CRC-32 (reversed)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_BYTE = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of registers, given for each of their four bytes."""
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """``[length, byte, value]`` for short lengths, ``[power, byte, value]`` for 2 ** power zero bytes."""
    near = [np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]]
    for _ in range(_NEAR):
        near.append(_BYTE[near[-1] & 255] ^ (near[-1] >> 8))
    powers = [near[1]]
    for _ in range(39):
        powers.append(_apply(powers[-1], powers[-1]))
    return np.stack(near[:_NEAR]), np.stack(powers)


_SHORT, _POWERS = _shift_tables()


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes each."""
    low, high = lengths & (_NEAR - 1), lengths // _NEAR
    out = _SHORT[low, 0, crc & 255] ^ _SHORT[low, 1, (crc >> 8) & 255] ^ _SHORT[low, 2, (crc >> 16) & 255] ^ _SHORT[low, 3, crc >> 24]
    power = _NEAR.bit_length() - 1
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_POWERS[power], out[odd])
        high, power = high >> 1, power + 1
    return out


def _word_bytes() -> bytes:
    """Digits, letters a to z and bytes beyond ASCII stay, A to Z become small, all else a blank."""
    out = bytearray(b" " * 128) + bytes(range(128, 256))
    for low, high, to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
        for code in range(ord(low), ord(high) + 1):
            out[code] = code - ord(low) + ord(to)
    return bytes(out)


_WORD_BYTES = _word_bytes()


def _after(crc: int, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(b" ", crc))


def ngram_crcs(texts: pa.Array, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` and ``features`` of each text (its bytes in UTF-8), and the CRCs of all its n-grams in a row, text by text.

    A null text has no words. The scan runs through all texts of the slice: what stands before an
    n-gram cancels, be it of the same text or of the one before.
    """
    per_text = [(text or b"").translate(_WORD_BYTES).split() for text in texts.to_pylist()]
    words = np.fromiter(map(len, per_text), np.int64, len(per_text))
    flat = [word for each in per_text for word in each]
    ends = np.fromiter(accumulate(flat, _after, initial=0), np.uint32, len(flat) + 1)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    until = np.cumsum(sizes + 1)  # bytes up to a word's end, a blank before each
    since = until - sizes
    before = ~(_BYTE[(~ends[:-1] ^ np.uint32(32)) & 255] ^ (~ends[:-1] >> 8))  # the register past the blank
    first = np.cumsum(words) - words
    counts = {n: np.maximum(words - n + 1, 0) for n in orders}
    features = sum(counts.values())
    out = np.zeros(int(features.sum()), np.uint32)
    place = np.cumsum(features) - features
    for n, count in counts.items():
        step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        start = np.repeat(first, count) + step
        last = start + n - 1
        out[np.repeat(place, count) + step] = ends[last + 1] ^ shift(before[start], until[last] - since[start])
        place = place + count
    return words, features, out


def slices(texts: pa.Array, slice_bytes: int) -> Iterator[tuple[int, pa.Array]]:
    """Whole texts, about ``slice_bytes`` of them at a time (or one, however long), with the first one's place."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + slice_bytes, "right")))
        yield at, texts.slice(at, stop - at)
        at = stop

"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adtally.llm.encoding import kept_encoder

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, "
    "offset long, ids array<int>"
)


#: More loss than any bin holds.
_NOWHERE = 1e15


class Bins:
    """Fills bins from a pool of pieces, each time with the piece whose demand best matches what is left.

    A piece is ``(example, start, length)``; the first ``prompt`` ids of an example bear no
    loss. Demand and room are vectors of tokens, segments and loss-bearing tokens as shares of
    the limits; the next piece is the fitting one with the greatest dot product. When none
    fits, the piece is cut whose head fills most of the room, unless that is under
    ``least_piece`` ids.
    """

    def __init__(self, tokens: int, segments: int, loss: int, least_piece: int) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("Each limit of a sequence must be at least 1")
        self.tokens, self.segments, self.loss, self.least_piece = tokens, segments, loss, least_piece
        self.pooled = self.bearing = 0
        self._pieces: list = []
        self._free: list[int] = []
        # What the pieces demand of tokens and of loss; of segments each demands one. A free place fits nowhere.
        self._lengths, self._losses = np.zeros(0), np.zeros(0)

    def add(self, example, start: int, length: int) -> None:
        if not self._free:
            held = len(self._pieces)
            more = max(64, held)
            self._pieces += [None] * more
            self._free = list(range(held + more - 1, held - 1, -1))
            self._lengths = np.concatenate([self._lengths, np.zeros(more)])
            self._losses = np.concatenate([self._losses, np.full(more, _NOWHERE)])
        self._put(self._free.pop(), (example, start, length))

    def _put(self, at: int, piece) -> None:
        loss = self._loss_of(*piece)
        self._pieces[at], self._lengths[at], self._losses[at] = piece, piece[2], loss
        self.pooled += piece[2]
        self.bearing += loss

    def _take(self, at: int):
        piece = self._pieces[at]
        self._pieces[at], self._lengths[at], self._losses[at] = None, 0, _NOWHERE
        self._free.append(at)
        self.pooled -= piece[2]
        self.bearing -= self._loss_of(*piece)
        return piece

    @staticmethod
    def _loss_of(example, start: int, length: int) -> int:
        return start + length - min(max(start, example.prompt), start + length)

    def next_size(self) -> int:
        """Ids of the next bin: the limit, or a power of two, which needs no padding.

        A power of two is for a pool that cannot fill the limit, or that bears more loss than
        bins of the limit may hold.
        """
        fair = self.bearing * self.tokens <= self.loss * self.pooled
        if fair and self.pooled >= self.tokens:
            return self.tokens
        return 1 << (min(self.pooled, self.tokens if fair else min(self.loss, self.tokens)).bit_length() - 1)

    def fill(self, size: int) -> list:
        """The pieces of one bin of at most ``size`` ids."""
        tokens, segments, loss = size, self.segments, self.loss
        least = self.least_piece if size == self.tokens else 1
        placed = []
        while tokens > 0 and segments > 0 and self.pooled:
            lengths, losses = self._lengths, self._losses
            match = lengths * (tokens / self.tokens**2) + losses * (loss / self.loss**2) + segments / self.segments**2
            match[(lengths > tokens) | (losses > loss)] = -1.0
            at = int(match.argmax())
            if match[at] >= 0:
                piece = self._take(at)
            else:
                # A head is as long as the room for tokens, or for loss after the prompt, allows.
                heads = np.minimum(np.minimum(tokens, lengths - losses + loss), lengths)
                gap = int(heads.max())
                if gap < 1 or (placed and gap < least):
                    break
                at = int(np.where(heads == gap, lengths, -1).argmax())
                example, start, length = self._take(at)
                self.add(example, start + gap, length - gap)
                piece = (example, start, gap)
            placed.append(piece)
            tokens, segments, loss = tokens - piece[2], segments - 1, loss - self._loss_of(*piece)
        return placed


class _Example:
    __slots__ = ("name", "ids", "prompt")

    def __init__(self, name, ids: np.ndarray, prompt: int) -> None:
        self.name, self.ids, self.prompt = name, ids, prompt


def pack(docs: DataFrame, vocabulary: str, end_id: int, tokens: int = 2048, segments: int = 256,
         loss: int | None = None, least_piece: int = 8, pool_tokens: int = 1 << 18, keep_ids: bool = True,
         id_column: str = "doc_id", text_column: str = "text", prompt_column: str | None = None) -> DataFrame:
    """Pack all rows of ``docs`` into sequences; one row per piece of a document.

    Each task packs its own rows from a pool of about ``pool_tokens`` ids, so nothing is
    shuffled. A document longer than a sequence is cut into whole sequences and a rest, or, if
    ``loss`` is below ``tokens``, into pieces that a bin can hold; other cuts are made only
    where a bin would else be padded. A bin holds at most ``tokens`` ids, ``loss`` loss-bearing
    ones (``tokens``, if not given) and ``segments`` pieces. ``prompt_column`` counts the
    leading ids that bear no loss (none, if null or not given). What bears too much loss for
    whole bins, and what is left at the end of a task, goes into bins of powers of two, which
    need no padding.

    A null text is an empty one: its only id is ``end_id``. Repeated rows are packed as often
    as they come; a null ``doc_id`` stays null. Other columns are left out. ``sequence_id``
    is the task's number and a count, so it is the same when a lost task runs again.
    """
    loss = tokens if loss is None else loss
    prompt = F.coalesce(F.col(prompt_column).cast("long"), F.lit(0)) if prompt_column else F.lit(0).cast("long")
    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"),
        prompt.alias("prompt"),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, bins = kept_encoder(vocabulary, end_id), Bins(tokens, segments, loss, least_piece)
        sequence, out = TaskContext.get().partitionId() << 40, []

        def close(placed) -> None:
            nonlocal sequence
            offset = 0
            for example, start, length in placed:
                ids = example.ids[start : start + length]
                out.append((
                    example.name, start, length, zlib.crc32(ids.astype("<u4")), len(example.ids),
                    bins._loss_of(example, start, length), sequence, offset, ids if keep_ids else None,
                ))
                offset += length
            sequence += bool(placed)

        for batch in batches:
            names, prompts = batch.column("doc_id").to_pylist(), batch.column("prompt").to_pylist()
            for at, flat, counts in encoder.encode(batch.column("text")):
                for place, ids in enumerate(np.split(flat, np.cumsum(counts)[:-1]), at):
                    example, start = _Example(names[place], ids, max(0, prompts[place])), 0
                    while len(ids) - start >= tokens <= loss:
                        close([(example, start, tokens)])
                        start += tokens
                    while len(ids) - start > 0:
                        # A piece that alone breaks the loss limit is cut to keep it.
                        length = min(len(ids) - start, tokens)
                        over = bins._loss_of(example, start, length) - loss
                        length -= max(0, over)
                        bins.add(example, start, length)
                        start += length
                while bins.pooled > pool_tokens:
                    close(bins.fill(bins.next_size()))
                if out:
                    yield _batch(out)
                    out.clear()
        while bins.pooled:
            close(bins.fill(bins.next_size()))
        if out:
            yield _batch(out)

    return rows.mapInArrow(packed, PIECE_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split(" ")[0] for part in PIECE_SCHEMA.split(", ")]
    *numbers, ids = zip(*rows)
    columns = [pa.array(column, pa.int64()) for column in numbers]
    if ids[0] is None:
        columns.append(pa.nulls(len(ids), pa.list_(pa.int32())))
    else:
        ends = np.append(0, np.cumsum([len(own) for own in ids])).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).view(np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=names)

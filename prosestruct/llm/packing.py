"""Packing of tokenised documents into windows, by sum-of-squares online placement.

A document is its token ids and an end id. Whole windows are cut off its front; the rest, shorter than a window, is an
item. counts[h] is the number of windows filled up to level h. An item of size s goes where the sum of squares of
counts grows least: from level h to h + s it grows by 2 * (counts[h + s] - counts[h]) + 2, where a new window (h = 0)
or a full one has no count of its own. Ties go to the fuller window.

Windows are local to a task, so nothing is shuffled and no id waits for another task. Open windows are settled when there
are more than `max_open`, and at the end of a task: the fullest stay as they were placed and are topped up with what the
emptiest hold, so there are as many full windows as the ids make, and the fewest ids move. What is left, less than a
window, stays open, or at the end is cut into windows whose lengths are powers of two, which need no padding. So padding
is zero, and a task holds at most max_open windows besides one batch of texts.

Null texts count as empty: such a document is its end id alone. Rows with equal or null ids are documents of their own.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import arrow_schema, give_back, to_batch
from .word_bpe import loaded

WINDOW = 4096
END_ID = 2
MAX_OPEN = 1024
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Sequence ids are the task's partition times this, plus a count.
PER_TASK = 1 << 36

Piece = tuple  # (document, start, ids as little-endian 32-bit, tokens in document)


class SumOfSquares:
    """Online placement of pieces; yields (sequence, offset, piece) once a window closes."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN, first: int = 0) -> None:
        self.window, self.max_open, self.next = window, max_open, first
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.levels: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.open = self.moved = 0

    def _level(self, size: int) -> int:
        """The level whose window takes the item."""
        room = self.window - size
        now, then = self.counts[: room + 1], self.counts[size : self.window + 1]
        grows = 2 * (then - now) + 2
        grows[0] -= 1
        grows[room] -= 1  # a full window has no count
        grows[1:][now[1:] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(grows[::-1]))

    def _close(self, pieces: list[Piece]) -> Iterator[tuple[int, int, Piece]]:
        at = 0
        for piece in pieces:
            yield self.next, at, piece
            at += len(piece[2]) // 4
        self.next += 1

    def put(self, document, ids: bytes) -> Iterator[tuple[int, int, Piece]]:
        tokens = len(ids) // 4
        whole = tokens - tokens % self.window
        for start in range(0, whole, self.window):
            yield from self._close([(document, start, ids[4 * start : 4 * (start + self.window)], tokens)])
        if whole == tokens:
            return
        size = tokens - whole
        level = self._level(size)
        pieces: list[Piece] = []
        if level:
            pieces = self.levels[level].pop()
            self.counts[level] -= 1
            self.open -= 1
        pieces.append((document, whole, ids[4 * whole :], tokens))
        if level + size == self.window:
            yield from self._close(pieces)
            return
        self.levels[level + size].append(pieces)
        self.counts[level + size] += 1
        self.open += 1
        if self.open > self.max_open:
            yield from self.settle()

    def settle(self) -> Iterator[tuple[int, int, Piece]]:
        """Close as many windows as all open ids fill: the fullest, topped up from the emptiest. The rest is one open window."""
        windows = [(level, pieces) for level, held in enumerate(self.levels) for pieces in held]
        full, left = divmod(sum(level for level, _ in windows), self.window)
        spare = [piece for _, pieces in windows[: len(windows) - full] for piece in pieces][::-1]
        self.counts[:] = 0
        self.levels = [[] for _ in range(self.window + 1)]
        for level, pieces in windows[len(windows) - full :][::-1]:
            yield from self._close(pieces + self._taken(spare, self.window - level))
        if left:
            self.levels[left].append(spare[::-1])
            self.counts[left] = 1
        self.open = int(left > 0)

    def _taken(self, spare: list[Piece], room: int) -> list[Piece]:
        """Pieces of `room` ids from the end of `spare`, the last one cut."""
        out = []
        self.moved += room
        while room:
            document, start, ids, tokens = spare.pop()
            size = min(room, len(ids) // 4)
            out.append((document, start, ids[: 4 * size], tokens))
            if 4 * size < len(ids):
                spare.append((document, start + size, ids[4 * size :], tokens))
            room -= size
        return out

    def empty(self) -> Iterator[tuple[int, int, Piece]]:
        """Close all open windows without padding."""
        yield from self.settle()
        spare = [piece for level in self.levels for pieces in level for piece in pieces][::-1]
        left = sum(len(ids) // 4 for _, _, ids, _ in spare)
        while left:
            size = 1 << (left.bit_length() - 1)
            yield from self._close(self._taken(spare, size))
            left -= size
        self.counts[:] = 0
        self.levels = [[] for _ in range(self.window + 1)]
        self.open = 0


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, max_open: int = MAX_OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    schema = arrow_schema(documents, SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(tokenizer_path)
        end = int(end_id).to_bytes(4, "little")
        packer = SumOfSquares(window, max_open, TaskContext.get().partitionId() * PER_TASK)

        def rows(placed) -> pa.RecordBatch:
            kept = [(d, start, len(ids) // 4, ids, tokens, sequence, offset) for sequence, offset, (d, start, ids, tokens) in placed]
            return to_batch({name: [x[i] for x in kept] for i, name in enumerate(schema.names)}, schema)

        try:
            for batch in batches:
                texts = [x or "" for x in batch.column(1).to_pylist()]
                ids = encode(texts)
                yield rows(p for d, x in zip(batch.column(0).to_pylist(), ids, strict=True) for p in packer.put(d, x + end))
            yield rows(packer.empty())
        finally:
            batch = texts = ids = packer = None
            give_back()

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)

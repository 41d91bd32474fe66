"""Packs token ids into windows of a fixed size by the online sum-of-squares rule.

Every task packs the documents of its own part of the input, in their order, without a shuffle. A document longer
than a window fills whole windows first; what remains is placed into the fill level that keeps the sum of the
squared numbers of partly filled windows per level least (ties: the fullest). The numbers are kept in one array
with an entry per level. Many sparse windows may lie open at last, or once `OPEN` are: these are then closed by
cutting the documents of the emptiest into the gaps of the fullest. The one window a task is left with is cut at
powers of two, lengths that need no padding.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import serialized

OPEN = 4_096           # partly filled windows a task holds open
ROWS = 2_000           # pieces per batch of output


class Piece(NamedTuple):
    id: object
    start: int
    tokens: int          # of the whole document
    ids: bytes

    @property
    def size(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return self._replace(ids=self.ids[:4 * at]), self._replace(start=self.start + at, ids=self.ids[4 * at:])


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window, self.count = window, np.zeros(window + 1, np.int64)
        self.held: defaultdict[int, list[list[Piece]]] = defaultdict(list)
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose growth by `size` adds least to the sum of squares."""
        now, then = self.count[:self.window - size + 1], self.count[size:]
        added = 2 * (then - now) + 2
        added[-1] -= 1                                   # a full window leaves the array
        added = np.where(now > 0, added, np.iinfo(np.int64).max)
        added[0] = 2 * then[0] + 1
        return len(added) - 1 - int(np.argmin(added[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """The window, if it is full now."""
        level = self.level_for(piece.size)
        pieces = []
        if level:
            pieces = self.held[level].pop()
            self.count[level] -= 1
            self.open -= 1
        pieces.append(piece)
        return self.put(pieces, level + piece.size)

    def put(self, pieces: list[Piece], fill: int) -> list[Piece] | None:
        if fill == self.window:
            return pieces
        self.held[fill].append(pieces)
        self.count[fill] += 1
        self.open += 1
        return None

    def close(self) -> Iterator[list[Piece]]:
        """Empties the array: full windows, made by cutting the emptiest into the gaps, and one rest at most."""
        windows = [w for level in sorted(self.held, reverse=True) for w in self.held[level]]
        self.count[:] = 0
        self.held.clear()
        self.open = 0
        low, high = 0, len(windows) - 1
        spare: list[Piece] = []
        while low <= high:
            pieces = windows[low]
            gap = self.window - sum(p.size for p in pieces)
            while gap and (spare or high > low):
                if not spare:
                    spare = windows[high]
                    high -= 1
                piece = spare.pop()
                if piece.size > gap:
                    piece, rest = piece.cut(gap)
                    spare.append(rest)
                pieces.append(piece)
                gap -= piece.size
            low += 1
            yield pieces
        at, rest = 0, []
        for piece in spare:                              # of the last dissolved window; it fits in one
            rest.append(piece)
            at += piece.size
        if rest:
            yield rest


def halves(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """The pieces cut into runs whose lengths are powers of two, the largest first."""
    left = sum(p.size for p in pieces)
    queue, run, room = list(reversed(pieces)), [], 0
    while queue:
        if not room:
            room = 1 << (left.bit_length() - 1)
        piece = queue.pop()
        if piece.size > room:
            piece, rest = piece.cut(room)
            queue.append(rest)
        run.append(piece)
        room -= piece.size
        left -= piece.size
        if not room:
            yield run
            run = []


def windows(documents: Iterator[tuple[object, bytes]], window: int) -> Iterator[list[Piece]]:
    """Windows of pieces: all of `window` ids but the last few, whose lengths are powers of two."""
    levels = Levels(window)
    for id, ids in documents:
        piece = Piece(id, 0, len(ids) // 4, ids)
        while piece.size >= window:
            full, piece = piece.cut(window)
            yield [full]
        if piece.size and (full := levels.place(piece)):
            yield full
        if levels.open >= OPEN:
            for pieces in levels.close():
                fill = sum(p.size for p in pieces)
                if full := levels.put(pieces, fill):
                    yield full
    for pieces in levels.close():
        if sum(p.size for p in pieces) == window:
            yield pieces
        else:
            yield from halves(pieces)


def pack(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = 4096, end: int = 2) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit).

    `tokenizer` is a tokenizers file whose tokens end at white space; every document gets the id `end` behind its
    own. Null and empty texts are that id alone. Each id lies in exactly one piece; a sequence's pieces lie at
    gapless offsets from 0. Repeated rows, and rows with a null id, are documents of their own. Other columns are
    not used. Sequence numbers hold the task's number, so they are unique and a task that runs again gives the
    same ones: rows are packed in the order they have in the input's files.
    """
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        id_type = None
        pending: list[tuple] = []

        def documents():
            for batch in batches:
                nonlocal id_type
                id_type = batch.schema.field(0).type
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    yield key, serialized(tokenizer, body.as_py(), end)

        def flush():
            ids, starts, lengths, totals, sequences, offsets, bodies = zip(*pending, strict=True)
            pending.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), *(pa.array(x, pa.int64()) for x in (starts, lengths, totals, sequences, offsets)),
                 pa.array(bodies, pa.binary())],
                [id, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for number, pieces in enumerate(windows(documents(), window)):
            offset = 0
            for p in pieces:
                pending.append((p.id, p.start, p.size, p.tokens, (task << 40) + number, offset, p.ids))
                offset += p.size
            if len(pending) >= ROWS:
                yield flush()
        if pending:
            yield flush()

    schema = f"`{id}` {kind}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"
    return docs.select(id, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)

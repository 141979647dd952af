"""Sum-of-squares online packing of token streams into fixed windows.

Each scan task packs the documents it reads, so nothing is shuffled and a lost task is simply run again. A
task keeps a level array: for every fill level, the partly filled windows at it. A document's full windows are
emitted as they are; its rest goes to the level at which the sum of squared counts of partly filled windows
becomes least. At the end of a task the windows that are left are merged by cutting pieces, and the last one is cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandwork.llm import tokens

WINDOW = 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


class LevelPacker:
    """Windows of one task. Pieces are (document number, start, length); a closed window is a list of them."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # the level array; both ends stay 0
        self.open: dict[int, list[list[tuple]]] = {}

    def place(self, piece: tuple) -> list[tuple] | None:
        """Put a piece shorter than a window; returns the window that it fills, if any.

        Moving a window from level h to h + s changes the sum of squares by 2 (N[h+s] - N[h] + 1), opening one
        by 2 N[s] + 1 and filling one by 1 - 2 N[h]; ties go to the fuller window.
        """
        size, n = piece[2], self.counts
        cost = n[size:] - n[: self.window + 1 - size] + 1.0
        cost[0], cost[-1] = n[size] + 0.5, 0.5 - n[self.window - size]
        cost[1:][n[1 : self.window + 1 - size] == 0] = np.inf
        level = len(cost) - 1 - int(np.argmin(cost[::-1]))
        pieces = self.open[level].pop() if level else []
        n[level] -= bool(level)
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open.setdefault(level + size, []).append(pieces)
        n[level + size] += 1
        return None

    def rest(self) -> Iterator[list[tuple]]:
        """The windows left, fullest first, refilled from the emptiest by cutting pieces; the last in powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for window in self.open[level] for p in window]
        last = sum(length for *_, length in left) % self.window
        sizes = [self.window] * (sum(length for *_, length in left) // self.window)
        sizes += [1 << k for k in reversed(range(last.bit_length())) if last >> k & 1]
        window, room = [], next(sizes := iter(sizes), 0)
        for doc, start, length in left:
            while length:
                n = min(length, room)
                window.append((doc, start, n))
                start, length, room = start + n, length - n, room - n
                if not room:
                    yield window
                    window, room = [], next(sizes, 0)


def _pack_task(batches: Iterator[pa.RecordBatch], path: str | None, end_id: int, window: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 40
    packer, kept, made, rows = LevelPacker(window), {}, 0, []

    def emit(pieces: list[tuple]) -> None:
        nonlocal made
        offset = 0
        for number, start, length in pieces:
            ids, begin, doc_id, total = kept[number][:4]
            rows.append((doc_id, start, length, tokens.crc32(ids[start - begin : start - begin + length]), total, first + made, offset))
            offset += length
            kept[number][4] -= length
            if not kept[number][4]:
                del kept[number]
        made += 1

    def flush() -> pa.RecordBatch:
        names = [c.split()[0].strip("`") for c in SCHEMA.split(", ")]
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
        rows.clear()
        return out

    number = 0
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode_column(batch.column(1), path, end_id)):
            whole = len(ids) // window * window
            kept[number] = [ids, 0, doc_id, len(ids), len(ids)]
            for start in range(0, whole, window):
                emit([(number, start, window)])
            if whole < len(ids):
                kept[number][:2] = ids[whole:].copy(), whole  # only the rest stays in memory
                if full := packer.place((number, whole, len(ids) - whole)):
                    emit(full)
            number += 1
            if len(rows) >= 8192:
                yield flush()
    for window_left in packer.rest():
        emit(window_left)
    if rows:
        yield flush()


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = tokens.END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents.

    A null or empty text is the end id alone. A null id stays null; rows with equal ids are documents of their
    own, each packed. An empty table gives no rows. Other columns are not read, whatever their names. A text of
    any length is cut into whole windows and one rest. Memory of a task: its open windows' ids, which the level
    array keeps to a few hundred windows.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(lambda it: _pack_task(it, tokenizer_path, end_id, window), SCHEMA)

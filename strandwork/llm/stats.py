"""Rule statistics of whole texts, vectorised over Arrow string buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from strandwork.llm.text import LOWER, chunks, window_hashes, word_hashes, word_spans

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_same_words", "n_ends")


def _is(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER, _DIGIT = _is(SYMBOLS), _is(bytes(range(65, 91))), _is(bytes(range(48, 58)))
_LETTER = _is(bytes([*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]))  # beyond ASCII: the first byte of a code point
_END = _is(b".!?")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(flags, dtype=np.int64)][offsets])


def _sorted_pairs(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by row and value, and which entries equal the one before."""
    order = np.argsort(value)
    order = order[np.argsort(row[order].astype(np.uint32), kind="stable")]
    same = np.zeros(len(order), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    return order, same


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """FIELDS of each row.

    Words are runs of bytes other than space and tab to carriage return. n_dup_lines: lines with a word that equal
    an earlier one. n_repeat_words: words in 8-word windows that the text has twice or more, the first included.
    n_same_words: words equal, but for case, to the one before. n_ends: words that end with . ! or ?
    """
    rows = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    row_of = np.repeat(np.arange(rows), n_words)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    in_word = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    point = (data & 0xC0) != 0x80
    words = word_hashes(data, starts, ends)
    # repeated windows
    full = window_hashes(words, WINDOW)
    at = np.flatnonzero(row_of[: len(full)] == row_of[WINDOW - 1 :]) if len(full) else np.zeros(0, np.int64)
    order, same = _sorted_pairs(row_of[at], full[at])
    twice = same.copy()
    twice[:-1] |= same[1:]
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, at[order[twice]], 1)
    np.add.at(covered, at[order[twice]] + WINDOW, -1)
    repeated = np.cumsum(covered[:-1]) > 0
    # lines
    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.r_[offsets[:-1][np.diff(offsets) > 0], breaks + 1])
    line_start = line_start[line_start < len(data)]
    line_end = np.r_[line_start[1:], len(data)][: len(line_start)]
    line_end = line_end - (data[line_end - 1] == 10) if len(line_end) else line_end
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[with_word], line_end[with_word], line_row[with_word]
    line_order, line_same = _sorted_pairs(line_row, word_hashes(data, line_start, line_end))
    low = word_hashes(LOWER[data], starts, ends)
    equal = np.zeros(len(low), bool)
    equal[1:] = (low[1:] == low[:-1]) & (row_of[1:] == row_of[:-1])
    count = lambda r: np.bincount(r, minlength=rows)
    return [
        n_words,
        _per_row(in_word & point, offsets),
        _per_row(_SYMBOL[data], offsets),
        count(line_row[line_order[line_same]]),
        count(row_of[repeated]),
        count(line_row),
        _per_row(_UPPER[data], offsets),
        _per_row(_LETTER[data], offsets),
        _per_row(_DIGIT[data], offsets),
        count(row_of[equal]),
        count(row_of[_END[data[ends - 1]]]) if len(ends) else count(row_of),
    ]


def measure(texts: pa.Array) -> np.ndarray:
    """A row of FIELDS for each text; null texts count as empty."""
    parts = [np.stack(statistics(d, o), 1) for _, _, d, o in chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FIELDS)), np.int64)


def _measured(texts: pa.Array) -> pa.Array:
    table = measure(texts)
    return pa.StructArray.from_arrays([pa.array(table[:, k].astype(np.int64)) for k in range(len(FIELDS))], list(FIELDS))


def rule_statistics(text: Column) -> Column:
    """Struct of FIELDS of a text column."""
    return F.arrow_udf(_measured, ", ".join(f"{f} long" for f in FIELDS))(text.cast("string"))

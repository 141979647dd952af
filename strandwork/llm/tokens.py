"""Token ids of whole texts by a public tokenizer, inside Arrow tasks.

The tokenizer of `word_bpe_49k.json` collapses white space before it splits, lower-cases code point by code
point, and no rule of it spans a space. So a text's ids are the ids of its space-separated words in order.
Each distinct word is encoded once per worker by the library; words are found again by a 64-bit hash (two of a
million words share one with odds of about 3e-8). Most texts' words are new to a worker, so plain ones are encoded
many at a time, joined by spaces, and told apart by the ids that end a part of a word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from strandwork.llm.text import LOWER, U64, chunks, word_hashes, word_spans

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Slots of a worker's word table; it starts anew when half of them are taken.
SLOTS = 1 << 21
#: New words that are encoded at once.
WORDS = 1024
#: Visible ASCII without an apostrophe, and the parts into which the tokenizer cuts it; an apostrophe may begin a part or be inside one.
PLAIN, PARTS = re.compile(r"[!-&(-~]+"), re.compile(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9]+")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or a copy twice as long if it is shorter than `size`."""
    if size <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


def _parts(word: str) -> int:
    """Parts into which the tokenizer cuts a word, 0 if only it can tell; letters are taken for one."""
    if word.isalpha():
        return 1
    return len(PARTS.findall(word)) if PLAIN.fullmatch(word) and "<|" not in word else 0


class Encoder:
    """Encodes texts to unsigned 16-bit ids, each document closed by `end_id`."""

    def __init__(self, path: str | None = None, end_id: int = END_ID, slots: int = SLOTS):
        self.tokenizer, self.slots, self.end_id = tokenizer(path or default_path()), slots, end_id
        if max(self.tokenizer.get_vocab_size(), end_id + 1) > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.closes = np.zeros(1 << 16, bool)  # ids that end a part of a word
        self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Words 0 to 3: nothing, the end of a document, a comma, a full stop."""
        self.keys, self.word = np.zeros(self.slots, U64), np.zeros(self.slots, np.int32)
        self.words, self.used = 0, 0  # of start and length, and of flat; the arrays have room for more
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(1024, np.uint16)
        comma, stop = (e.ids for e in self.tokenizer.encode_batch_fast([",", "."], add_special_tokens=False))
        self._append_lists([[], [self.end_id], comma, stop])

    def _append_lists(self, ids: list[list[int]]) -> None:
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self._append(length, np.fromiter((i for word in ids for i in word), np.uint16, int(length.sum())))

    def _append(self, length: np.ndarray, flat: np.ndarray) -> None:
        words, used = self.words + len(length), self.used + len(flat)
        self.start, self.length, self.flat = _room(self.start, words), _room(self.length, words), _room(self.flat, used)
        self.start[self.words : words] = self.used + np.cumsum(length) - length
        self.length[self.words : words], self.flat[self.used : used] = length, flat
        self.words, self.used = words, used

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Word index of each hash, or -1."""
        at = (hashes & U64(self.slots - 1)).astype(np.int64)
        found = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        while len(left):
            key = self.keys[at[left]]
            hit = key == hashes[left]
            found[left[hit]] = self.word[at[left[hit]]]
            left = left[~hit & (key != 0)]
            at[left] = (at[left] + 1) & (self.slots - 1)
        return found

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        parts = np.fromiter(map(_parts, words), np.int64, len(words))
        order = np.argsort(parts == 0, kind="stable")  # those of unknown parts last
        plain, index = np.count_nonzero(parts), np.empty(len(words), np.int32)
        index[order] = np.arange(self.words, self.words + len(words), dtype=np.int32)
        words, parts = [words[k] for k in order.tolist()], parts[order]
        at = (hashes & U64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = hashes[free]  # of several for one slot the last stays
            won = self.keys[at[left]] == hashes[left]
            self.word[at[left[won]]] = index[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & (self.slots - 1)
        for k in range(0, plain, WORDS):
            self._append_joined(words[k : min(k + WORDS, plain)], parts[k : min(k + WORDS, plain)])
        for k in range(plain, len(words), WORDS):
            self._append_lists([e.ids for e in self.tokenizer.encode_batch_fast(words[k : k + WORDS], add_special_tokens=False)])

    def _append_joined(self, words: list[str], parts: np.ndarray) -> None:
        """Words of known numbers of parts, encoded as one text. A word of letters that the library cuts after all has more parts
        than one and none has fewer, so the sum tells; then they are encoded one by one."""
        (joined,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        flat = np.array(joined.ids, np.uint16)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) == parts.sum() and ends[-1] == len(flat):
            self._append(np.diff(ends[np.cumsum(parts) - 1], prepend=0), flat)
        else:
            self._append_lists([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a buffer, and where each row's begin (one more entry than rows)."""
        if self.words > self.slots // 2:
            self._clear()
        if b"<|" not in data.tobytes():  # where a special token may stand, case counts
            data = LOWER[data]
        starts, ends, first = word_spans(data, offsets)
        rows, suffix = len(offsets) - 1, np.zeros(len(starts), np.int32)
        if len(starts):
            last, before = data[ends - 1], data[np.maximum(ends - 2, 0)]
            cut = (ends - starts > 1) & ((last == 44) | (last == 46)) & (before >= 97) & (before <= 122)
            suffix[cut] = np.where(last[cut] == 44, 2, 3)
            ends = ends - cut
        hashes = np.maximum(word_hashes(data, starts, ends), U64(1))
        word = self._find(hashes)
        lost = np.flatnonzero(word < 0)
        if len(lost):
            new, at = np.unique(hashes[lost], return_index=True)
            at, raw = lost[at], data.tobytes()
            self._learn(new, [raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            word[lost] = self._find(hashes[lost])
        row = np.repeat(np.arange(rows), np.diff(first))
        place = 2 * np.arange(len(starts)) + row
        items = np.zeros(2 * len(starts) + rows, np.int32)
        items[place], items[place + 1] = word, suffix
        items[2 * first[1:] + np.arange(rows)] = 1
        length = self.length[items]
        until = np.r_[0, np.cumsum(length)]
        ids = self.flat[np.repeat(self.start[items] - until[:-1], length) + np.arange(until[-1])]
        return ids, until[np.r_[2 * first[:-1] + np.arange(rows), len(items)]]


_encoders: dict = {}


def encode_column(texts: pa.Array, path: str | None = None, end_id: int = END_ID) -> Iterator[np.ndarray]:
    """The ids of each row in turn; the encoder and its table live as long as the Python worker."""
    encoder = _encoders.get((path, end_id)) or _encoders.setdefault((path, end_id), Encoder(path, end_id))
    for _, _, data, offsets in chunks(texts):
        ids, at = encoder.encode(data, offsets)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield ids[a:b]


def crc32(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())

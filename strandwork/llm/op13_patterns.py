"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of benchmark items: ten consecutive words, or all words of a shorter item. Strings of
one length are searched together. A shift table tells, by the hash of the block of two words that ends at a place,
how many words on the next place lies at which a string can end; where it is zero, the bucket of that
block's hash selects the strings with this end, in order of the hash of their words, and the words themselves are
compared byte by byte. The texts of a chunk are cut into runs of places whose cursors advance together, so that all
steps are array operations.

Tables are broadcast, so they hold a bounded number of strings. A benchmark with more is searched in several passes,
each over all documents, which carry what has been found so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.llm.common import Scratch
from strandwork.llm.text import LOWER, U64, chunks, give_back, mix, spans, window_hashes, word_hashes

#: Words of a test string.
WINDOW = 10
#: Strings, with one for each item that has them, and their bytes in one broadcast.
SHARD_STRINGS, SHARD_BYTES = 1 << 19, 1 << 26
#: Places between which a cursor runs.
RUN = 96
#: Bytes that are compared at once.
COMPARE_BYTES = 1 << 22

#: Bytes of words: digits, a to z, and all of characters beyond ASCII. Texts are lower-cased before.
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPACE = np.uint8(0x20)
_BLOCK = U64(0xA0761D6478BD642F)


def _compact(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first) of texts: words apart by one space, where each begins and ends, the first word of each text."""
    low = LOWER[data]
    starts, ends, first = spans(IS_WORD[low], offsets)
    length = ends - starts
    begin = np.cumsum(length + 1) - (length + 1)
    row = np.repeat(np.arange(len(starts)), length)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    out = np.full(len(row) + len(starts), SPACE, np.uint8)
    out[begin[row] + inner] = low[starts[row] + inner]
    return out, begin, begin + length, first


@dataclass
class Strings:
    """Tables of the test strings of one length in words."""

    words: int
    block: int
    shift: np.ndarray
    order: np.ndarray  # bucket of the end's hash, then hash of all words, both in one number, ascending
    bucket: np.ndarray  # where each bucket begins in `order`
    start: np.ndarray
    end: np.ndarray
    item_at: np.ndarray
    items: np.ndarray


@dataclass
class Tables:
    """What one pass searches for: tables by length, the bytes of all strings, the names of their items."""

    data: np.ndarray
    groups: list[Strings] = field(default_factory=list)
    names: list[str] = field(default_factory=list)


def _block_slot(hashes: np.ndarray, at: np.ndarray, block: int, mask: np.uint64) -> np.ndarray:
    """Table slot of the block of words that ends at each place."""
    total = np.zeros(len(at), U64)
    for k in range(block):
        total = mix(total ^ hashes[at - k] ^ _BLOCK)
    return (total & mask).astype(np.int64)


def build(rows: list[tuple[str, str | None]]) -> Tables:
    """Tables of (string, item) rows; words of a string are apart by one space. An item of None marks words but has no name."""
    by_string: dict[str, set[str | None]] = {}
    for string, item in rows:
        by_string.setdefault(string, set()).add(item)
    names = sorted({n for s in by_string.values() for n in s if n is not None})
    number = {n: k for k, n in enumerate(names)}
    texts = sorted(by_string)
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    tables = Tables(np.frombuffer(b"".join(raw), np.uint8), names=names)
    starts, ends, first = spans(tables.data != SPACE, offsets)
    hashes, counts = word_hashes(tables.data, starts, ends), np.diff(first)
    for n in np.unique(counts).tolist():
        mine = np.flatnonzero(counts == n)
        block = min(2, n)
        steps = n - block + 1
        mask = U64((1 << max(10, int(len(mine) * steps * 4).bit_length())) - 1)
        shift = np.full(int(mask) + 1, steps, np.uint8 if steps < 256 else np.int64)
        for k in range(steps):  # a block that ends k words before the end of a string
            np.minimum.at(shift, _block_slot(hashes, first[mine] + n - 1 - k, block, mask), k)
        slot = _block_slot(hashes, first[mine] + n - 1, block, mask)
        of = np.stack([hashes[first[mine] + k] for k in range(n)], 1)
        key = window_hashes(of.ravel(), n)[::n]
        rank = np.lexsort((key, slot))
        mine, slot, key = mine[rank], slot[rank], key[rank]
        held = [sorted(number[i] for i in by_string[texts[m]] if i is not None) for m in mine.tolist()]
        tables.groups.append(Strings(n, block, shift, key, np.searchsorted(slot, np.arange(int(mask) + 2)), offsets[mine], offsets[mine + 1], np.cumsum([0, *map(len, held)]), np.array([i for h in held for i in h], np.int64)))
    return tables


def _ends(s: Strings, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places at which the shift table lets a string end, and the slots of their blocks."""
    counts = np.diff(first)
    enough = np.flatnonzero(counts >= s.words)
    runs = (counts[enough] - s.words) // RUN + 1
    of = np.repeat(enough, runs)
    at = first[of] + s.words - 1 + (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
    stop = np.minimum(at + RUN, first[of + 1])
    mask = U64(len(s.shift) - 1)
    places, slots = [], []
    while len(at):
        slot = _block_slot(hashes, at, s.block, mask)
        skip = s.shift[slot].astype(np.int64)
        zero = skip == 0
        places.append(at[zero])
        slots.append(slot[zero])
        at = at + np.maximum(skip, 1)
        on = at < stop
        at, stop = at[on], stop[on]
    return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int64), *slots])


def _in_bucket(s: Strings, slot: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, string) of the strings of each row's bucket that have its hash."""
    low, high = s.bucket[slot], s.bucket[slot + 1]
    top = high.copy()
    while (open_ := low < high).any():  # binary search of all rows at once
        middle = (low + high) // 2
        less = open_ & (s.order[np.minimum(middle, len(s.order) - 1)] < key)
        low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
    rows, strings, live = [], [], np.flatnonzero(low < top)
    while len(live):
        live = live[(low[live] < top[live])]
        live = live[s.order[low[live]] == key[live]]
        rows.append(live)
        strings.append(low[live])
        low[live] += 1
    return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *strings])


def _same(text: np.ndarray, at: np.ndarray, other: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether so many bytes of `text` from each place are those of `other` from its place."""
    out, first, total = np.ones(len(at), bool), 0, np.cumsum(length)
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + COMPARE_BYTES, "right")))
        n = length[first:last]
        row = np.repeat(np.arange(last - first), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        differ = text[at[first:last][row] + inner] != other[start[first:last][row] + inner]
        out[first:last] = np.bincount(row[differ], minlength=last - first) == 0
        first = last
    return out


def occurrences(tables: Tables, text: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> Iterator[tuple[Strings, np.ndarray, np.ndarray]]:
    """(tables, place of the last word, string) of all occurrences, by length of the strings."""
    hashes = word_hashes(text, begin, end)
    for s in tables.groups:
        at, slot = _ends(s, hashes, first)
        if not len(at):
            continue
        key = np.zeros(len(at), U64)
        for k in range(s.words):
            key = mix(key + hashes[at - s.words + 1 + k] * U64(2 * k + 3))
        row, string = _in_bucket(s, slot, key)
        at = at[row]
        low, length = begin[at - s.words + 1], end[at] - begin[at - s.words + 1]
        fits = length == s.end[string] - s.start[string]
        at, string, low, length = at[fits], string[fits], low[fits], length[fits]
        same = _same(text, low, tables.data, s.start[string], length)
        yield s, at[same], string[same]


def _search_task(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(row columns, n_words, hits, items): hits has a bit for each word, items the names found, both with those of earlier passes."""
    tables: Tables = shared.value
    for batch in batches:
        hits, items, words = [], [], []
        before = batch.schema.get_field_index("hits")
        for a, b, data, offsets in chunks(batch.column(1)):
            text, begin, end, first = _compact(data, offsets)
            mark, rows, found = np.zeros(len(begin) + 1, np.int32), [], []
            for s, at, string in occurrences(tables, text, begin, end, first):
                np.add.at(mark, at - s.words + 1, 1)
                np.add.at(mark, at + 1, -1)
                n = s.item_at[string + 1] - s.item_at[string]
                rows.append(np.repeat(np.searchsorted(first, at, "right") - 1, n))
                found.append(s.items[np.repeat(s.item_at[string] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
            hit = np.cumsum(mark[:-1]) > 0
            pairs = np.unique(np.stack([np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *found])], 1), axis=0)
            cut = np.searchsorted(pairs[:, 0], np.arange(b - a + 1))
            words.append(np.diff(first))
            for k in range(b - a):
                bits = np.packbits(hit[first[k] : first[k + 1]]).tobytes()
                own = {tables.names[i] for i in pairs[cut[k] : cut[k + 1], 1].tolist()}
                if before >= 0:
                    bits = (np.frombuffer(bits, np.uint8) | np.frombuffer(batch.column(before)[a + k].as_py(), np.uint8)).tobytes()
                    own |= set(batch.column(before + 1)[a + k].as_py())
                hits.append(bits)
                items.append(sorted(own))
        columns = [batch.column(0), batch.column(1), pa.array(np.concatenate([np.zeros(0, np.int64), *words])), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_words", "hits", "items"])
        give_back()


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [int(np.bitwise_count(np.frombuffer(h.as_buffer(), np.uint8)).sum(dtype=np.int64)) for h in batch.column(2)]
        items = batch.column(3).to_pylist()
        digest = [hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(digest), pa.array([h > 0 for h in hits]), batch.column(3)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def _window_task(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, data, offsets in chunks(batch.column(1)):
            text, begin, end, first = _compact(data, offsets)
            raw = text.tobytes()
            for k, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                n = min(window, high - low)
                for at in range(low, high - n + 1 if n else low, 4096):
                    strings = [raw[begin[i] : end[i + n - 1]].decode() for i in range(at, min(at + 4096, high - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(strings, pa.string()), pa.array([batch.column(0)[a + k].as_py()] * len(strings), pa.string())], ["string", "item"])


def windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(string, item): the distinct windows of each item, its id as text."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _window_task(it, window), "string string, item string").distinct()


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_strings: int = SHARD_STRINGS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every row of `docs`.

    A word is hit if it lies inside an occurrence of any item's window. Null and wordless texts have no words and
    hit nothing; null and wordless items have no window. An item without an id marks words but is neither
    counted nor named; rows of one item id are one item; rows of one doc_id are rows of their own. With no items
    nothing is hit, with no documents there are no rows. Other columns are not read. Words keep no case in A-Z. A
    text is held whole by one task, with about 40 times its bytes while it is searched. The windows are
    a table in `scratch`; passes after the first, which only benchmarks of more than `shard_strings` windows need, are too.
    """
    strings = scratch.table(windows(items, window=window), "windows")
    total = strings.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("string")).alias("b")).first()
    shards = max(1, -(-total["n"] // shard_strings), -(-(total["b"] or 0) // shard_bytes))
    shard = F.pmod(F.xxhash64("string", "item"), F.lit(shards))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    for k in range(shards):
        if k:
            rows = scratch.table(rows, f"pass-{k}")
        shared = spark.sparkContext.broadcast(build([tuple(r) for r in strings.where(shard == k).select("string", "item").collect()]))
        rows = rows.mapInArrow(lambda it, shared=shared: _search_task(it, shared), f"doc_id {kind}, text string, n_words long, hits binary, items array<string>")
    found = rows.select("doc_id", "n_words", "hits", "items")
    return found.mapInArrow(_digest_task, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


ORACLE_SQL = f"""
WITH lower_docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_at AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM item_at),
lens AS (SELECT DISTINCT n FROM win),
doc_at AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lower_docs, lens WHERE len(w) >= n),
doc_win AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM doc_at),
hits AS (SELECT r, d.n, i, item_id FROM doc_win d JOIN win USING (n, s)),
hit_words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lower_docs LEFT JOIN hit_words USING (r) LEFT JOIN found USING (r)
"""

"""Phrases whose words stand together more often than chance: minimal perfect hashes over Apriori-safe candidates.

A phrase of frequent count has frequent words, and a triple two frequent pairs. So words are counted first; the
frequent ones of each language get ids by a minimal perfect hash, whose stored words are compared byte by byte,
and each text becomes an array of ids, with 0 for all else and between pieces. Pairs of ids that stand side by side are
candidates if the sums of their tasks reach the least count; a perfect hash over them numbers the pairs in the arrays;
triples follow from two numbered pairs in a row. A key is ids packed in 64 bits, so stored keys are compared as a whole.
Then mappers count words, pairs and triples by slot in arrays, which are summed as a tree, block by block, and the cuts
of each candidate read their counts by slot.

A table of keys is broadcast, so it holds a bounded number of them; of more keys each part has a pass of its own,
which carries the numbers that earlier passes have found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandwork.llm.common import Scratch
from strandwork.llm.perfect_hash import PerfectHash
from strandwork.llm.text import LOWER, U64, chunks, give_back, mix, spans, word_hashes

LEAST, SHARE, TOP = 10, 50, 2000
#: The score in whole numbers of up to 38 digits: counts stay below 10 ** 15.
SCORE = "(cast(1000000 as decimal(7,0)) * cast(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) as decimal(31,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))"
#: Keys in one broadcast table.
TABLE_KEYS = 1 << 21
#: Keys that a task gathers before it sorts them, and that one part of their sums may have.
RUN_KEYS, PART_KEYS = 1 << 20, 1 << 20
#: Slots in one block of counts, and blocks that one step of the tree adds.
BLOCK, FAN = 1 << 14, 16
#: Bytes of texts that are cut into words at once, and of words that are compared at once.
CHUNK = 1 << 18
#: Bytes of id arrays that a task works on at once.
SLICE = 1 << 21

#: Bytes that end a piece, and bytes that stand between words.
ENDS_PIECE = np.zeros(256, bool)
ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD = ~ENDS_PIECE
IN_WORD[[0x20, 0x09]] = False


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first word of each row, whether the next word is in the same piece)."""
    low = LOWER[data]
    starts, ends, first = spans(IN_WORD[low], offsets)
    piece = np.cumsum(ENDS_PIECE[low], dtype=np.int64)[starts] if len(starts) else starts
    together = np.r_[piece[1:] == piece[:-1], False] if len(starts) else np.zeros(0, bool)
    together[first[1:][first[1:] > 0] - 1] = False
    return low, starts, ends, first, together


def _gather(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    return data[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """(first, last, bytes, offsets, languages) of chunks of (lang, text) rows."""
    for a, b, data, offsets in chunks(batch.column(1), CHUNK):
        yield a, b, data, offsets, batch.column(0).slice(a, b - a).to_pylist()


def _named(hashes: np.ndarray, first: np.ndarray, langs: list[str]) -> np.ndarray:
    """Hashes of (language, word)."""
    of = np.array([_lang_hash(x) for x in langs], U64)
    return mix(hashes ^ np.repeat(of, np.diff(first)))


def _word_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each chunk; a row without a word has the number of all words."""
    for batch in batches:
        for _, _, data, offsets, langs in _rows(batch):
            low, starts, ends, first, _ = _words(data, offsets)
            if not len(starts):
                continue
            _, at, n = np.unique(_named(word_hashes(low, starts, ends), first, langs), return_index=True, return_counts=True)
            length = (ends - starts)[at]
            words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(_gather(low, starts[at], length)))
            of = np.array(langs, object)[np.searchsorted(first, at, "right") - 1]
            totals: dict[str, int] = {}
            for lang, k in zip(langs, np.diff(first).tolist()):
                totals[lang] = totals.get(lang, 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([*of, *totals], pa.string()), pa.concat_arrays([words.cast(pa.string()), pa.nulls(len(totals), pa.string())]), pa.array(np.r_[n, np.array([*totals.values()])].astype(np.int64))], ["lang", "word", "n"])
        give_back()


class WordTable:
    """Ids of frequent words of each language, from `first` on."""

    def __init__(self, langs: list[str], words: list[str], first: int):
        self.first, self.langs = first, {x: k for k, x in enumerate(sorted(set(langs)))}
        raw = [w.encode() for w in words]
        ends = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        hashes = word_hashes(data, ends[:-1], ends[1:]) if len(raw) else np.zeros(0, U64)
        keys = mix(hashes ^ np.array([_lang_hash(x) for x in langs], U64))
        self.hash = PerfectHash(keys)
        order = np.empty(len(keys), np.int64)
        order[self.hash.slots(keys)] = np.arange(len(keys))
        length = np.diff(ends)[order]
        self.start, self.length = np.cumsum(length) - length, length
        self.data = _gather(data, ends[:-1][order], length)
        self.lang = np.array([self.langs[x] for x in langs], np.int32)[order]

    def ids(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, langs: list[str]) -> np.ndarray:
        """The id of each word, 0 if it has none here."""
        slot = self.hash.slots(_named(word_hashes(low, starts, ends), first, langs))
        lang = np.repeat(np.array([self.langs.get(x, -1) for x in langs], np.int32), np.diff(first))
        length = ends - starts
        maybe = np.flatnonzero(slot >= 0)
        maybe = maybe[(self.length[slot[maybe]] == length[maybe]) & (self.lang[slot[maybe]] == lang[maybe])]
        n = length[maybe]
        differ = _gather(low, starts[maybe], n) != _gather(self.data, self.start[slot[maybe]], n)
        same = maybe[np.bincount(np.repeat(np.arange(len(maybe)), n)[differ], minlength=len(maybe)) == 0]
        out = np.zeros(len(starts), np.uint32)
        out[same] = self.first + slot[same]
        return out


class KeyTable:
    """Numbers of 64-bit keys, from `first` on."""

    def __init__(self, keys: np.ndarray, first: int):
        self.first, self.hash, self.keys = first, PerfectHash(keys), np.zeros(len(keys), np.int64)
        self.keys[self.hash.slots(keys)] = keys

    def ids(self, keys: np.ndarray) -> np.ndarray:
        slot = self.hash.slots(keys)
        found = np.flatnonzero(slot >= 0)
        found = found[self.keys[slot[found]] == keys[found]]
        out = np.zeros(len(keys), np.uint32)
        out[found] = self.first + slot[found]
        return out


def _binary(parts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Arrays of 32-bit numbers as one binary column."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(parts))]).cast(pa.binary())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows whose first column has about SLICE bytes; a long one is a run of its own."""
    for batch in batches:
        ends, first = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while first < len(batch):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SLICE, "right")))
            yield batch.slice(first, last - first)
            first = last
        give_back()


def _numbers(column: pa.Array) -> np.ndarray:
    """All 32-bit numbers of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint32) if data is not None and len(column) else np.zeros(0, np.uint32)


def _encode_task(batches: Iterator[pa.RecordBatch], shared, more: bool) -> Iterator[pa.RecordBatch]:
    """Ids of (lang, text[, ids]) rows, a 0 at the end of each piece; with `more` the texts stay."""
    table: WordTable = shared.value
    for batch in batches:
        carried = batch.schema.get_field_index("ids")
        for a, b, data, offsets, langs in _rows(batch):
            low, starts, ends, first, together = _words(data, offsets)
            at = np.arange(len(starts)) + np.cumsum(~together) - ~together
            total = np.r_[0, np.cumsum(~together)][first[1:]] + first[1:]
            ids = np.zeros(int(total[-1]), np.uint32)
            ids[at] = table.ids(low, starts, ends, first, langs)
            if carried >= 0:
                ids = np.maximum(ids, _numbers(batch.column(carried).slice(a, b - a)))
            column = _binary(ids, total)
            if more:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), column], ["lang", "text", "ids"])
            else:
                yield pa.RecordBatch.from_arrays([column], ["ids"])
        give_back()


def _packed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(U64) << U64(32) | low.astype(U64)).view(np.int64)


def _pair_keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the pairs of ids."""
    ids = columns[0]
    at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
    return at, _packed(ids[at], ids[at + 1])


def _triple_keys(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of two numbered pairs in a row: the first one's number and the last word's id."""
    ids, pairs = columns
    at = np.flatnonzero((pairs[:-1] != 0) & (pairs[1:] != 0))
    return at, _packed(pairs[at], ids[at + 2])


Keys = Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]


def _run_task(batches: Iterator[pa.RecordBatch], keys: Keys, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, keys, counts): sorted runs of the keys of this task, dealt by their hash."""
    held, n = [], 0

    def flushed() -> pa.RecordBatch:
        key, count = np.unique(np.concatenate(held), return_counts=True)
        part = (mix(key.view(U64)) % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        key, count, part = key[order], count[order].astype("<u4"), part[order]
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        ends = np.r_[cut[1:], len(part)]
        columns = [pa.array(part[cut].astype(np.int32)), pa.array([key[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()), pa.array([count[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "keys", "counts"])

    for batch in _slices(batches):
        held.append(keys([_numbers(c) for c in batch.columns])[1])
        n += len(held[-1])
        if n >= RUN_KEYS:
            yield flushed()
            held, n = [], 0
    if n:
        yield flushed()


def _merge_task(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(key) of the keys whose counts over all runs of their part reach `least`; rows come in order of part."""
    part, keys, counts = None, [], []

    def merged() -> pa.RecordBatch:
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, np.concatenate(counts), len(key))  # far below 2 ** 53, where doubles are exact
        return pa.RecordBatch.from_arrays([pa.array(key[total >= least])], ["key"])

    for batch in batches:
        for p, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            if p != part and keys:
                yield merged()
                keys, counts = [], []
            part = p
            keys.append(np.frombuffer(k.as_buffer(), np.int64))
            counts.append(np.frombuffer(c.as_buffer(), "<u4"))
        give_back()
    if keys:
        yield merged()


def frequent_keys(rows: DataFrame, keys: Keys, words: int, least: int) -> DataFrame:
    """The keys of all rows whose number over all of them reaches `least`; `words` bounds the number of all keys."""
    parts = max(8, -(-words // PART_KEYS))
    runs = rows.mapInArrow(lambda it: _run_task(it, keys, parts), "part int, keys binary, counts binary")
    dealt = runs.repartitionByRange(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(lambda it: _merge_task(it, least), "key long")


def _lookup_task(batches: Iterator[pa.RecordBatch], keys: Keys, shared, carried: bool) -> Iterator[pa.RecordBatch]:
    """(ids, pairs): the number of the pair that begins at each place; with `carried` the last column has earlier ones."""
    table: KeyTable = shared.value
    for batch in _slices(batches):
        columns = [_numbers(c) for c in batch.columns]
        at, key = keys(columns[:1])
        out = columns[1].copy() if carried else np.zeros(len(columns[0]), np.uint32)
        found = table.ids(key)
        out[at[found > 0]] = found[found > 0]
        ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64) // 4)
        yield pa.RecordBatch.from_arrays([batch.column(0), _binary(out, ends)], ["ids", "pairs"])


def _number_task(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        number = shared.value.ids(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.int64)
        here = number > 0
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(here)), pa.array(number[here])], ["key", "id"])


def _word_number_task(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [w.encode() for w in batch.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, raw)])
        number = shared.value.ids(np.frombuffer(b"".join(raw), np.uint8), ends[:-1], ends[1:], np.arange(len(raw) + 1), batch.column(0).to_pylist()).astype(np.int64)
        here = pa.array(number > 0)
        yield pa.RecordBatch.from_arrays([*(c.filter(here) for c in batch.columns[:2]), pa.array(number).filter(here)], ["lang", "word", "id"])


def _count_task(batches: Iterator[pa.RecordBatch], shared, ranges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(kind, block, source, counts): occurrences by slot of words, pairs and triples, of the numbers in this pass's ranges."""
    from pyspark import TaskContext

    table, source = shared.value, TaskContext.get().partitionId()
    counts = [np.zeros(high - low, np.int64) for low, high in ranges]
    for batch in _slices(batches):
        columns = [_numbers(c) for c in batch.columns]
        triples = table.ids(_triple_keys(columns)[1])
        for (low, high), total, found in zip(ranges, counts, [*columns, triples]):
            inside = found[(found >= low) & (found < high)] if high > low else found[:0]
            if len(inside):
                if len(inside) * 8 < len(total):
                    at, n = np.unique(inside, return_counts=True)
                    total[at - low] += n
                else:
                    total += np.bincount(inside - low, minlength=len(total))
    for kind, ((low, _), total) in enumerate(zip(ranges, counts)):
        for at in range(0, len(total), BLOCK):
            if (block := total[at : at + BLOCK]).any():
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([low + at], pa.int64()), pa.array([source], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["kind", "first", "source", "counts"])


def _sum_blocks(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table["counts"])
    return pa.table({"kind": table["kind"][:1], "first": table["first"][:1], "source": pa.array([table["source"][0].as_py() // FAN], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


def _slot_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for kind, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
            n = np.frombuffer(raw.as_buffer(), np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(first + at), pa.array(n[at])], ["kind", "id", "n"])


def tree_sum(blocks: DataFrame, sources: int) -> DataFrame:
    """(kind, id, n) from blocks of counts of so many sources; a step adds at most FAN blocks of bounded size."""
    while sources > 1:
        blocks = blocks.groupBy("kind", "first", F.floor(F.col("source") / FAN).alias("to")).applyInArrow(_sum_blocks, blocks.schema)
        sources = -(-sources // FAN)
    return blocks.mapInArrow(_slot_task, "kind int, id long, n long")


class Tables:
    """Broadcast tables of at most TABLE_KEYS keys, one after the other, and the keys with their numbers."""

    def __init__(self, spark: SparkSession, keys: DataFrame, scratch: Scratch, name: str, limit: int):
        self.spark, self.scratch, self.name, self.keys, self.n = spark, scratch, name, keys, keys.count()
        self.shards = max(1, -(-self.n // limit))
        self.ranges: list[tuple[int, int]] = []

    def each(self) -> Iterator[tuple[int, object]]:
        """(shard, broadcast table); numbers of a shard follow those of the one before, from 1."""
        first = 1
        by = F.pmod(F.xxhash64(*self.keys.columns), F.lit(self.shards))
        self.numbered = []
        for k in range(self.shards):
            mine = self.keys.where(by == k)
            found = mine.toArrow()
            if "word" in self.keys.columns:
                table, task, kinds = WordTable(found["lang"].to_pylist(), found["word"].to_pylist(), first), _word_number_task, "lang string, word string, id long"
            else:
                table, task, kinds = KeyTable(found["key"].to_numpy(), first), _number_task, "key long, id long"
            shared = self.spark.sparkContext.broadcast(table)
            self.ranges.append((first, first + len(found)))
            first += len(found)
            numbers = mine.select(*[f.split()[0] for f in kinds.split(", ")[:-1]]).mapInArrow(lambda it, task=task, shared=shared: task(it, shared), kinds)
            self.numbered.append(self.scratch.table(numbers, f"{self.name}-numbers-{k}"))
            yield k, shared

    def numbers(self) -> DataFrame:
        out = self.numbered[0]
        for more in self.numbered[1:]:
            out = out.unionByName(more)
        return out


def counted(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, lang_col: str, text_col: str, least: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Frequent words (id, lang, word, f), pairs (id, a, b, f), triples (id, pair, c, f), and (lang, n) of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    tallied = rows.mapInArrow(_word_task, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    tallied = scratch.table(tallied.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    totals = tallied.where("word is null").select("lang", "n")
    words = int(totals.agg(F.sum("n")).first()[0] or 0)
    vocabulary = Tables(spark, tallied.where("word is not null").select("lang", "word"), scratch, "words", limit)
    for k, shared in vocabulary.each():
        more = k + 1 < vocabulary.shards
        rows = scratch.table(rows.mapInArrow(lambda it, shared=shared, more=more: _encode_task(it, shared, more), "lang string, text string, ids binary" if more else "ids binary"), f"encoded-{k}")
        if k:
            scratch.drop(f"encoded-{k - 1}")
    pairs = Tables(spark, scratch.table(frequent_keys(rows, _pair_keys, words, least), "pairs"), scratch, "pairs", limit)
    encoded = f"encoded-{vocabulary.shards - 1}"
    for k, shared in pairs.each():
        rows = scratch.table(rows.mapInArrow(lambda it, shared=shared, carried=k > 0: _lookup_task(it, _pair_keys, shared, carried), "ids binary, pairs binary"), f"paired-{k}")
        scratch.drop(f"paired-{k - 1}" if k else encoded)
    triples = Tables(spark, scratch.table(frequent_keys(rows, _triple_keys, words, least), "triples"), scratch, "triples", limit)
    found: list[DataFrame] = []
    passes = list(triples.each())
    nothing = spark.sparkContext.broadcast(KeyTable(np.zeros(0, np.int64), 1))
    for k in range(max(vocabulary.shards, pairs.shards, triples.shards)):
        ranges = [(t.ranges[k] if k < t.shards else (0, 0)) for t in (vocabulary, pairs, triples)]
        shared = passes[k][1] if k < triples.shards else nothing
        blocks = scratch.table(rows.mapInArrow(lambda it, shared=shared, ranges=ranges: _count_task(it, shared, ranges), "kind int, first long, source int, counts binary"), f"blocks-{k}")
        sources = (blocks.agg(F.max("source")).first()[0] or 0) + 1
        found.append(scratch.table(tree_sum(blocks, sources), f"counts-{k}"))
        scratch.drop(f"blocks-{k}")
    scratch.drop(f"paired-{pairs.shards - 1}")
    counts = found[0]
    for more in found[1:]:
        counts = counts.unionByName(more)
    of = lambda kind: counts.where(F.col("kind") == kind).select("id", F.col("n").alias("f"))
    high, low = F.shiftrightunsigned("key", 32), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF))
    return (
        vocabulary.numbers().join(of(0), "id").select("id", "lang", "word", "f"),
        pairs.numbers().join(of(1), "id").select("id", high.alias("a"), low.alias("b"), "f"),
        triples.numbers().join(of(2), "id").select("id", high.alias("pair"), low.alias("c"), "f"),
        totals,
    )


def mine(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, share: int = SHARE, top: int = TOP, limit: int = TABLE_KEYS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` phrases of two or three words of each language.

    A null language is `und`, a null text empty; texts without a word count nothing. `a` is how often the phrase occurs, at
    least `least` times; `l` and `r` how often the parts of its lowest-scoring cut do, the cut after fewer words on ties; `n` all
    words of the language. A phrase inside a longer one with at least `share` percent of its count is dropped. Ties
    in rank go by `a` and then by the phrase's bytes. Repeated rows count again; an empty table gives no rows; other columns are
    not read. A text is cut into words whole, by one task.
    """
    words, pairs, triples, totals = counted(spark, docs, scratch, lang_col=lang_col, text_col=text_col, least=least, limit=limit)
    words = scratch.table(words, "word-counts")
    w = lambda k: words.select(F.col("id").alias(k), F.col("word").alias(f"word_{k}"), F.col("f").alias(f"f_{k}"), *([F.col("lang")] if k == "a" else []))
    pairs = scratch.table(pairs.join(w("a"), "a").join(w("b"), "b").withColumnRenamed("f", "f_ab"), "pair-counts")
    first = pairs.select(F.col("id").alias("pair"), "a", "b", "f_ab", "f_a", "lang", "word_a", "word_b")
    second = pairs.select(F.col("id").alias("pair_bc"), F.col("a").alias("b"), F.col("b").alias("c"), F.col("f_ab").alias("f_bc"))
    long = scratch.table(triples.withColumnRenamed("f", "f_abc").join(first, "pair").join(second, ["b", "c"]).join(w("c"), "c"), "triple-counts")
    covers = long.select(F.col("pair").alias("id"), "f_abc").unionByName(long.select(F.col("pair_bc").alias("id"), "f_abc")).groupBy("id").agg(F.max("f_abc").alias("cover"))
    kept = pairs.join(covers, "id", "left").where(F.coalesce(F.col("cover") * 100 < F.col("f_ab") * share, F.lit(True)))
    cut = lambda a, left, right, k: F.struct(F.expr(SCORE.format(a=a, l=left, r=right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    two = kept.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("f_ab").alias("a"), cut("f_ab", "f_a", "f_b", 1).alias("c"))
    three = long.select("lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("f_abc").alias("a"), F.least(cut("f_abc", "f_a", "f_bc", 1), cut("f_abc", "f_ab", "f_c", 2)).alias("c"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    scored = two.unionByName(three).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f, string_split(phrase, ' ') AS p FROM g GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, j, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.p[1 : c.j], ' ') AND l.k = c.j
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.p[c.j + 1 :], ' ') AND r.k = c.k - c.j),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, j) = 1),
covers AS (
  SELECT lang, part, max(f) AS cover FROM (SELECT lang, f, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS part FROM f WHERE k = 3) GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN covers c ON b.k = 2 AND c.lang = b.lang AND c.part = b.phrase WHERE c.cover IS NULL OR 100 * c.cover < {SHARE} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""

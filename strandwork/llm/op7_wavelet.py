"""Token-id output as one wavelet matrix per shard.

A shard holds the ids of consecutive documents as 16 bit-planes. In plane k every id has the k-th bit from the
top, in the order that the planes above have sorted the ids into (zeros first, stably). A directory of the ones in
each 512 bits gives rank, a search in it gives select. With these the one blob answers what the id at a place is,
how often an id occurs in a range, and where its n-th occurrence is. The file also holds the documents' ids and
lengths. Planes are compressed in blocks, so a query inflates only the blocks that it touches.

File: magic, header length, JSON header, document ids, which of them are null, document lengths, the directory of all
planes, then the blocks of all planes; all but the first three are compressed, and the header has their sizes.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandwork.llm import tokens
from strandwork.llm.common import Scratch

BITS = 16
#: Bits under one rank count, and bytes of a plane under one compressed block.
RANK_BITS, BLOCK_BYTES = 512, 1 << 14
#: Ids after which a shard is closed.
SHARD_TOKENS = 1 << 21
MAGIC = b"WVM2"


def build(ids: np.ndarray, doc_ids: list[int | None] = (), lengths: list[int] = ()) -> bytes:
    """The file of ids, and of the ids and lengths of the documents that they belong to."""
    import zstandard

    compress, blobs, planes, counts = zstandard.ZstdCompressor(level=1).compress, [], [], []
    order = ids.astype(np.uint16)
    for k in range(BITS):
        bit = (order & np.uint16(1 << (BITS - 1 - k))) != 0
        packed = np.packbits(bit)
        blocks = [compress(packed[i : i + BLOCK_BYTES].tobytes()) for i in range(0, len(packed), BLOCK_BYTES)]
        padded = np.zeros(-(-len(packed) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        padded[: len(packed)] = packed
        counts.append(np.bitwise_count(padded.reshape(-1, RANK_BITS // 8)).sum(1, dtype=np.uint16))
        planes.append([len(b) for b in blocks])
        blobs += blocks
        order = np.concatenate([order[~bit], order[bit]])
    known = [0 if i is None else i for i in doc_ids]
    tables = [np.array(known, "<i8"), np.array([i is None for i in doc_ids], np.uint8), np.array(lengths, "<i8"), np.concatenate(counts).astype("<u2")]
    tables = [compress(t.tobytes()) for t in tables]
    header = json.dumps({"n": len(ids), "tables": [len(t) for t in tables], "planes": planes}, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *tables, *blobs])


class WaveletMatrix:
    """Reads a file of `build`: access, rank, select and counts without unpacking the rest of it."""

    def __init__(self, blob: bytes):
        import zstandard

        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        (size,) = struct.unpack_from("<I", blob, 4)
        header = json.loads(blob[8 : 8 + size])
        self.blob, self.n, self._inflate, self._cache = blob, header["n"], zstandard.ZstdDecompressor().decompress, {}
        at, tables = 8 + size, []
        for length in header["tables"]:
            tables.append(self._inflate(blob[at : at + length]))
            at += length
        self.doc_ids, self.doc_null = np.frombuffer(tables[0], "<i8"), np.frombuffer(tables[1], np.uint8).view(bool)
        self.lengths = np.frombuffer(tables[2], "<i8")
        counts = np.frombuffer(tables[3], "<u2").reshape(BITS, -1)
        self.before = np.zeros((BITS, counts.shape[1] + 1), np.int64)  # ones before each RANK_BITS of a plane
        np.cumsum(counts, axis=1, out=self.before[:, 1:])
        self.zeros = self.n - self.before[:, -1]
        self.places = []
        for sizes in header["planes"]:
            ends = at + np.cumsum(sizes, dtype=np.int64)
            self.places.append(list(zip([at, *ends[:-1].tolist()], ends.tolist())) if sizes else [])
            at = int(ends[-1]) if sizes else at

    def _rows(self, k: int, b: int) -> np.ndarray:
        """Bytes of a block, RANK_BITS a row."""
        if (k, b) not in self._cache:
            start, end = self.places[k][b]
            raw = self._inflate(self.blob[start:end], max_output_size=BLOCK_BYTES)
            rows = np.zeros(BLOCK_BYTES, np.uint8)
            rows[: len(raw)] = np.frombuffer(raw, np.uint8)
            self._cache[k, b] = rows.reshape(-1, RANK_BITS // 8)
        return self._cache[k, b]

    def _gather(self, k: int, units: np.ndarray) -> np.ndarray:
        """The row of each number of RANK_BITS of plane k."""
        width = BLOCK_BYTES * 8 // RANK_BITS
        out = np.zeros((len(units), RANK_BITS // 8), np.uint8)
        for b in np.unique(units // width):
            here = units // width == b
            out[here] = self._rows(k, int(b))[units[here] % width]
        return out

    def rank1(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane k before each place."""
        unit, rest = np.divmod(at, RANK_BITS)
        found = self.before[k][unit]
        inside = np.flatnonzero(rest)
        if len(inside):
            rows, byte, bit = self._gather(k, unit[inside]), rest[inside] >> 3, rest[inside] & 7
            whole = np.bitwise_count(rows) * (np.arange(RANK_BITS // 8) < byte[:, None])
            part = np.bitwise_count(rows[np.arange(len(rows)), byte] & ((0xFF00 >> bit) & 0xFF).astype(np.uint8))
            found[inside] += whole.sum(1, dtype=np.int64) + part
        return found

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for k in range(BITS):
            rows, rest = self._gather(k, at // RANK_BITS), at % RANK_BITS
            bit = rows[np.arange(len(rows)), rest >> 3] >> (7 - (rest & 7)) & 1
            ones = self.rank1(k, at)
            value = value << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return value

    def counts(self, value: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of an id in each [start, end)."""
        lo, hi = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        for k in range(BITS):
            a, b = self.rank1(k, lo), self.rank1(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if value >> (BITS - 1 - k) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of an id in [start, end)."""
        return int(self.counts(value, np.array([start]), np.array([self.n if end is None else end]))[0])

    def select(self, value: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of an id, or -1."""
        lo, total = np.zeros(1, np.int64), self.count(value)
        if not 0 <= j < total:
            return -1
        for k in range(BITS):
            ones = self.rank1(k, lo)
            lo = self.zeros[k] + ones if value >> (BITS - 1 - k) & 1 else lo - ones
        i = int(lo[0]) + j
        for k in reversed(range(BITS)):
            bit = value >> (BITS - 1 - k) & 1
            i = self._select(k, bit, i - int(self.zeros[k]) if bit else i)
        return i

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place in plane k of the j-th (from 0) bit of this value."""
        ones = self.before[k]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * RANK_BITS, self.n) - ones
        unit = int(np.searchsorted(counts, j, "right")) - 1
        bits = np.unpackbits(self._gather(k, np.array([unit]))[0])[: self.n - unit * RANK_BITS]
        return unit * RANK_BITS + int(np.flatnonzero(bits == bit)[j - int(counts[unit])])

    def decode(self) -> np.ndarray:
        """All ids. From the last plane up, each plane's bits tell which of the sorted ids go where."""
        order = np.zeros(self.n, np.uint16)
        for k in reversed(range(BITS)):
            packed = [self._rows(k, b).ravel() for b in range(len(self.places[k]))]
            bit = np.unpackbits(np.concatenate(packed), count=self.n).view(bool) if packed else np.zeros(0, bool)
            above = np.empty_like(order)
            above[~bit], above[bit] = order[: self.zeros[k]], order[self.zeros[k] :] | np.uint16(1 << (BITS - 1 - k))
            order = above
        return order


SHARD_SCHEMA = "part int, shard int, n_tokens long, file binary"


def _shard_task(batches: Iterator[pa.RecordBatch], shard_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, shard, ids, doc_ids, total = TaskContext.get().partitionId(), 0, [], [], 0

    def close() -> pa.RecordBatch:
        row = {"part": part, "shard": shard, "n_tokens": total, "file": build(np.concatenate(ids), doc_ids, [len(x) for x in ids])}
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("file", pa.binary())])
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(np.frombuffer(raw.as_buffer(), np.uint16))
            doc_ids.append(doc_id)
            total += len(ids[-1])
            if total >= shard_tokens:
                yield close()
                shard, ids, doc_ids, total = shard + 1, [], [], 0
    if ids:
        yield close()


def _encode_task(batches: Iterator[pa.RecordBatch], path: str | None, end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            part = batch.slice(at, 1024)
            ids = pa.array([x.tobytes() for x in tokens.encode_column(part.column(1), path, end_id)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])


def write_shards(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = tokens.END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write all documents in ascending id order as shards (part, shard, n_tokens, file).

    Texts are encoded once into a scratch table, range-partitioned by id and cut into shards of about
    `shard_tokens` ids; a document is never split. Null texts are empty, null ids come first, rows with equal
    ids follow each other by a hash of their tokens, an empty table gives no shards. Returns the table read back.
    """
    encoded = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda it: _encode_task(it, tokenizer_path, end_id), "doc_id long, ids binary")
    encoded = scratch.table(encoded, "encoded")
    total = encoded.agg(F.sum(F.length("ids")) / 2).first()[0] or 0
    parts = max(8, int(total // (4 * shard_tokens)) + 1)
    order = [F.col("doc_id"), F.xxhash64("ids"), F.col("ids")]  # many rows of one id, or of none, are not one task's
    by_id = encoded.repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    shards = scratch.table(by_id.mapInArrow(lambda it: _shard_task(it, shard_tokens), SHARD_SCHEMA), "shards")
    scratch.drop("encoded")
    return shards


def _digest_task(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, file in zip(*batch.columns):
            matrix = WaveletMatrix(file.as_py())
            ends = np.cumsum(matrix.lengths)
            starts, ids = ends - matrix.lengths, matrix.decode()
            crc = [tokens.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
            closed = matrix.access(ends - 1) == end_id
            same = [pa.array([x.as_py()] * len(ends), pa.int32()) for x in (part, shard)]
            columns = [pa.array(matrix.doc_ids, mask=matrix.doc_null), *(pa.array(c) for c in (starts, matrix.lengths, crc, matrix.counts(end_id, starts, ends), closed))]
            yield pa.RecordBatch.from_arrays([*same, *columns], ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32", "n_end_ids", "closed"])


def read_digests(shards: DataFrame, *, end_id: int = tokens.END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, n_end_ids, closed) of every document, from the shards' files alone.

    All ids are decoded for the checksum; how often the end id occurs in a document, and whether it is the last, are
    counted and looked up by rank. Tokens before a shard: a running sum over the range partitions' totals (a row
    each) and one within each. They are joined to the digests, so that no file is shuffled.
    """
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "shard", (F.col("part_start") + F.col("within")).alias("shard_start"))
    rows = shards.select("part", "shard", "file").mapInArrow(lambda it: _digest_task(it, end_id), "part int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long, n_end_ids long, closed boolean")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids", "closed")

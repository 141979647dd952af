"""Exact set-similarity join on word shingles by universe partitioning.

Two sets of sizes p and q whose Jaccard similarity is at least t % differ in at most H = (100-t)(p+q)/(100+t)
elements. A band of sizes splits the universe of shingle hashes into m segments. If k of these are matched up
to one element and m - k exactly, with m + k = H + 1, any two linked sets match in some segment. A set is indexed
by the sum of its hashes in each segment, and in the k segments also by every sum less one element. Segments in
which a set has nothing would match by chance, so a layout has some more (its slack): a set with at most so many
of them matches any linked set elsewhere too, and does not index them. For each band, k and the slack are where the
expected cost of index entries and of chance matches is least.

Most sets of a corpus link with nothing, and need no index: of a set's least hashes, one more than may be missing
from a linked set plus some, that many at least are among the least hashes of another set, or the set is left out.
Of the others, sets with equal entries are candidates. In a few star rounds each set is compared with one other: the
set that is met most often among those with its entries, which in a family of near copies is what they were copied
from. What links is one component. Then the sets of different components that share an entry are compared, in blocks
of bounded size, and only pairs that may link leave a task: those whose 1024-bit parity sketches and sizes
allow it. Of these common hashes are counted, so the links are exact up to collisions of 64-bit hashes.
Exact copies are one set from the start, and no pair within a component is ever listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandwork.llm.common import Scratch
from strandwork.llm.components import components
from strandwork.llm.text import LOWER, U64, chunks, give_back, mix, shingles

WORDS, PERCENT = 3, 90
#: Least ratio of a band's largest to its smallest size.
BAND_RATIO = 1.35
#: Cost of comparing a chance match, in index entries, and the part of them that the slack cannot spare.
MATCH_COST, STRAY = 0.5, 0.02
SKETCH_WORDS = 16
#: Star rounds before all pairs of different components that are left.
STARS = 2
#: Members of an entry in one block, and hashes that are indexed at once.
BLOCK, INDEX_HASHES = 512, 1 << 17
#: Rows of 8 bytes that may be sent to all executors; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Pairs whose sketches a task compares at once.
PAIRS_AT_ONCE = 1 << 14
_SEGMENT, _LAYOUT = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Layout:
    """How the sets of a band, and those of the band below that it can link to, are indexed."""

    low: int
    high: int
    segments: int
    deletions: int
    slack: int = 0


def bands(percent: int) -> np.ndarray:
    """Smallest size of each band; the last lies beyond any text."""
    ratio, lows = max(BAND_RATIO, 100 / percent), [1]
    while lows[-1] < 1 << 40:
        lows.append(max(lows[-1], math.floor(lows[-1] * ratio)) + 1)
    return np.array(lows, np.int64)


def allocate(low: int, high: int, sets: int, percent: int, deletions: int | None = None) -> Layout:
    """The split of H + 1 into exact and one-deletion segments, and the slack, that cost least for so many sets."""
    most = 2 * high * (100 - percent) // (100 + percent)
    if most == 0:
        return Layout(low, high, 0, 0)
    least = max(1, -(-low * percent // 100))

    def layout(k: int, slack: int) -> tuple[float, int]:
        m = most + 1 + slack - k
        mean = least / m
        empty, few = math.exp(-mean), math.exp(-mean) * (1 + mean)
        expected = (m - k) * empty + 2 * k * few  # weight of the segments with nothing to match by
        spread = math.sqrt((m - k) * empty * (1 - empty) + 4 * k * few * (1 - few))
        beyond = 0.5 * math.erfc((slack + 1 - expected) / max(spread, 1e-9) / math.sqrt(2))
        chance = ((m - k) + k * (1 + 2 * mean)) * math.exp(-2 * mean)
        return sets * (m + k * (low + high) / 2 / m) + MATCH_COST * sets * sets * chance * (beyond**2 + STRAY), math.ceil(expected + 3 * spread)

    best, top = None, (most + 1) // 2
    for k in sorted({top * i // 24 for i in range(25)}) if deletions is None else [min(deletions, top)]:
        slack = 0
        for _ in range(4):  # more segments have less in each, so the slack that is wanted grows
            cost, wanted = layout(k, slack)
            if best is None or cost < best[0]:
                best = cost, Layout(low, high, most + 1 + slack - k, k, slack)
            slack = max(slack, wanted)
    return best[1]


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each hash, hashes, set sizes, set keys) of chunks of texts."""
    for first, last, data, offsets in chunks(texts):
        row, value = shingles(LOWER[data], offsets, n)
        size = np.bincount(row, minlength=last - first)
        total = np.zeros(last - first, U64)
        np.add.at(total, row, mix(value))
        yield first, last - first, row, value, size, mix(total + size.astype(U64)).view(np.int64)


def _band(size: np.ndarray, lows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Band of each size, and whether sets of the next band are near enough to link."""
    band = np.searchsorted(lows, size, "right") - 1
    return band, 100 * size >= percent * lows[np.maximum(band, 0) + 1]


def _key_task(batches: Iterator[pa.RecordBatch], n: int, lows: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, rows, _, _, size, key in _sets(batch.column(1), n):
            band, up = _band(size, lows, percent)
            none = size == 0
            columns = [*(batch.column(c).slice(first, rows) for c in (0, 2)), pa.array(size), pa.array(key, mask=none), pa.array(band.astype(np.int32), mask=none), pa.array(up)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "same", "n", "key", "band", "up"])


def _spare(size: np.ndarray, percent: int) -> np.ndarray:
    """How many more of its least hashes a set is known by than a linked set may lack."""
    return size * (100 - percent) // 100 // 2 + 1


def _least_task(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(hash, key, met) of the least hashes of each set that this task meets for the first time.

    Hashes that several sets of a portion have leave it once, without a key; how many of these a set has is a row with `met`.
    """
    seen: set[int] = set()

    def portion(value: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(value)
        value, owner = value[order], owner[order]
        new = np.r_[True, value[1:] != value[:-1]][: len(value)]
        common = np.r_[~new[1:], False][: len(value)] | ~new
        keys, met = np.unique(owner[common], return_counts=True)
        hashes = np.concatenate([value[new].view(np.int64), keys])
        without = np.concatenate([common[new], np.zeros(len(keys), bool)])
        met = np.concatenate([np.zeros(int(new.sum()), np.int32), met.astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(np.concatenate([owner[new], keys]), mask=without), pa.array(met)], ["hash", "key", "met"])

    hashes, owners, held = [], [], 0
    for batch in batches:
        for _, rows, row, value, size, key in _sets(batch.column(0), n):
            wanted = np.zeros(rows, np.int64)
            for i in np.flatnonzero(size):
                if (k := int(key[i])) not in seen:
                    seen.add(k)
                    wanted[i] = size[i] * (100 - percent) // 100 + _spare(size[i], percent)
            rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
            taken = rank < wanted[row]
            hashes.append(value[taken])
            owners.append(key[row[taken]])
            held += len(hashes[-1])
            if held >= INDEX_HASHES:
                yield portion(np.concatenate(hashes), np.concatenate(owners))
                hashes, owners, held = [], [], 0
    if held:
        yield portion(np.concatenate(hashes), np.concatenate(owners))


def _index_task(batches: Iterator[pa.RecordBatch], lows: np.ndarray, percent: int, layouts: dict[int, Layout]) -> Iterator[pa.RecordBatch]:
    """(entry, key): the index entries of each set (key, n, hashes)."""
    segments, deletions, slack = (np.zeros(len(lows) + 1, np.int64) for _ in range(3))
    for b, layout in layouts.items():
        segments[b], deletions[b], slack[b] = layout.segments, layout.deletions, layout.slack
    for batch in batches:
        give_back()
        sizes, keys = batch.column(1).to_numpy(), batch.column(0).to_numpy()
        at = 0
        while at < len(batch):
            rows = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), INDEX_HASHES, "right")))
            size, key = sizes[at : at + rows], keys[at : at + rows]
            value = batch.column(2).slice(at, rows).flatten().to_numpy().view(U64)
            at += rows
            row = np.repeat(np.arange(len(size)), size)
            band, up = _band(size, lows, percent)
            for own, wanted in ((band, True), (band + 1, up)):
                m = np.where(wanted, segments[own], 0)
                base = np.cumsum(m) - m
                inside = m[row] > 0
                r, h = row[inside], value[inside]
                mixed = mix(h ^ _SEGMENT)
                segment = ((mixed >> U64(20)) % np.maximum(m[r], 1).astype(U64)).astype(np.int64)
                cell = base[r] + segment
                sums, held = np.zeros(int(m.sum()), U64), np.bincount(cell, minlength=int(m.sum()))
                np.add.at(sums, cell, mixed)
                of = np.repeat(np.arange(len(size)), m)
                number = np.arange(len(of)) - base[of]
                place = mix(own[of].astype(U64) * _LAYOUT + number.astype(U64))
                short = number < deletions[own][of]
                bare = held <= short  # segments by whose entry without an element sets of nothing in common match
                spared = (np.bincount(of, bare * (1 + short), len(size)) <= slack[own])[of]
                less = short[cell] & ~(spared[cell] & (held[cell] == 1))
                exact = ~(spared & (held == 0))
                c = cell[less]
                entry = np.concatenate([mix(sums[exact] ^ place[exact]), mix((sums[c] - mixed[less]) ^ place[c])])
                owner = key[np.concatenate([of[exact], r[less]])]
                if len(entry):
                    yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(owner)], ["entry", "key"])


def _set_task(batches: Iterator[pa.RecordBatch], n: int, lows: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """(key, n, band, up, hashes, sketch words) of the sets that this task meets for the first time."""
    seen: set[int] = set()
    for batch in batches:
        for first, rows, row, value, size, key in _sets(batch.column(0), n):
            ends = np.cumsum(size)
            keep = []
            for i in np.flatnonzero(size).tolist():
                if (k := int(key[i])) not in seen:
                    seen.add(k)
                    keep.append(i)
            bits = np.zeros((rows, SKETCH_WORDS * 64), np.uint8)
            np.bitwise_xor.at(bits, (row, (mix(value ^ _LAYOUT) % U64(SKETCH_WORDS * 64)).astype(np.int64)), 1)
            words = np.packbits(bits, axis=1).view(np.int64)
            kept = [value[ends[i] - size[i] : ends[i]].view(np.int64) for i in keep]
            band, up = _band(size[keep], lows, percent)
            sets = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size[keep])].astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))
            columns = [pa.array(key[keep]), pa.array(size[keep]), pa.array(band.astype(np.int32)), pa.array(up), sets, *(pa.array(words[keep, k]) for k in range(SKETCH_WORDS))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "band", "up", "hashes", *(f"w{k}" for k in range(SKETCH_WORDS))])


def _near(percent: int) -> F.Column:
    """Whether sizes and parity sketches of a row's sets x and y allow a link: each element that differs flips one bit."""
    c = F.col
    apart = F.aggregate(F.array(*[F.bit_count(c(f"x.w{k}").bitwiseXOR(c(f"y.w{k}"))) for k in range(SKETCH_WORDS)]), F.lit(0), lambda a, b: a + b)
    return F.greatest(apart, F.abs(c("x.n") - c("y.n"))) * (100 + percent) <= (c("x.n") + c("y.n")) * (100 - percent)


def _block_task(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, ra, rb): sets of two roots that meet in a group and may link.

    Rows (entry, p, q, block, key, root, n, sketch words) come in order of (entry, p, q). A group (entry, p, q) holds
    the members of two blocks of an entry, or of one if p is q, so it is of bounded size; it may span batches.
    """
    rest = np.zeros((0, 7 + SKETCH_WORDS), np.int64)

    def compared(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        start = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)])
        end = np.repeat(np.r_[start[1:], len(rows)], np.diff(np.r_[start, len(rows)]))
        after = end - np.arange(len(rows)) - 1  # how many of its group follow each row
        total, at = np.cumsum(after), 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            count = after[at:stop]
            left = np.repeat(np.arange(at, stop), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            at = stop
            other = (rows[left, 5] != rows[right, 5]) & ((rows[left, 1] == rows[left, 2]) | (rows[left, 3] != rows[right, 3]))
            x, y = rows[left[other]], rows[right[other]]
            apart = np.bitwise_count((x[:, 7:] ^ y[:, 7:]).view(U64)).sum(1, dtype=np.int64)  # of signed integers it would count the absolute value's bits
            least = np.maximum(apart, np.abs(x[:, 6] - y[:, 6]))
            near = least * (100 + percent) <= (x[:, 6] + y[:, 6]) * (100 - percent)
            x, y = x[near], y[near]
            swap = x[:, 4] > y[:, 4]
            x[swap], y[swap] = y[swap].copy(), x[swap].copy()
            if len(x):
                pairs = np.unique(np.stack([x[:, 4], y[:, 4], x[:, 5], y[:, 5]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(4)], ["a", "b", "ra", "rb"])

    for batch in batches:
        rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)])
        whole = np.flatnonzero((rows[:, :3] != rows[-1:, :3]).any(1))  # the last group may go on
        cut = int(whole[-1]) + 1 if len(whole) else 0
        yield from compared(rows[:cut])
        rest = rows[cut:].copy()
        give_back()
    yield from compared(rest)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of `pairs` whose sets a and b link, by their hashes."""
    x = sets.select(F.col("key").alias("a"), F.col("hashes").alias("x"))
    y = sets.select(F.col("key").alias("b"), F.col("hashes").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    links = (100 + percent) * common >= percent * (F.size("x") + F.size("y"))
    return pairs.join(x, "a").join(y, "b").where(links).select(*pairs.columns)


def similar_classes(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, deletions: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Words are lower-cased in A-Z only; a set is the distinct `words`-word shingles, or the whole sequence of fewer
    words. `component_id` is the least id that links reach; exact copies link. A null or wordless text has no
    shingle and stands alone under its own id. Null ids are not least unless no other is there. Rows with equal
    ids are joined by what their texts link; any number of rows may have one id, or none. Ids keep their type. An
    empty table gives no rows; other columns are not read. `deletions` fixes the number of one-deletion segments
    for tests. The result is a table in `scratch`, whose others are deleted.
    """
    lows = bands(percent)
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("same"))
    kind = source.schema["doc_id"].dataType.simpleString()
    keyed = scratch.table(source.mapInArrow(lambda it: _key_task(it, words, lows, percent), f"doc_id {kind}, same long, n long, key long, band int, up boolean"), "keyed")
    roots = _roots(spark, source.select("text", "same"), keyed.where("key is not null"), scratch, words, percent, lows, deletions)
    keys = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    rooted = keys.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("key", "component_id")
    out = keyed.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return scratch.last(out, "classes")


def _merged(roots: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, root) after the roots themselves have been merged."""
    top = merged.select(F.col("node").alias("r"), F.col("root").alias("top"))
    moved = roots.join(top, F.col("root") == F.col("r"), "left").select("node", F.coalesce("top", "root").alias("root"))
    return moved.unionByName(merged.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def _able(source: DataFrame, keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """(same) of a text of each set that can link to another by its least hashes."""
    by_hash = Window.partitionBy("hash")
    least = source.select("text").mapInArrow(lambda it: _least_task(it, words, percent), "hash long, key long, met int")
    other = F.max(F.col("key").isNull()).over(by_hash) | (F.min("key").over(by_hash) < F.max("key").over(by_hash))
    met = least.select("key", F.when(F.col("met") > 0, F.col("met")).otherwise(other.cast("int")).alias("met")).where("key is not null and met > 0")
    met = met.groupBy("key").agg(F.sum("met").alias("met"))
    sets = keyed.groupBy("key").agg(F.min("n").alias("n"), F.min("same").alias("same"))
    smallest = F.ceil(F.col("n") * percent / 100)
    return sets.join(met, "key").where(F.col("met") >= F.floor(F.floor(smallest * (100 - percent) / 100) / 2) + 1).select("same").distinct()


def _roots(spark: SparkSession, source: DataFrame, keyed: DataFrame, scratch: Scratch, words: int, percent: int, lows: np.ndarray, deletions: int | None) -> DataFrame:
    """(key, root) of the sets that link to another set."""
    able = scratch.table(_able(source, keyed, words, percent), "able")
    sketch = [f"w{k}" for k in range(SKETCH_WORDS)]
    few = able.count() <= BROADCAST_ROWS
    texts = source.join(F.broadcast(able) if few else able, "same").select("text")
    sets = texts.mapInArrow(lambda it: _set_task(it, words, lows, percent), "key long, n long, band int, up boolean, hashes array<long>, " + ", ".join(f"{w} long" for w in sketch)).dropDuplicates(["key"])
    sets = scratch.table(sets, "sets")
    scratch.drop("able")
    counted: dict[int, int] = {}
    for r in sets.groupBy("band", "up").count().collect():
        for b in (r["band"], *([r["band"] + 1] if r["up"] else [])):
            counted[b] = counted.get(b, 0) + r["count"]
    layouts = {b: allocate(int(lows[b]), int(lows[b + 1]) - 1, n, percent, deletions) for b, n in counted.items()}
    index = scratch.table(sets.select("key", "n", "hashes").mapInArrow(lambda it: _index_task(it, lows, percent, layouts), "entry long, key long"), "index")
    shared = index.groupBy("entry").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("met")).where("lo < hi").select("entry", "met")
    members = scratch.table(index.join(shared, "entry"), "members")
    scratch.drop("index")
    rank = scratch.table(members.groupBy("key").agg(F.sum("met").alias("rank")), "rank")
    about = sets.select("key", "n", *sketch)
    roots = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))  # a list's frame would start Python workers of its own
    for turn in range(STARS + 1):
        placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").join(rank, "key")
        placed = scratch.table(placed.select("entry", "key", "rank", F.coalesce("root", "key").alias("root"), F.ceil(F.col("met") / BLOCK).alias("blocks")), f"placed-{turn}")
        left = placed.groupBy("entry").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("entry")
        a = placed.join(left, "entry").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        if turn < STARS:  # another component each turn, in it the set met most often
            a = scratch.table(a, f"open-{turn}")
            first = F.lit(0) if turn == 0 else F.xxhash64("root", F.lit(turn))
            hubs = a.groupBy("entry").agg(F.max_by(F.struct("key", "root", "blocks"), F.struct(first, "rank", "key")).alias("h"))
            hubs = hubs.select("entry", "h.*").select("entry", F.col("key").alias("b"), F.col("root").alias("rb"), every)
            met = a.join(hubs.withColumnRenamed("other", "block"), ["entry", "block"]).where("root <> rb")
            pairs = met.groupBy(F.col("key").alias("a"), "b", F.col("root").alias("ra"), "rb").agg(F.count(F.lit(1)).alias("c"))
            near = pairs.join(about.alias("x"), F.col("a") == F.col("x.key")).join(about.alias("y"), F.col("b") == F.col("y.key")).where(_near(percent)).select("a", "b", "ra", "rb", "c")
            # of a set's hubs the one with most common entries
            near = near.groupBy("a", "ra").agg(F.max_by(F.struct("b", "rb"), F.struct("c", "b")).alias("h")).select("a", "h.b", "ra", "h.rb")
        else:
            two = a.join(about, "key").select("entry", "block", "key", "root", "n", *sketch, every)
            two = two.select("entry", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "key", "root", "n", *sketch)
            group = ["entry", "p", "q"]
            near = two.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda it: _block_task(it, percent), "a long, b long, ra long, rb long").distinct()
        near = scratch.table(near, f"pairs-{turn}")
        scratch.drop(f"placed-{turn}", f"open-{turn}")
        linked = scratch.table(_linked(near, sets, percent).select(F.col("ra").alias("a"), F.col("rb").alias("b")), f"linked-{turn}")
        if not linked.isEmpty():
            roots = scratch.table(_merged(roots, components(linked, scratch, f"turn-{turn}")), f"roots-{turn}")
        scratch.drop(f"pairs-{turn}", f"linked-{turn}")
    return roots.withColumnRenamed("node", "key")

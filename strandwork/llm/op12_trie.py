"""Prefix trie of conversations, built level by level.

At each depth the live conversations are grouped by (parent node, next turn); a group is a node, named by its
least conv_id. Only conversations that share their node stay live: one that is alone has its own turns as a chain
of nodes below it, which needs no grouping. When no node is shared any more, counts of children and leaves and
savings are summed from the deepest shared level up, one join a level. The number of levels is thus the longest prefix that
two conversations share, not the longest conversation.

A node may have a third of all conversations. Groups are counted before they are shuffled; nodes of very many members
are joined to them by a broadcast whose rows are bounded by that number; the digest of the members that end at a
node reads sorted packs of ids one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.llm.common import Scratch
from strandwork.operators.scans import places

#: Keys of more rows than this, and than a HOT_KEYS-th of all rows, are joined by a broadcast of at most HOT_KEYS rows.
HOT_ROWS, HOT_KEYS = 1000, 50_000
#: Ids in one pack of those that end at a node.
PACK = 512
NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_places(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, h1, h2, n_bytes) of each turn: its place from 1, two hashes of role and text, bytes of the text.

    Turns go by number, null first, equal numbers by role and text; null roles and texts are empty. Rows without an id
    belong to no conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    placed = places(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"])
    return placed.select("conv", "place", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), F.struct("text", "role")).alias("h2"), F.octet_length("text").cast("long").alias("n_bytes"))


def beside(rows: DataFrame, table: DataFrame, keys: list[str], n: str, total: int, most: int | None = None) -> DataFrame:
    """Rows of a key that `table` has, with its columns; its `n` is how many rows a key has, `total` the sum of all.

    At most HOT_KEYS keys have more than `hot` rows, so these are broadcast and no task gets more than `hot` rows of a key.
    Where `most`, the greatest `n`, is known and no key has so many, there is nothing to broadcast.
    """
    hot = max(HOT_ROWS, total // HOT_KEYS)
    if most is not None and most <= hot:
        return rows.join(table, keys).select(*rows.columns, *[c for c in table.columns if c not in keys])
    rest = [c for c in table.columns if c not in keys]
    many = table.where(F.col(n) > hot).select(*keys, F.struct(*rest).alias("_many"))
    tried = rows.join(F.broadcast(many), keys, "left")
    found = tried.where("_many is not null").select(*rows.columns, *[F.col(f"_many.{c}").alias(c) for c in rest])
    few = tried.where("_many is null").select(*rows.columns).join(table.where(F.col(n) <= hot), keys)
    return found.unionByName(few.select(*rows.columns, *rest))


def rebuilt(turns: DataFrame, scratch: Scratch, *, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv, length) of conversations that begin like the first of their family.

    Conversation c takes the first h turns of c - c % family (all if it has fewer, none if it is absent), then its own after the
    first h; h is the CRC-32 of c in decimal, modulo `most`.
    """
    ids = scratch.table(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")), "ids")
    total = ids.agg(F.sum("own")).first()[0] or 0
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    heads = ids.select("conv", "own", (F.col("conv") - F.col("conv") % family).alias("base"), head.alias("h"))
    bases = ids.select(F.col("conv").alias("base"), F.col("own").alias("held"))
    heads = scratch.table(heads.join(bases, "base", "left").select("conv", "own", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("kept")), "heads")
    first = heads.select("conv", "base", "h").join(turns.where(F.col("place") < most).withColumnRenamed("conv", "base"), "base").where("place <= h")
    first = first.select("conv", F.col("place").alias("depth"), "h1", "h2", "n_bytes")
    after = beside(turns, heads.select("conv", "own", "h", "kept"), ["conv"], "own", total).where("place > h")
    after = after.select("conv", (F.col("kept") + F.col("place") - F.col("h")).alias("depth"), "h1", "h2", "n_bytes")
    return first.unionByName(after), heads.select("conv", (F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of ids from rows in order of (depth, node, conv); a node may go on in the next pack."""
    key, ids, out = None, [], []

    def flushed() -> pa.RecordBatch:
        depth, node, first, text = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["depth", "node", "first", "ids"])

    for batch in batches:
        for depth, node, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (depth, node) or len(ids) == PACK:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (depth, node), []
            ids.append(conv)
        if out:
            yield flushed()
            out = []
    if ids:
        out.append((*key, ids[0], ",".join(map(str, ids))))
        yield flushed()


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's packs, which come in order of (depth, node, first id)."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([digest.hexdigest()])], ["depth", "node", "ends"])

    for batch in batches:
        for depth, node, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != (depth, node):
                if key:
                    yield row()
                key, digest = (depth, node), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if key:
        yield row()


def end_digests(ends: DataFrame, parts: int) -> DataFrame:
    """(depth, node, ends): the digest of the ids of (depth, node, conv), in ascending order and apart by commas."""
    by = ["depth", "node", "conv"]
    packs = ends.select(*by).repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_pack_task, "depth long, node long, first long, ids string")
    packs = packs.repartition("depth", "node").sortWithinPartitions("depth", "node", "first")
    return packs.mapInArrow(_digest_task, "depth long, node long, ends string")


SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(spark: SparkSession, turns: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    `turns` has (conv, depth from 1 without gaps, h1, h2, n_bytes), `lengths` (conv, length) with a row for each
    conversation, also one without a turn. Turns are equal if both hashes are. The root has depth 0 and no parent; with no
    conversation there is no node. A node of one conversation is alone, its ends digest is of that id or of none. Each level is
    written as a table, so a lost executor costs its tasks alone, and no plan holds more than one level's joins, however many levels there are.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turns = scratch.table(turns.repartitionByRange(parts, "depth", "conv").sortWithinPartitions("depth", "conv"), "turns")
    lengths = scratch.table(lengths, "lengths")
    top = lengths.agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n")).first()
    if not top["n"]:
        return spark.createDataFrame([], SCHEMA)
    root = spark.createDataFrame([(0, None, top["node"], top["n"], 0, 0)], "depth long, parent long, node long, n long, n_bytes long, length long")
    live = scratch.table(lengths.select("conv", F.lit(top["node"]).cast("long").alias("node"), "length", F.lit(0).cast("long").alias("depth")), "live-0")
    levels, depth = [root], 0
    while True:
        depth += 1
        now = turns.where(F.col("depth") == depth).drop("depth")
        step = scratch.table(live.where(F.col("length") >= depth).drop("depth").join(now, "conv").withColumnRenamed("node", "parent"), f"step-{depth}")
        nodes = step.groupBy("parent", "h1", "h2").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n"), F.max("n_bytes").alias("n_bytes"), F.max("length").alias("length"))
        nodes = scratch.table(nodes.withColumn("depth", F.lit(depth).cast("long")), f"nodes-{depth}")
        levels.append(nodes.select(*root.columns))
        shared = nodes.where("n > 1").select("parent", "h1", "h2", "node", "n")
        total, most = shared.agg(F.sum("n"), F.max("n")).first()
        if not total:
            break
        live = beside(step.select("conv", "parent", "h1", "h2", "length"), shared, ["parent", "h1", "h2"], "n", total, most)
        live = scratch.table(live.select("conv", "node", "length", F.lit(depth).cast("long").alias("depth")), f"live-{depth}")
        scratch.drop(f"step-{depth}")
    last = "n_leaves", "saved"
    below = levels[depth].select("parent", F.lit(1).cast("long").alias(last[0]), F.lit(0).cast("long").alias(last[1]))  # the deepest level has no shared node
    rolled = []
    for d in reversed(range(depth)):
        sums = below.groupBy(F.col("parent").alias("of")).agg(F.count(F.lit(1)).alias("n_children"), *[F.sum(c).alias(c) for c in last])
        here = levels[d].where("n > 1") if d else levels[d]
        whole = here.join(sums, F.col("node") == F.col("of"), "left")
        saved = (F.col("n") - 1) * F.col("n_bytes") + F.coalesce("saved", F.lit(0))
        whole = whole.select("depth", "parent", "node", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved"))
        rolled.append(scratch.table(whole, f"rolled-{d}"))
        alone = levels[d].where("n = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
        below = rolled[-1].select("parent", *last).unionByName(alone) if d else None
    ended = spark.read.schema(live.schema).parquet(*[f"{scratch.root}/live-{d}" for d in range(depth)]).where(F.col("length") == F.col("depth"))
    digests = scratch.table(end_digests(ended, parts), "ends")
    shared = spark.read.schema(rolled[0].schema).parquet(*[f"{scratch.root}/rolled-{d}" for d in range(depth)]).join(digests, ["depth", "node"], "left")
    shared = shared.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NO_IDS)).alias("ends_sha256"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in levels[1].schema)
    alone = spark.read.schema(kinds).parquet(*[f"{scratch.root}/nodes-{d}" for d in range(1, depth + 1)]).where("n = 1")
    chain = alone.select("node", F.col("depth").alias("top"), "parent", "length", F.explode(F.sequence("depth", "length")).alias("depth"))
    closed: Column = F.col("depth") == F.col("length")
    one = F.lit(1).cast("long")
    chain = chain.select(
        F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"), one.alias("n_convs"), F.when(closed, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(closed, F.sha2(F.col("node").cast("string").cast("binary"), 256)).otherwise(NO_IDS).alias("ends_sha256"),
    )
    return shared.unionByName(chain)


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)))"
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h, count(*) AS own FROM t GROUP BY conv_id),
kept AS (SELECT a.*, least(a.h, coalesce(b.own, 0)) AS kept FROM heads a LEFT JOIN heads b ON a.base = b.conv_id),
rows AS (
  SELECT k.conv_id, t.place AS depth, role, text FROM kept k JOIN t ON t.conv_id = k.base AND t.place <= k.h
  UNION ALL SELECT k.conv_id, k.kept + t.place - k.h, role, text FROM kept k JOIN t ON t.conv_id = k.conv_id AND t.place > k.h),
named AS (
  SELECT conv_id, depth, strlen(text) AS n_bytes, md5(string_agg(md5(role) || md5(text), '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS h FROM rows
  UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
lens AS (SELECT conv_id, max(depth) AS length FROM named GROUP BY conv_id),
nodes AS (SELECT depth, h, min(conv_id) AS node, count(*) AS n, max(n_bytes) AS n_bytes FROM named GROUP BY depth, h),
parents AS (SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN named m ON m.conv_id = n.node AND m.depth = n.depth - 1 LEFT JOIN nodes p ON p.depth = m.depth AND p.h = m.h),
kids AS (SELECT depth - 1 AS depth, parent, count(*) AS n_children FROM parents WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM parents p LEFT JOIN kids k ON k.depth = p.depth AND k.parent = p.node),
above AS (
  SELECT a.depth, a.h, sum((f.n - 1) * f.n_bytes) AS saved, count(*) FILTER (f.n_children = 0) AS n_leaves
  FROM full_nodes f JOIN named a ON a.conv_id = f.node AND a.depth <= f.depth GROUP BY 1, 2),
ended AS (SELECT m.depth, m.h, sha256(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id)) AS ends FROM named m JOIN lens l ON l.conv_id = m.conv_id AND l.length = m.depth GROUP BY 1, 2)
SELECT f.node AS conv_id, CAST(f.depth AS BIGINT) AS depth, f.parent AS parent_conv_id, f.n AS n_convs, f.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM full_nodes f JOIN above a USING (depth, h) LEFT JOIN ended e USING (depth, h)
"""

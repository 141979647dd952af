"""Chat formatting after collapsing cumulative snapshots; DataFrame functions only.

Logs often hold a conversation once per turn, each snapshot a prefix of the next. A turn's fingerprint covers
its place, role and text; the XOR of the fingerprints of the first k turns names that prefix. A conversation
whose own prefix name stands among the inner prefixes of longer ones is a snapshot and is dropped by an anti
join; of equal conversations the least id stays. Only the conversations that remain are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Turns of a conversation whose running XOR is one window, about; longer ones are split.
SPLIT_TURNS = 1024
START, END = "<|im_start|>", "<|im_end|>"


def turn_text(role: Column, text: Column) -> Column:
    """One rendered turn; a null role is `unknown`, a null text empty."""
    return F.concat(F.lit(START), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END), F.lit("\n"))


def _hashes() -> tuple[Column, Column]:
    """Two fingerprints of a turn's role and text."""
    nulls = F.col("role").isNull(), F.col("text").isNull()
    return F.xxhash64("role", "text", *nulls), F.xxhash64(F.lit("second"), F.struct("role", "text"), *nulls)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, place, h1, h2) for each turn of (conv, turn, role, text): the names of all prefixes, 128 bits each.

    A turn's place is its rank by turn, role and text. Ranks and XORs run within parts of SPLIT_TURNS turn numbers;
    where these hold far more turns (gaps are few, ties are many), parts go by turn number and fingerprint instead.
    What stands before a part is summed over parts. Ids are not null.
    """
    c1, c2 = _hashes()
    block = F.coalesce(F.floor(F.col("turn") / SPLIT_TURNS), F.lit(-1))
    rows = turns.select("conv", "turn", block.alias("block"), c1.alias("c1"), c2.alias("c2"))
    full = rows.groupBy("conv", "block").count().where(F.col("count") > 4 * SPLIT_TURNS).select("conv", "block", F.lit(True).alias("full"))
    rows = rows.join(full, ["conv", "block"], "left")
    split = lambda c: F.when(F.col("full"), c)
    rows = rows.select("conv", "turn", "c1", "c2", F.struct("block", split(F.coalesce("turn", F.lit(0))).alias("turn"), split(F.shiftright("c1", 52)).alias("sub")).alias("part"))
    within = Window.partitionBy("conv", "part").orderBy("turn", "c1", "c2")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    key = ["conv", "part"]
    counts = rows.groupBy(*key).count().select(*key, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    placed = rows.withColumn("rank", F.row_number().over(within)).join(counts, key)
    placed = placed.withColumn("place", F.col("rank") + F.col("first")).withColumn("h1", F.xxhash64("place", "c1")).withColumn("h2", F.xxhash64("c2", "place"))
    xors = placed.groupBy(*key).agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    starts = xors.select(*key, *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(s) for x, s in (("x1", "s1"), ("x2", "s2"))])
    run = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(starts, key).select("conv", "place", *[F.col(s).bitwiseXOR(F.bit_xor(h).over(run)).alias(h) for h, s in (("h1", "s1"), ("h2", "s2"))])


def singles(turns: DataFrame) -> DataFrame:
    """(h1, h2, t, n_copies): the names, rendered turns and numbers of turns without an id, each a conversation of its own."""
    c1, c2 = _hashes()
    rows = turns.where("conv is null").select(F.xxhash64(F.lit(1).cast("long"), c1).alias("h1"), F.xxhash64(c2, F.lit(1).cast("long")).alias("h2"), turn_text(F.col("role"), F.col("text")).alias("t"))
    return rows.groupBy("h1", "h2").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("n_copies"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv, n_turns, n_copies, t) of conversations that are no prefix of a longer one, the least id of equal ones.

    `t` is the rendered turn of a conversation without an id, null for others.
    """
    named = prefixes(turns.where("conv is not null"))
    last = named.groupBy("conv").agg(F.max(F.struct("place", "h1", "h2")).alias("l"))
    ends = last.select("conv", "l.*", F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("t"))
    alone = singles(turns).select(F.lit(None).cast(turns.schema["conv"].dataType).alias("conv"), F.lit(1).cast("long").alias("place"), "h1", "h2", F.col("n_copies").alias("n"), "t")
    name = ["place", "h1", "h2"]
    whole = ends.select("conv", F.col("place").cast("long").alias("place"), "h1", "h2", "n", "t").unionByName(alone)
    whole = whole.groupBy(*name).agg(F.min("conv").alias("conv"), F.sum("n").alias("n_copies"), F.max("t").alias("t"))
    inner = named.join(last.select("conv", F.col("l.place").alias("length")), "conv").where("place < length").select(*name).distinct()
    return whole.join(inner, name, "left_anti").select("conv", F.col("place").alias("n_turns"), "n_copies", F.when(F.col("conv").isNull(), F.col("t")).alias("t"))


def render(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of each maximal conversation.

    Turns are ordered by number, equal numbers by a hash of their content; repeated rows are turns of their own. A row
    without an id is a conversation of one turn; a null turn number comes first. An empty table gives no rows; other
    columns are not read. Turns of one conversation may be any number, and may all have one turn number: only exact
    repeats of a turn share a task. A rendered conversation is one row, so a conversation must fit into one.
    """
    turns = conversations.select(F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    kept = maximal(turns)
    c1, c2 = _hashes()
    ordered = F.struct("turn", c1.alias("c1"), c2.alias("c2"), turn_text(F.col("role"), F.col("text")).alias("t"))
    rows = turns.join(kept.where("conv is not null").drop("t"), "conv")
    whole = rows.groupBy("conv", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(ordered)).alias("turns"))
    whole = whole.select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: t["t"]), "").alias("rendered"))
    return whole.unionByName(kept.where("conv is null").select(F.col("conv").alias("conv_id"), "n_turns", "n_copies", F.col("t").alias("rendered")))


ORACLE_SQL = f"""
WITH numbered AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS alone, turn, role, text FROM conversations),
turns AS (
  SELECT conv_id, alone, row_number() OVER (PARTITION BY conv_id, alone ORDER BY turn) AS place, role, text FROM numbered),
named AS (
  SELECT conv_id, alone, place, md5(string_agg(md5(coalesce('=' || role, '')) || md5(coalesce('=' || text, '')), '' ORDER BY place) OVER (PARTITION BY conv_id, alone ORDER BY place)) AS h
  FROM turns),
ends AS (SELECT conv_id, alone, max(place) AS n_turns, arg_max(h, place) AS h FROM named GROUP BY conv_id, alone),
whole AS (
  SELECT h, n_turns, min(conv_id) AS conv_id, CASE WHEN min(conv_id) IS NULL THEN min(alone) ELSE 0 END AS alone, count(*) AS n_copies
  FROM ends GROUP BY h, n_turns),
kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (
    SELECT 1 FROM named n JOIN ends e USING (conv_id) WHERE n.place < e.n_turns AND n.place = w.n_turns AND n.h = w.h))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('{START}' || coalesce(t.role, 'unknown') || chr(10) || coalesce(t.text, '') || '{END}' || chr(10), '' ORDER BY t.place) AS rendered
FROM kept k JOIN turns t ON k.conv_id IS NOT DISTINCT FROM t.conv_id AND k.alone = t.alone GROUP BY k.conv_id, k.alone, k.n_turns, k.n_copies
"""

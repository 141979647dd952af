"""Scans over keys of any length: running sums and places by ranges, recurrences by composed maps.

No task holds a key. Rows are dealt by ranges of (key, order), so that a key with most rows has most ranges; what
stands before a range is summed over ranges, of which there are few. A recurrence is the composition of affine maps,
which is associative: blocks of a bounded number of rows become one map each, blocks of blocks one, and so on up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwork.sources.sinks import shared_folder

#: Maps that one fold composes.
FAN = 128


def cut(rows: DataFrame) -> DataFrame:
    """The rows from a checkpoint in the shared folder: later plans read them and do not compute them again."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


def shares(rows: DataFrame, share: int) -> int:
    """Tasks that hold about `share` of these rows each, at least as many as the session's shuffle partitions."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // share))


def _free(rows: DataFrame, name: str) -> str:
    while name in rows.columns:
        name += "_"
    return name


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys of which nulls are equal; the right side's keys go."""
    names = {k: f"_right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(renamed, on, how).drop(*names.values())


def prefix_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], parts: int | None = None, whole: Sequence[str] = ()) -> DataFrame:
    """Rows with, for each name of `sums`, the sum of its expression from the first row of the key up to this one.

    Names of `whole` also give `{name}_all`, the sum over the key.

    `order` is ascending unless a column says otherwise; rows of equal order follow each other as they are read, and may be
    dealt to several tasks. Null keys are a key. With no keys all rows are one sequence. `parts` ranges (by default
    as many as the session's shuffle partitions) are each one task's share, whatever the keys.
    """
    tie, span = _free(rows, "_tie"), _free(rows, "_span")
    by = [c if isinstance(c, Column) else F.col(c) for c in order] + [F.col(tie)]
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    terms = {f"_term_{k}": c for k, c in sums.items()}
    dealt = rows.withColumns(terms).withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(n, *keys, *by)
    dealt = cut(dealt.withColumn(span, F.spark_partition_id()))
    totals = dealt.groupBy(*keys, span).agg(*[F.sum(t).alias(t) for t in terms])
    earlier = Window.partitionBy(*keys).orderBy(span).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, span, *[F.coalesce(F.sum(t).over(earlier), F.lit(0)).alias(f"_before_{t}") for t in terms], *[F.col(t).alias(f"_sum_{t}") for t in terms])
    every = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = before.withColumns({f"{k}_all": F.sum(F.col(f"_sum__term_{k}")).over(every) for k in whole}).drop(*[f"_sum_{t}" for t in terms])
    own = Window.partitionBy(*keys, span).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    running = dealt.withColumns({f"_own_{t}": F.sum(t).over(own) for t in terms})
    joined = _same(running, before, [*keys, span])
    return joined.select(*rows.columns, *[(F.col(f"_own__term_{k}") + F.col(f"_before__term_{k}")).alias(k) for k in sums], *[f"{k}_all" for k in whole])


def places(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "place", parts: int | None = None) -> DataFrame:
    """Rows with their place in the order of their key, from 1."""
    return prefix_sums(rows, keys, order, {out: F.lit(1).cast("long")}, parts)


def _levels(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], factor: Column, term: Column, parts: int | None) -> list[DataFrame]:
    """Blocks (keys, _block, _maps) of the rows' maps, of these blocks' maps, and so on until each key has one block."""
    placed = places(rows.withColumns({"_a": factor.cast("double"), "_b": term.cast("double")}), keys, order, "_place", parts)
    level = placed.withColumn("_block", F.floor((F.col("_place") - 1) / FAN))
    rest = F.struct(F.lit(0), *rows.columns).alias("_row")
    levels = [cut(level.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("_place", "_a", "_b", rest))).alias("_maps")))]
    while levels[-1].agg(F.max("_block")).first()[0]:
        up = levels[-1].select(*keys, "_block", _composed(F.col("_maps")).alias("m"))
        up = up.select(*keys, F.floor(F.col("_block") / FAN).alias("_up"), F.struct(F.col("_block").alias("_place"), F.col("m.a").alias("_a"), F.col("m.b").alias("_b")).alias("m"))
        levels.append(cut(up.groupBy(*keys, F.col("_up").alias("_block")).agg(F.sort_array(F.collect_list("m")).alias("_maps"))))
    return levels


def _composed(maps: Column) -> Column:
    """struct<a, b> of the map that does what these do one after the other."""
    return F.aggregate(maps, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")), lambda s, m: F.struct((m["_a"] * s["a"]).alias("a"), (m["_a"] * s["b"] + m["_b"]).alias("b")))


def affine_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], factor: Column, term: Column, out: str = "y", start: float = 0.0, parts: int | None = None) -> DataFrame:
    """(keys, y): what `affine_scan` gives for the last row of each key."""
    top = _levels(rows.select(*keys, *order, factor.alias("_f"), term.alias("_t")), keys, order, F.col("_f"), F.col("_t"), parts)[-1]
    m = top.select(*keys, _composed(F.col("_maps")).alias("m"))
    return m.select(*keys, (F.col("m.a") * float(start) + F.col("m.b")).alias(out))


def affine_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], factor: Column, term: Column, out: str = "y", start: float = 0.0, parts: int | None = None) -> DataFrame:
    """Rows with y = factor * (y of the row before) + term, a recurrence over each key in order; y before the first is `start`.

    FAN rows compose to one map by a fold over a bounded array, as do FAN maps of a level, until a key has one. Then
    each level's maps get the values that they start from, and at last the rows. Null factors or terms make null
    values from there on. Sums run in the order of the rows within a block; between blocks they differ from a plain loop's in
    the last bits.
    """
    levels = _levels(rows, keys, order, factor, term, parts)
    begun = levels.pop().withColumn("_start", F.lit(float(start)))

    def values(at: DataFrame) -> Column:
        """Where each map of a block starts from, and the last one's end."""
        return F.aggregate("_maps", F.array(F.col("_start")), lambda s, m: F.concat(s, F.array(m["_a"] * F.element_at(s, -1) + m["_b"])))

    while levels:
        down = begun.select(*keys, F.explode(F.arrays_zip(F.transform("_maps", lambda m: m["_place"]).alias("block"), F.slice(values(begun), 1, F.size("_maps")).alias("start"))).alias("z"))
        down = down.select(*keys, F.col("z.block").alias("_block"), F.col("z.start").alias("_start"))
        begun = _same(levels.pop(), down, [*keys, "_block"])
    final = begun.select(F.explode(F.arrays_zip(F.col("_maps"), F.slice(values(begun), 2, F.size("_maps")).alias("_y"))).alias("z"))
    return final.select(*[F.col(f"z._maps._row.{c}").alias(c) for c in rows.columns], F.col("z._y").alias(out))

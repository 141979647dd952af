"""Matching operators. Ranges and nearest matches are keyed, so that none of them plans as a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwork.operators.scans import shares

#: Rows that one task compares with bands.
BAND_ROWS = 20_000


def role_pairs(rows: DataFrame, keys: Sequence[str], role: str, first: str, second: str) -> DataFrame:
    """Rows of one role beside rows of another with equal keys; the other columns get _a and _b."""
    rest = [c for c in rows.columns if c not in (*keys, role)]
    side = lambda r, s: rows.where(F.col(role) == r).select(*keys, *[F.col(c).alias(c + s) for c in rest])
    return side(first, "_a").join(side(second, "_b"), list(keys))


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str = "found") -> DataFrame:
    """Left rows with the right side's columns and whether there was a match; right keys must be unique."""
    marked = right.withColumn(flag, F.lit(True))
    return left.join(marked, list(keys), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def tiered(fast: DataFrame, slow: DataFrame, keys: Sequence[str], source: str = "source") -> DataFrame:
    """Full join of two tiers; each column comes from the fast one where it is not null. `source` names the tier."""
    rest = [c for c in fast.columns if c not in keys]
    f = fast.select(*keys, *[F.col(c).alias(f"f_{c}") for c in rest], F.lit(True).alias("_f"))
    s = slow.select(*keys, *[F.col(c).alias(f"s_{c}") for c in rest])
    both = f.join(s, list(keys), "full")
    return both.select(*keys, *[F.coalesce(f"f_{c}", f"s_{c}").alias(c) for c in rest], F.when(F.col("_f"), "fast").otherwise("slow").alias(source))


def both_above(a: DataFrame, b: DataFrame, key: str, value: str, limit: float, names: tuple[str, str]) -> DataFrame:
    """Pairs of rows with one key whose values both exceed a limit; both filters run before the join."""
    na, nb = names
    left = a.where(F.col(value) > limit).select(key, F.col(na).alias(f"{na}_a"), F.col(value).alias("value_a"))
    right = b.where(F.col(value) > limit).select(key, F.col(nb).alias(f"{nb}_b"), F.col(value).alias("value_b"))
    return left.join(right, key).withColumn("severity", F.least("value_a", "value_b"))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str, out: str) -> DataFrame:
    """Left rows with the right side's value at the last time not after theirs.

    One pass over the union of both sides by key and time instead of a range join; of right rows at one time the largest
    value counts, and a right row at a left row's own time comes before it.
    """
    rest = [c for c in left.columns if c not in (*keys, time)]
    l = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))  # noqa: E741
    r = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy(time, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = l.unionByName(r).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select(*keys, time, *[F.col(f"_row.{c}").alias(c) for c in rest], out)


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, left_id: str, right_id: str, limit: float | None = None) -> DataFrame:
    """(left_id, right_id, distance) of the right row of the same key nearest in `time` (a number); the lower id on ties.

    Candidates of a left row are only the last right time before it and the first after it, so a key may have any number
    of rows on both sides. Left rows without a match, or none nearer than `limit`, are left out.
    """
    one = right.groupBy(*keys, time).agg(F.min(right_id).alias("_v"))
    l = left.select(*keys, time, F.lit(1).alias("_side"), F.col(left_id).alias("_l"), F.lit(None).cast("struct<t:double,v:bigint>").alias("_r"))  # noqa: E741
    r = one.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), F.struct(F.col(time).cast("double").alias("t"), F.col("_v").cast("bigint").alias("v")).alias("_r"))
    w = Window.partitionBy(*keys).orderBy(time, "_side")
    both = l.unionByName(r)
    both = both.withColumn("_b", F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_a", F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).where("_side = 1")
    gap = lambda c: F.abs(F.col(f"{c}.t") - F.col(time))
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(gap(c).alias("d"), F.col(f"{c}.v").alias("v"))) for c in ("_b", "_a")])))
    out = both.select(F.col("_l").alias(left_id), best["v"].alias(right_id if right_id != left_id else f"{right_id}_b"), best["d"].alias("distance")).where("distance is not null")
    return out if limit is None else out.where(F.col("distance") < limit)


def in_bands(rows: DataFrame, bands: DataFrame, value: str, low: str, high: str, on: Sequence[str] = ()) -> DataFrame:
    """Rows beside every band with low <= value < high, without a nested loop, for bands of any length; columns `on` are equal.

    A band belongs to the level whose cells, of a power of two, are the least that are as long as it; it touches one or two of
    them. A row looks into its cell of every level that bands are of. So a band is copied twice at most, whatever the mix of lengths,
    and a row once a level. Bands without a length, and null bounds or values, match nothing. Rows may meet many bands each, so they
    are dealt by their number, BAND_ROWS a task, not by the splits of their file.
    """
    length = F.col(high).cast("double") - F.col(low).cast("double")
    rough = F.ceil(F.log2(length)).cast("int")
    level = rough + F.when(F.pow(F.lit(2.0), rough) < length, 1).otherwise(0)

    def cell(x: Column, of: Column) -> Column:
        at = x.cast("double") / F.pow(F.lit(2.0), of)
        near = F.rint(at)
        return near - F.when(near > at, 1.0).otherwise(0.0)  # the floor as a double: a long would overflow

    sized = bands.where(length > 0).withColumn("_level", level)
    spread = sized.withColumn("_cell", F.explode(F.array_distinct(F.array(cell(F.col(low), F.col("_level")), cell(F.col(high), F.col("_level"))))))
    levels = sized.agg(F.sort_array(F.collect_set("_level")).alias("_levels"))  # at most one for each exponent of a double
    dealt = rows.repartition(shares(rows, BAND_ROWS))
    keyed = dealt.join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).withColumn("_cell", cell(F.col(value), F.col("_level")))
    near = keyed.drop("_levels").join(spread, ["_level", "_cell", *on])
    return near.where((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_level", "_cell")


def set_membership(rows: DataFrame, keys: Sequence[str], item: str, valid: dict[str, list[list[str]]], kind: Column | None = None) -> DataFrame:
    """(keys, items, is_valid, missing, extra): whether a key's items equal one of its kind's valid sets.

    Missing and extra are told against the first valid set. Without `kind`, the only entry of `valid` is used.
    """
    found = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(item)).alias("items"))
    names = list(valid)
    of = F.lit(names[0]) if kind is None else kind
    options = F.create_map(*[x for k in names for x in (F.lit(k), F.array(*[F.array_sort(F.array(*map(F.lit, s))) for s in valid[k]]))])
    sets = F.try_element_at(options, of)
    return found.select(
        *keys,
        "items",
        F.coalesce(F.array_contains(sets, F.col("items")), F.lit(False)).alias("is_valid"),
        F.array_sort(F.array_except(F.get(sets, F.lit(0)), "items")).alias("missing"),
        F.array_sort(F.array_except("items", F.get(sets, F.lit(0)))).alias("extra"),
    )


def insert_absent(table: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The table and those new rows whose key it lacks, one a key: the first by `order`."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
    return table.unionByName(first.join(table.select(key).distinct(), key, "left_anti"))


def orphans(entries: DataFrame, live: DataFrame, key: str, age: str, ttl: float) -> DataFrame:
    """Entries of no live key that are older than the limit."""
    return entries.where(F.col(age) > ttl).join(live.select(key).distinct(), key, "left_anti")


def shared_items(rows: DataFrame, key: str, item: str, a: object, b: object) -> DataFrame:
    """Sorted distinct items that two keys share."""
    side = lambda k: rows.where(F.col(key) == k).select(item).distinct()
    return side(a).join(side(b), item).orderBy(item)


def through_alias(requests: DataFrame, aliases: DataFrame, entries: DataFrame, request_key: str, alias_key: str, content_key: str) -> DataFrame:
    """Requests joined to entries by their own key, or by the one that an alias stands for."""
    hop = requests.join(aliases, requests[request_key] == aliases[alias_key], "left").withColumn("_k", F.coalesce(content_key, request_key)).drop(alias_key, content_key)
    return hop.join(entries, hop["_k"] == entries[content_key]).drop("_k")


def beat_position(grid: Column, beat: Column, hop: int = 512, scale: float = 2.0, bpm: Column | None = None, rate: int = 44100) -> Column:
    """Sample of a beat on a grid of frames; beyond it by the mean of the last eight beats' spacing.

    Where that spacing is off the tempo's by more than a fifth, the tempo's holds. Fewer than two frames: a beat a second.
    """
    n = F.size(grid)
    tail = F.slice(grid, -F.least(n, F.lit(8)), F.least(n, F.lit(8)))
    mean = F.try_divide(F.element_at(tail, -1) - F.element_at(tail, 1), F.size(tail) - 1) * hop * scale
    if bpm is not None:
        tempo = F.try_divide(F.lit(60.0), bpm) * rate
        mean = F.when((bpm > 0) & (F.abs(mean - tempo) / tempo > 0.20), tempo).otherwise(mean)
    inside = F.get(grid, beat.cast("int")) * hop * scale
    beyond = F.element_at(grid, -1) * hop * scale + (beat - n + 1) * mean
    return F.when(n < 2, (beat * rate).cast("long")).when(beat >= n, F.floor(beyond).cast("long")).otherwise(F.floor(inside).cast("long"))


def nearest_of(values: Column, x: Column) -> Column:
    """The entry of an array nearest to x, the first on ties."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"), v.alias("v"))))["v"]


def bar_of(bars: Column, t: Column) -> Column:
    """Place of the last bar that begins at or before t, clamped to the bars (of n + 1 boundaries there are n)."""
    return F.greatest(F.lit(0), F.least(F.size(bars) - 2, F.size(F.filter(bars, lambda b: b <= t)) - 1))

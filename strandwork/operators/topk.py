"""Ranking, de-duplication and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandwork.operators.scans import places


def first_per(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def capped_corrections(rows: DataFrame, stem: Sequence[str], hz: str, gain: str, order: str, n: int = 4, least: float = -4.0) -> DataFrame:
    """The n strongest cuts of each stem, one a frequency (the first of equal ones), gains within [least, 0]."""
    strongest = first_per(rows, [*stem, hz], [gain, order])
    return first_per(strongest, stem, [gain, order], n).withColumn(gain, F.greatest(F.lit(least), F.least(F.lit(0.0), F.col(gain))))


def merged_corrections(anomalies: DataFrame, conflicts: DataFrame, stem: Sequence[str], hz: str, gain: str, n: int = 4, least: float = -4.0) -> DataFrame:
    """Corrections of two lists of (stem, hz, gain) as one: a stem's anomalies stand before its conflicts, then `capped_corrections`."""
    both = anomalies.withColumn("_o", F.lit(0)).unionByName(conflicts.withColumn("_o", F.lit(1)))
    rows = both.select(*stem, hz, gain, F.struct("_o", hz).alias("_order"))
    return capped_corrections(rows, stem, hz, gain, "_order", n, least).select(*stem, hz, gain)


def distinct_by(rows: DataFrame, hashed: Column, order: Sequence[Column | str]) -> DataFrame:
    """One row for each hash, the first by order."""
    return first_per(rows.withColumn("_h", hashed), ["_h"], order).drop("_h")


def backfilled(kept: DataFrame, spare: DataFrame, hash_col: str, family: str, order: str, least: int) -> DataFrame:
    """Kept rows and, if they are fewer than `least`, spare ones of new hashes, least represented families first.

    How many of each size of family are wanted follows from counts, a row for each; only where a size gives some of its
    rows and not all, they are ranked by `order`: by ranges of it, then within a range.
    """
    counts = kept.groupBy(family).agg(F.count(F.lit(1)).alias("_c"))
    fresh = first_per(spare.join(kept.select(hash_col).distinct(), hash_col, "left_anti"), [hash_col], [order])
    fresh = fresh.join(counts, family, "left").withColumn("_c", F.coalesce("_c", F.lit(0)))
    room = least - kept.count()
    if room <= 0:
        return kept
    whole, part, want = [], None, 0
    for r in fresh.groupBy("_c").count().orderBy("_c").collect():  # as many rows as kept families have different sizes
        if r["count"] <= room:
            whole.append(r["_c"])
            room -= r["count"]
        else:
            part, want = r["_c"], room
            break
    taken = fresh.where(F.col("_c").isin(whole)).select(*kept.columns)
    if want:
        rows = fresh.where(F.col("_c") == part)
        edges = rows.approxQuantile(order, [k / 64 for k in range(1, 64)], 0.01)
        rows = rows.withColumn("_b", sum(((F.col(order) > e).cast("int") for e in sorted(set(edges))), F.lit(0)))
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))  # 64 rows
        rows = rows.join(F.broadcast(starts), "_b").where(F.col("_s") < want)
        place = F.col("_s") + F.row_number().over(Window.partitionBy("_b").orderBy(order, hash_col))
        taken = taken.unionByName(rows.withColumn("_r", place).where(F.col("_r") <= want).select(*kept.columns))
    return kept.unionByName(taken)


def reconciled(have: DataFrame, want: DataFrame, key: str, managed: Column) -> DataFrame:
    """(key, action): keep, add what is wanted and missing, drop what is managed and no longer wanted."""
    h = have.select(key, managed.alias("_managed"), F.lit(True).alias("_have"))
    both = h.join(want.select(key, F.lit(True).alias("_want")), key, "full")
    action = F.when(F.col("_have").isNull(), "add").when(F.col("_managed") & F.col("_want").isNull(), "drop").otherwise("keep")
    return both.select(key, action.alias("action"))


def newest_first(rows: DataFrame, added: str, order: str, out: str = "place") -> DataFrame:
    """Rows with their place by text of the time, latest first, stable by `order`; no task numbers all rows."""
    return places(rows, [], [F.desc(added), order], out)


def set_report(expected: Column, received: Column) -> Column:
    """struct<missing, extra, common>, each sorted."""
    return F.struct(F.array_sort(F.array_except(expected, received)).alias("missing"), F.array_sort(F.array_except(received, expected)).alias("extra"), F.array_sort(F.array_intersect(expected, received)).alias("common"))


def merged_notes(a: Column, b: Column) -> Column:
    """Union of two lists, sorted: the order of a merged set is ours to define."""
    return F.array_sort(F.array_union(a, b))

"""Aggregates: dashboard counts, percentiles, segment statistics, correlations and ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from strandwork.operators import scans

from strandwork.functions.music import energy_class
from strandwork.functions.rules import first_match


def counts_by_period(rows: DataFrame, day: str, week: str) -> DataFrame:
    """(period, key, n): counts by day, by week, and in total, in one pass; rows without a day count nowhere."""
    dated = rows.where(F.col(day).isNotNull())
    grouped = dated.groupingSets([[day], [week], []], day, week).agg(F.count(F.lit(1)).alias("n"), F.grouping(day).alias("_d"), F.grouping(week).alias("_w"))
    period = F.when(F.col("_d") == 0, "day").when(F.col("_w") == 0, "week").otherwise("total")
    return grouped.select(period.alias("period"), F.coalesce(day, week, F.lit("all")).alias("key"), "n")


def rounded_mean(value: Column, digits: int = 1) -> Column:
    return F.bround(F.avg(value), digits)


def top_pairs(rows: DataFrame, slots: Sequence[tuple[str, str]], order: str, n: int | None = 10) -> DataFrame:
    """(id, title, n) of the most frequent pairs over several slots of a row; ties go to the first seen by `order`.

    A slot counts if either part is not empty.
    """
    entries = F.array(*[F.struct(F.coalesce(F.col(i), F.lit("")).alias("id"), F.coalesce(F.col(t), F.lit("")).alias("title"), F.lit(k).alias("slot")) for k, (i, t) in enumerate(slots)])
    flat = rows.select(F.col(order).alias("_o"), F.explode(entries).alias("e")).where("e.id <> '' or e.title <> ''")
    counted = flat.groupBy(F.col("e.id").alias("id"), F.col("e.title").alias("title")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "e.slot")).alias("_first"))
    ranked = counted.orderBy(F.desc("n"), "_first")
    return (ranked if n is None else ranked.limit(n)).drop("_first")


def frequencies(rows: DataFrame, items: str, order: str, ranked: bool = False) -> DataFrame:
    """(item, n) of the entries of an array column; with `ranked` also `place`, most frequent first, ties by first appearance.

    `order` is a number. First appearances are two fixed-width minima, so that counting is a hash aggregate before and
    after the shuffle. Ranking puts the distinct items, not the entries, into one order.
    """
    flat = rows.select(F.col(order).alias("_o"), F.posexplode(items).alias("_p", "item"))
    counted = flat.groupBy("item").agg(F.count(F.lit(1)).alias("n"), *([F.min("_o").alias("_o"), F.min_by("_p", "_o").alias("_q")] if ranked else []))
    if not ranked:
        return counted
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_o", "_q", "item"))).select("item", "n", "place")


def hit_rate(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row (total, hits_a, hits_b, hit_rate_pct) over rows in which either flag is present: hit slots of all slots."""
    known = rows.where(F.col(a).isNotNull() | F.col(b).isNotNull())
    out = known.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(a)).alias("hits_a"), F.count_if(F.col(b)).alias("hits_b"))
    rate = F.bround(F.try_divide((F.col("hits_a") + F.col("hits_b")).cast("double"), 2 * F.col("total")) * 100, 1)
    return out.withColumn("hit_rate_pct", F.coalesce(rate, F.lit(0.0)))


def rms(value: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(value * value)), F.lit(0.0))


def array_rms(samples: Column) -> Column:
    """RMS of an array; empty ones have 0."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) == 0, F.lit(0.0)).otherwise(F.sqrt(total / F.size(samples)))


def summed_above(value: Column, floor: float = 0.001) -> Column:
    """Sum of values, those below a noise floor as 0."""
    return F.sum(F.when(value < floor, F.lit(0.0)).otherwise(value))


#: Normalised values below this are noise.
NOISE = 0.02


def norm_of(value: Column, p99: Column) -> Column:
    """A value over the 99th percentile of its key, 0 at least; where that is missing or not positive, the value itself."""
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(value, F.when(p99 > 0, p99)), value))


def buckets_of(norm: Column, w: WindowSpec, floor: float = NOISE) -> Column:
    """The 10th, 50th and 85th percentiles of the norms at or above the floor in a window; null without any."""
    return F.percentile(F.when(norm >= floor, norm), F.array(F.lit(0.10), F.lit(0.50), F.lit(0.85))).over(w)


def normalised_buckets(rows: DataFrame, key: Sequence[str], value: str, floor: float = NOISE) -> DataFrame:
    """Rows with `norm` (value over the 99th percentile of the positive ones), and p10, p50, p85 of the norms at or above the floor.

    Percentiles are exact and per key; without values they are 0.
    """
    top = rows.groupBy(*key).agg(F.percentile(F.when(F.col(value) > 0, F.col(value)), F.lit(0.99)).alias("_p99"))
    scaled = rows.join(top, list(key)).withColumn("norm", norm_of(F.col(value), F.col("_p99"))).drop("_p99")
    active = F.when(F.col("norm") >= floor, F.col("norm"))
    parts = scaled.groupBy(*key).agg(*[F.coalesce(F.percentile(active, F.lit(p)), F.lit(0.0)).alias(n) for n, p in (("p10", 0.10), ("p50", 0.50), ("p85", 0.85))])
    return scaled.join(parts, list(key)).withColumn("noise_floor", F.lit(floor))


def classified(rows: DataFrame, value: str = "norm") -> DataFrame:
    c = F.col
    return rows.withColumn("energy_class", energy_class(c(value), c("noise_floor"), c("p10"), c("p50"), c("p85")))


def thirds(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Rows of each key with `third` (1, 2, 3; the last takes what is left over) and `in_last` (the last third by length)."""
    w = Window.partitionBy(*key)
    third, in_last = third_of(F.row_number().over(w.orderBy(order)), F.count(F.lit(1)).over(w))
    return rows.withColumn("third", third).withColumn("in_last", in_last)


def third_of(k: Column, n: Column) -> tuple[Column, Column]:
    """The third in which row k of n, from 1, stands, and whether it is in the last third by length."""
    size = F.greatest(F.lit(1), F.floor(n / 3))
    return F.least(F.lit(3), F.floor((k - 1) / size) + 1).cast("int"), k > n - size


def activity_status(segments: DataFrame, key: Sequence[str], active: str, order: str) -> DataFrame:
    """vox:yes, vox:fading or vox:no of each segment: more than half active, and whether only its first third is."""
    x = F.col(active).cast("double")
    stats = thirds(segments, key, order).groupBy(*key).agg(F.avg(x).alias("mean"), F.avg(F.when(F.col("third") == 1, x)).alias("head"), F.avg(F.when(F.col("in_last"), x)).alias("tail"))
    return stats.select(*key, status_of(F.col("mean"), F.col("head"), F.col("tail")).alias("vocal_status"))


def status_of(mean: Column, head: Column, tail: Column) -> Column:
    """vox:yes, vox:fading or vox:no by the active shares of a segment and of its first and last thirds."""
    return first_match([((mean > 0.5) & (head > 0.5) & (tail < 0.5), "vox:fading"), (mean > 0.5, "vox:yes")], "vox:no")


def density(rows: DataFrame, song: Sequence[str], segment: str, stem: str, value: str) -> DataFrame:
    """sparse, mid, full or full+extra of each segment, by how many stems exceed their own 25th percentile there."""
    positive = F.when(F.col(value) > 0, F.col(value))
    own = rows.groupBy(*song, stem).agg(F.percentile(positive, F.lit(0.25)).alias("_p25"), F.percentile(positive, F.lit(0.90)).alias("_p90"))
    seg = rows.groupBy(*song, segment, stem).agg(F.avg(value).alias("_mean"), F.max(value).alias("_max"))
    both = seg.join(own, [*song, stem]).groupBy(*song, segment).agg(F.count_if(F.col("_mean") > F.col("_p25")).alias("active"), F.coalesce(F.bool_or(F.col("_max") > F.col("_p90")), F.lit(False)).alias("peak"))
    return both.select(*song, segment, "active", density_of(F.col("active"), F.col("peak")).alias("density"))


def density_of(active: Column, peak: Column) -> Column:
    """sparse, mid, full or full+extra by the number of active stems and whether one peaks."""
    return first_match([((active >= 5) & peak, "full+extra"), (active >= 5, "full"), (active >= 3, "mid")], "sparse")


def trajectory(rows: DataFrame, key: Sequence[str], order: str, value: str = "norm") -> DataFrame:
    """`low->high` of each segment: the classes of its thirds' means, equal neighbours once. Rows carry their thresholds."""
    limits = ["noise_floor", "p10", "p50", "p85"]
    means = thirds(rows, key, order).groupBy(*key, "third").agg(F.avg(value).alias("_m"), *[F.first(c).alias(c) for c in limits])
    c = F.col
    levels = means.select(*key, "third", energy_class(c("_m"), *[c(x) for x in limits]).alias("_l"))
    parts = levels.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("third", "_l"))), lambda x: x["_l"]).alias("_p"))
    return parts.select(*key, way(F.col("_p")).alias("trajectory"))


def way(levels: Column) -> Column:
    """`low->high` of an array of classes: equal neighbours once."""
    return F.array_join(F.filter(levels, lambda x, i: (i == 0) | (x != F.get(levels, i - 1))), "->")


def prominence(rows: DataFrame, key: Sequence[str], stem: str, active: str, value: str, vocal: str = "vocals", least_active: int = 1) -> DataFrame:
    """dB of the vocal stem's mean over the sum of the others', over active bars; null if either is silent or bars are few.

    Rows are (key, bar, stem, value, active); a bar's stems share `active`.
    """
    on = rows.where(F.col(active))
    is_vocal = F.col(stem) == vocal
    n = F.count_if(is_vocal)
    v, other = F.try_divide(F.sum(F.when(is_vocal, F.col(value)).otherwise(F.lit(0.0))), n), F.try_divide(F.sum(F.when(~is_vocal, F.col(value)).otherwise(F.lit(0.0))), n)
    out = on.groupBy(*key).agg(n.alias("_n"), v.alias("_v"), other.alias("_o"))
    return out.select(*key, prominence_of(F.col("_n"), F.col("_v"), F.col("_o"), least_active).alias("prominence_db"))


def prominence_of(n: Column, v: Column, other: Column, least_active: int = 1) -> Column:
    """dB of a mean over another of n bars; null if either is silent or bars are few."""
    return F.when((n >= least_active) & (v >= 1e-10) & (other >= 1e-10), 20 * F.log10(v / other))


def energy_profile(rows: DataFrame, key: Sequence[str], value: str, floor: float = 0.02) -> DataFrame:
    """Class of each key's coefficient of variation over values above the floor."""
    x = F.when(F.col(value) > floor, F.col(value))
    stats = rows.groupBy(*key).agg(F.avg(x).alias("mean"), F.coalesce(F.try_divide(F.stddev_pop(x), F.when(F.avg(x) > 0, F.avg(x))), F.lit(0.0)).alias("cv"))
    label = first_match([(F.col("mean").isNull(), "consistent low"), ((F.col("cv") < 0.15) & (F.col("mean") > 0.6), "consistent high"), (F.col("cv") < 0.15, "consistent low"), (F.col("cv") > 0.35, "wide dynamic range")], "moderate dynamic range")
    return stats.select(*key, "cv", label.alias("profile"))


def interval_tempo(rows: DataFrame, key: Sequence[str], time: Column, order: Sequence[str]) -> DataFrame:
    """(key, bpm, confidence) of event times in seconds: from the median interval and how narrow its middle half is."""
    w = Window.partitionBy(*key).orderBy(*order)
    gaps = rows.withColumn("_g", time - F.lag(time).over(w)).where("_g is not null")
    q = lambda p: F.percentile("_g", F.lit(p))
    stats = gaps.groupBy(*key).agg(q(0.5).alias("_m"), (q(0.75) - q(0.25)).alias("_iqr"))
    return stats.select(*key, F.try_divide(F.lit(60.0), F.col("_m")).alias("bpm"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.try_divide(F.col("_iqr"), F.col("_m")))).alias("confidence"))


def first_seen_mode(rows: DataFrame, key: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(key, mode): the most frequent value, the first seen on ties."""
    counted = rows.groupBy(*key, value).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*key).orderBy(F.desc("_n"), "_first")
    return counted.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*key, F.col(value).alias("mode"))


def upper_median(value: str) -> Column:
    """The entry at n // 2 of the sorted values, the upper of two middle ones, from counts of the distinct ones."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")


def offset_consistency(rows: DataFrame, key: Sequence[str], offset: str, within: float = 3000, largest: float = 5000, share: float = 0.6, least: int = 3) -> DataFrame:
    """(key, median_offset, consistent): upper median, and whether it is small and most offsets lie near it."""
    medians = rows.groupBy(*key).agg(upper_median(offset).alias("median_offset"))
    near = F.avg((F.abs(F.col(offset) - F.col("median_offset")) < within).cast("double")).alias("_near")
    stats = rows.where(F.col(offset).isNotNull()).join(medians, list(key)).groupBy(*key).agg(F.first("median_offset").alias("median_offset"), near, F.count(F.lit(1)).alias("_n"))
    enough = F.col("_n") >= least
    ok = enough & (F.abs("median_offset") < largest) & (F.col("_near") >= share)
    return stats.select(*key, F.when(enough, F.col("median_offset")).alias("median_offset"), ok.alias("consistent"))


def loudest_window(rows: DataFrame, key: Sequence[str], order: str, value: str, length: int) -> DataFrame:
    """(key, start, mean_square) of the full window of so many rows with the largest mean square, the first on ties."""
    w = Window.partitionBy(*key).orderBy(order)
    frame = w.rowsBetween(0, length - 1)
    scored = rows.withColumn("_m", F.avg(F.col(value) * F.col(value)).over(frame)).withColumn("_n", F.count(F.lit(1)).over(frame))
    full = scored.where(F.col("_n") == length)
    best = full.groupBy(*key).agg(F.max_by(F.struct(F.col(order).alias("start"), F.col("_m").alias("mean_square")), F.struct("_m", (-F.col(order)).alias("_o"))).alias("b"))
    return best.select(*key, "b.start", "b.mean_square")


#: Weights of the twelve notes from the tonic on in major and minor keys (Krumhansl and Kessler 1982).
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def key_by_profile(chroma: DataFrame, song: Sequence[str], pitch: str, value: str) -> DataFrame:
    """(song, tonic, scale, correlation, confidence): the rotation of a key profile that correlates best with (pitch 0-11, value)."""
    spark = chroma.sparkSession
    rows = [(t, s, (t + k) % 12, float(x)) for s, p in (("major", MAJOR_PROFILE), ("minor", MINOR_PROFILE)) for t in range(12) for k, x in enumerate(p)]
    profiles = spark.createDataFrame(rows, f"tonic int, scale string, {pitch} int, weight double")
    scored = chroma.join(F.broadcast(profiles), pitch).groupBy(*song, "tonic", "scale").agg(F.corr(value, "weight").alias("r"))
    best = scored.groupBy(*song).agg(F.max(F.struct("r", (-F.col("tonic")).alias("t"), "scale")).alias("b"), F.avg("r").alias("_mean"))
    return best.select(*song, (-F.col("b.t")).alias("tonic"), "b.scale", F.col("b.r").alias("correlation"), F.least(F.lit(1.0), F.try_divide(F.col("b.r"), F.abs("_mean")) / 2).alias("confidence"))


def side_mid_ratio(left: str, right: str) -> Column:
    """RMS of half the difference over RMS of half the sum."""
    l, r = F.col(left), F.col(right)  # noqa: E741
    return F.try_divide(F.sqrt(F.avg(F.pow((l - r) / 2, F.lit(2.0)))), F.sqrt(F.avg(F.pow((l + r) / 2, F.lit(2.0)))))


def tempo_confidence(strengths: Column) -> Column:
    """How far the strongest tempo of a profile stands out: its strength over the mean, a tenth of it, at most 1."""
    total = F.aggregate(strengths, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.coalesce(F.least(F.lit(1.0), F.try_divide(F.array_max(strengths).cast("double"), total / F.size(strengths)) / 10), F.lit(0.0))


def modulation(chroma: DataFrame, song: Sequence[str], frame: str, pitch: str, value: str, head: float = 0.6) -> DataFrame:
    """(song, key_head, key_tail, has_modulation): whether the key of the first part of a song's frames is that of the rest.

    Frames are numbered from 0; both parts are correlated with the key profiles in one pass.
    """
    frames = chroma.groupBy(*song).agg(((F.max(frame) + 1) * head).alias("_cut"))
    halves = chroma.join(frames, list(song)).withColumn("_part", F.when(F.col(frame) < F.col("_cut"), "head").otherwise("tail"))
    sums = halves.groupBy(*song, "_part", pitch).agg(F.sum(value).alias(value))
    keys = key_by_profile(sums, [*song, "_part"], pitch, value).select(*song, "_part", F.struct("tonic", "scale").alias("k"))
    both = keys.groupBy(*song).agg(*[F.max(F.when(F.col("_part") == p, F.col("k"))).alias(f"key_{p}") for p in ("head", "tail")])
    return both.withColumn("has_modulation", F.coalesce(F.col("key_head") != F.col("key_tail"), F.lit(False)))


def combined_energy(stems: DataFrame, mixes: DataFrame, song: Sequence[str], bar: str, value: str) -> DataFrame:
    """(song, bar, energy): levels of the full mix where a song has one, else the sum of its stems above the noise floor."""
    mixed = mixes.select(*song, bar, F.col(value).alias("energy"))
    without = stems.join(mixes.select(*song).distinct(), list(song), "left_anti")
    return mixed.unionByName(without.groupBy(*song, bar).agg(summed_above(F.col(value)).alias("energy")))


def polyphony_gate(ratio: Column) -> Column:
    return first_match([(ratio < 0.05, "solo"), (ratio > 0.15, "poly")], "next gate")


def band_levels(bins: DataFrame, key: Sequence[str], band: str, db: str, silence: float = -120.0) -> DataFrame:
    """(key, band, db, relative_db): mean power of the bins of a band in dB, and its distance from the mean of bands above silence."""
    levels = bins.groupBy(*key, band).agg((10 * F.log10(F.greatest(F.avg(F.pow(F.lit(10.0), F.col(db) / 10)), F.lit(10 ** (silence / 10))))).alias("db"))
    mean = F.avg(F.when(F.col("db") > silence + 1, F.col("db"))).over(Window.partitionBy(*key))
    return levels.withColumn("relative_db", F.col("db") - F.coalesce(mean, F.lit(silence)))


def ordered_ema(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, start: float, alpha: float) -> DataFrame:
    """(key, ema): start, then (1 - alpha) * old + alpha * value for each row in order. A key may have any number of rows."""
    return scans.affine_last(rows, key, order, F.lit(1 - alpha), alpha * F.col(value).cast("double"), "ema", start)


def running_emas(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, start: float, alpha: float, out: str = "ema") -> DataFrame:
    """Rows with the mean after them, of `ordered_ema`."""
    return scans.affine_scan(rows, key, order, F.lit(1 - alpha), alpha * F.col(value).cast("double"), out, start)


def sketched_quantiles(rows: DataFrame, key: Sequence[str], value: str, ranks: Sequence[float], size: int = 800) -> DataFrame:
    """(key, n, quantiles): values near these ranks, from a mergeable sketch of bounded size for each key.

    A task sketches its own rows of a key, and sketches are merged, so a key may have any number of rows and of distinct values. With
    `size` 800 a rank is off by less than 0.5 % with odds of 99 %, by the sketch's own theory; `ranks_of` measures it. NaN and null values are not counted.
    """
    x = F.col(value).cast("double")
    made = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*key).agg(F.kll_sketch_agg_double(x, size).alias("_s"))
    at = F.array(*[F.lit(float(r)) for r in ranks])
    return made.select(*key, F.kll_sketch_get_n_double("_s").alias("n"), F.kll_sketch_get_quantile_double("_s", at).alias("quantiles"))


def ranks_of(rows: DataFrame, key: Sequence[str], value: str, quantiles: DataFrame) -> DataFrame:
    """(key, ranks): the least and the greatest share of a key's rows that may stand below each of its quantiles, exactly."""
    x = F.col(value).cast("double")
    both = rows.where(x.isNotNull() & ~F.isnan(x)).join(quantiles.select(*key, "quantiles"), list(key))
    n = quantiles.select(F.max(F.size("quantiles"))).first()[0] or 0
    share = lambda test: F.avg(test.cast("double"))
    cuts = [F.struct(share(x < F.get("quantiles", F.lit(k))).alias("below"), share(x <= F.get("quantiles", F.lit(k))).alias("upto")) for k in range(n)]
    return both.groupBy(*key).agg(F.array(*cuts).alias("ranks"))


def dominant_colour(images: DataFrame, key: str, data: str, head: int = 256, tail: int = 64, samples: int = 200, levels: int = 8, none: str = "#333333") -> DataFrame:
    """(key, colour): the most frequent quantised byte triple of a file body, the first of equal ones.

    Too dark and too light colours are passed over where there are others; a body of less than ten triples has `none`.
    """
    from strandwork.functions.music import quantized

    n = F.length(data)
    start = F.least(F.lit(head), F.floor(n / 4))
    body = F.greatest(start + 3, n - tail) - start
    taken = F.least(F.lit(samples), F.floor(body / 3))
    step = 3 * F.greatest(F.lit(1), F.floor(body / F.greatest(F.lit(1), taken * 3)))
    rows = images.select(key, data, start.alias("start"), F.least(body, n - start).alias("body"), step.alias("step")).where((F.col("body") >= 30) & (F.floor(F.col("body") / 3) >= 10))
    byte = lambda at, k: F.conv(F.hex(F.substr(F.col(data), (at + 1 + k).cast("int"), F.lit(1))), 16, 10).cast("int")
    triple = lambda at: F.struct(at.alias("at"), *[quantized(byte(at, k), levels).alias(c) for k, c in enumerate("rgb")])
    places = F.transform(F.sequence(F.col("start"), F.col("start") + F.col("body") - 3, F.col("step")), triple)
    rgb = rows.select(key, F.explode(places).alias("p")).select(key, "p.*")  # the bytes stay behind
    total = F.col("r") + F.col("g") + F.col("b")
    counted = rgb.groupBy(key, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"), (-F.min("at")).alias("first"))
    usual = ((total > 30) & (total < 700)).alias("usual")
    best = counted.groupBy(key).agg(F.max_by(F.struct("r", "g", "b"), F.struct(usual, "n", "first")).alias("c"))
    colour = F.when(F.col("c").isNotNull(), F.format_string("#%02x%02x%02x", "c.r", "c.g", "c.b")).otherwise(F.lit(none))
    return images.select(key).join(best, key, "left").select(key, colour.alias("colour"))


def cache_totals(files: DataFrame, key: str, size: str) -> DataFrame:
    """(key, bytes, share) of each entry of a cache."""
    entries, total = files.groupBy(key).agg(F.sum(size).alias("bytes")), files.agg(F.sum(size).alias("_total"))
    return entries.join(F.broadcast(total)).select(key, "bytes", F.try_divide(F.col("bytes"), F.col("_total")).alias("share"))  # one row


def counts_of_all(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Counts by key including keys that no row has."""
    return dimension.select(key).distinct().join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def stem_character(rows: DataFrame, key: Sequence[str], value: str, floor: float = 0.001) -> DataFrame:
    """(key, mean, presence): rare, partial or constant by the share of bars above the floor."""
    stats = rows.groupBy(*key).agg(F.avg(value).alias("mean"), F.avg((F.col(value) > floor).cast("double")).alias("share"))
    return stats.select(*key, "mean", first_match([(F.col("share") < 0.3, "rare"), (F.col("share") < 0.6, "partial")], "constant").alias("presence"))


def dynamics(sections: DataFrame, key: Sequence[str], level: str) -> DataFrame:
    """(key, dynamics) by distinct energy levels: flat loud, wide or moderate."""
    stats = sections.groupBy(*key).agg(F.count_distinct(level).alias("n"), F.bool_or(F.col(level).isin("high", "peak")).alias("loud"))
    return stats.select(*key, first_match([((F.col("n") <= 2) & F.col("loud"), "flat loud"), (F.col("n") >= 4, "wide")], "moderate").alias("dynamics"))


def ranked_steps(times: Column) -> Column:
    """Entries of a map of step times, longest first, by name on ties."""
    return F.array_sort(F.map_entries(times), lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def arrangement_totals(sections: DataFrame, plan: str = "plan_id", bpm: str | None = None) -> DataFrame:
    """(plan, end, n_sections, labels[, seconds]) of plans' sections."""
    out = sections.groupBy(plan).agg(F.max("end_beat").alias("end"), F.count(F.lit(1)).alias("n_sections"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_beat", "label"))), lambda s: s["label"]), " > ").alias("labels"), *([F.first(bpm).alias("_bpm")] if bpm else []))
    return out.withColumn("seconds", F.col("end") * 60 / F.col("_bpm")).drop("_bpm") if bpm else out


def hit_classes(onsets: DataFrame, key: Sequence[str], low: str = "low", mid: str = "mid", high: str = "high", limits: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(key, kick, snare, hihat, total): onsets whose band holds more than its share of energy; one may count in several."""
    total = F.col(low) + F.col(mid) + F.col(high)
    share = lambda c, x: F.count_if(F.coalesce(F.try_divide(F.col(c), total) > x, F.lit(False)))
    return onsets.groupBy(*key).agg(share(low, limits[0]).alias("kick"), share(mid, limits[1]).alias("snare"), share(high, limits[2]).alias("hihat"), F.count(F.lit(1)).alias("total"))

"""Ordered-sequence operators as windows: smoothing, hysteresis, runs, sessions, repair, eviction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from strandwork.operators.scans import places, prefix_sums


def by(key: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def differences(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str = "diff") -> DataFrame:
    """Rows after the first of each key, with the change since the row before."""
    return rows.withColumn(out, F.col(value) - F.lag(value).over(by(key, order))).where(F.col(out).isNotNull())


def smoothed(value: str, w: WindowSpec, width: int = 4) -> Column:
    """Moving mean of an even or odd width in which missing neighbours count as 0: from width // 2 rows before on."""
    return F.sum(value).over(w.rowsBetween(-(width // 2), width - 1 - width // 2)) / width


def steps(rows: DataFrame, key: Sequence[str], order: str, value: str, out: str, width: int = 4) -> DataFrame:
    """Rows with how far the smoothed value is from that of the row before; null in the first of each key."""
    w = by(key, [order])
    return rows.withColumn("_s", smoothed(value, w, width)).withColumn(out, F.abs(F.col("_s") - F.lag("_s").over(w))).drop("_s")


def change_signal(rows: DataFrame, song: Sequence[str], bar: str, series: str, value: str, width: int = 4) -> DataFrame:
    """(song, bar, change): for each bar but the first, the largest step of any smoothed series."""
    d = steps(rows, [*song, series], bar, value, "_d", width).where("_d is not null")
    return d.groupBy(*song, bar).agg(F.max("_d").alias("change"))


def boundary_candidates(changes: DataFrame, song: Sequence[str], bar: str, factor: float = 3.0, floor: float = 0.05) -> DataFrame:
    """Local maxima of the change signal at or above max(factor * median, floor); a flat top counts once, in its middle."""
    w = by(song, [bar])
    rows = changes.dropna(subset=list(song)).withColumn("_limit", F.greatest(F.percentile("change", F.lit(0.5)).over(Window.partitionBy(*song)) * factor, F.lit(floor)))
    new = F.coalesce(F.lag("change").over(w) != F.col("change"), F.lit(True))
    runs = rows.withColumn("_run", F.sum(new.cast("int")).over(w)).groupBy(*song, "_run").agg(F.min(bar).alias("_a"), F.max(bar).alias("_b"), F.first("change").alias("change"), F.first("_limit").alias("_limit"))
    wr = by(song, ["_run"])
    before, after = F.lag("change").over(wr), F.lead("change").over(wr)
    peaks = runs.withColumn("_p", (before < F.col("change")) & (after < F.col("change"))).where(F.col("_p") & (F.col("change") >= F.col("_limit")))
    return peaks.select(*song, F.floor((F.col("_a") + F.col("_b")) / 2).cast("int").alias(bar), "change")


def spaced_peaks(peaks: Column, bar: str, distance: int) -> Column:
    """Sorted places of an array of structs (bar, change) that stay when, from the highest on, each removes those nearer than `distance`; of equal heights the later one stays."""
    highest = F.sort_array(F.transform(peaks, lambda p: F.struct(p["change"].alias("change"), p[bar].alias("bar"))), asc=False)
    near = lambda kept, p: F.exists(kept, lambda q: F.abs(q - p["bar"]) < distance)
    return F.array_sort(F.aggregate(highest, F.array().cast("array<int>"), lambda kept, p: F.when(near(kept, p), kept).otherwise(F.array_append(kept, p["bar"]))))


def boundaries(changes: DataFrame, song: Sequence[str], bar: str, distance: int = 4, factor: float = 3.0, floor: float = 0.05) -> DataFrame:
    """(song, bars): peaks of the change signal at least `distance` apart. Few candidates of a song meet in one array."""
    found = boundary_candidates(changes, song, bar, factor, floor).groupBy(*song).agg(F.collect_list(F.struct(bar, "change")).alias("p"))
    return found.select(*song, spaced_peaks(F.col("p"), bar, distance).alias("bars"))


def to_grid(marks: Column, total: Column, grid: int = 4, least: int = 4) -> Column:
    """Marks rounded half-even to a grid, each once and inside (0, total), without those next to a segment below `least`.

    Every pass drops all offenders at once; passes over the array are repeated as often as it has entries.
    """
    snapped = F.array_sort(F.array_distinct(F.transform(marks, lambda b: (F.rint(b / grid) * grid).cast("int"))))
    inside = F.filter(snapped, lambda b: (b > 0) & (b < total))

    def one(valid: Column) -> Column:
        points = F.concat(F.array(F.lit(0)), valid, F.array(total.cast("int")))
        return F.filter(valid, lambda b, i: (b - F.get(points, i) >= least) & (F.get(points, i + 2) - b >= least))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(inside), F.lit(0))), inside, lambda acc, _: one(acc))


def hysteresis(value: Column, onset: Column, sustain: Column, w: WindowSpec, keep_equal: bool = False) -> Column:
    """1 from a value above `onset` until one at or below `sustain` (below it with keep_equal), else 0. Needs onset >= sustain."""
    off = value < sustain if keep_equal else value <= sustain
    event = F.when(value > onset, 1).when(off, 0)
    return F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))


def runs(rows: DataFrame, key: Sequence[str], order: Sequence[str], state: str, out: str = "run") -> DataFrame:
    """Rows with the number of their run of equal states, from 1."""
    w = by(key, order)
    return rows.withColumn(out, F.sum(F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"), F.lit(1))).over(w))


def long_runs(rows: DataFrame, key: Sequence[str], order: Sequence[str], state: str, least: int, out: str = "kept") -> DataFrame:
    """Rows with whether they are true in a run of at least so many true rows."""
    marked = runs(rows, key, order, state, "_run")
    n = F.count(F.lit(1)).over(Window.partitionBy(*key, "_run"))
    return marked.withColumn(out, F.col(state).cast("boolean") & (n >= least)).drop("_run")


def gaps(rows: DataFrame, key: Sequence[str], order: str, state: str, least: int = 2) -> DataFrame:
    """(key, start, end, length) of runs of false rows, both ends included."""
    islands = runs(rows, key, [order], state, "_run").where(~F.col(state).cast("boolean")).groupBy(*key, "_run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"))
    return islands.where(F.col("length") >= least).drop("_run")


def activity(rows: DataFrame, key: Sequence[str], order: str, value: str, onset: float = 0.15, sustain: float = 0.08, least: int = 2) -> DataFrame:
    """Rows with `active`: hysteresis around shares of the key's peak, then runs of at least `least` rows."""
    peak = F.max(value).over(Window.partitionBy(*key))
    on = rows.withColumn("_on", (hysteresis(F.col(value), peak * onset, peak * sustain, by(key, [order])) == 1) & (peak > 0))
    return long_runs(on, key, [order], "_on", least, "active").drop("_on")


def drops(sections: DataFrame, key: Sequence[str], order: str, first: str, last: str, floor: float = 0.01, ratio: float = 1.5) -> DataFrame:
    """Sections with `is_drop`: it begins much louder than the one before ended."""
    prev = F.lag(last).over(by(key, [order]))
    return sections.withColumn("is_drop", F.coalesce((prev > floor) & (F.col(first) > prev * ratio), F.lit(False)))


def builds(rows: DataFrame, key: Sequence[str], order: str, value: str, floor: float = 0.01, ratio: float = 1.5, least: int = 4) -> DataFrame:
    """(key, is_build, first_quarter): whether a segment's last quarter is much louder than its first."""
    w = Window.partitionBy(*key)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(order))
    q = F.greatest(F.lit(1), F.floor(n / 4))
    parts = rows.withColumn("_h", k <= q).withColumn("_t", k > n - q).withColumn("_n", n)
    stats = parts.groupBy(*key).agg(F.avg(F.when(F.col("_h"), F.col(value))).alias("first_quarter"), F.avg(F.when(F.col("_t"), F.col(value))).alias("_last"), F.first("_n").alias("_n"))
    return stats.select(*key, builds_up(F.col("_n"), F.col("first_quarter"), F.col("_last"), floor, ratio, least).alias("is_build"), "first_quarter")


def builds_up(n: Column, first: Column, last: Column, floor: float = 0.01, ratio: float = 1.5, least: int = 4) -> Column:
    """Whether the last quarter of n bars is much louder than the first."""
    return (n >= least) & (first > floor) & (last > first * ratio)


def sessions(rows: DataFrame, key: Sequence[str], time: Column, order: Sequence[str], gap: float, out: str = "session") -> DataFrame:
    """Rows with the number of their session: a gap of more than `gap` begins the next."""
    w = by(key, order)
    return rows.withColumn(out, F.sum(F.coalesce((time - F.lag(time).over(w) > gap).cast("int"), F.lit(0))).over(w) + 1)


def changes_only(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    prev = F.lag(value).over(by(key, order))
    n = F.row_number().over(by(key, order))
    return rows.withColumn("_keep", (n == 1) | ~F.col(value).eqNullSafe(prev)).where("_keep").drop("_keep")


def merged_runs(sections: DataFrame, key: Sequence[str], order: str, label: str, start: str, end: str, ranked: dict[str, Column] | None = None) -> DataFrame:
    """Neighbours of equal label as one row from the first start to the last end, with each column's entry of highest rank."""
    marked = runs(sections, key, [order], label, "_run")
    best = [F.max_by(c, F.struct(r, (-F.col(order)).alias("_o"))).alias(c) for c, r in (ranked or {}).items()]
    return marked.groupBy(*key, "_run", label).agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_merged"), *best).withColumnRenamed("_run", order)


def repaired(intervals: DataFrame, key: Sequence[str], start: str, end: str, least: int = 4, transition: str | None = None, grid: int = 4, ties: Sequence[str] = ()) -> DataFrame:
    """Intervals in order of start, end and `ties`: overlaps cut and gaps above 1 closed at the next start, short ones dropped, the last end rounded up.

    Ends are set before short intervals are dropped, so a dropped one leaves a hole. A transition is at most half of its interval.
    """
    w = by(key, [start, end, *ties])
    nxt = F.lead(start).over(w)
    fixed = F.when((F.col(end) > nxt) | (nxt - F.col(end) > 1), nxt).otherwise(F.col(end))
    rows = intervals.withColumn("_e", fixed).where(F.col("_e") - F.col(start) >= least)
    last = F.lead(start).over(w).isNull()
    up = F.ceil(F.col("_e") / grid) * grid
    rows = rows.withColumn("_l", last).withColumn(end, F.when(F.col("_l"), up).otherwise(F.col("_e")).cast(intervals.schema[end].dataType))
    if transition:
        rows = rows.withColumn(transition, F.least(F.col(transition), F.floor((F.col("_e") - F.col(start)) / 2).cast(intervals.schema[transition].dataType)))
    return rows.drop("_e", "_l")


def duration_gate(plans: DataFrame, beats: str, bpm: str, material: str, wanted: float = 210.0, least: float = 0.7, most: float = 1.5) -> DataFrame:
    """Plans with `verdict` (short, long, ok) and `max_beats` at which long ones are cut."""
    seconds = F.col(beats) * 60 / F.col(bpm)
    short = seconds < F.least(F.lit(wanted), F.coalesce(material, F.lit(wanted))) * least
    verdict = F.when(short, "short").when(seconds > wanted * most, "long").otherwise("ok")
    return plans.withColumn("verdict", verdict).withColumn("max_beats", F.when(F.col("verdict") == "long", F.floor(F.lit(wanted * most) * F.col(bpm) / 60).cast("int")).otherwise(F.col(beats)))


def bar_grid(downbeats: Column, beats: Column, length: Column, rate: int = 22050, hop: int = 512) -> Column:
    """Sample places of bars: downbeats in seconds, else every fourth beat frame; inside the signal, each once, with its end."""
    from_down = F.transform(downbeats, lambda t: F.rint(t * rate).cast("int"))
    from_beats = F.filter(F.transform(beats, lambda b, i: F.when(i % 4 == 0, (b * hop).cast("int"))), lambda x: x.isNotNull())
    found = F.when(F.size(downbeats) >= 2, from_down).when(F.size(beats) >= 4, from_beats).otherwise(F.array(F.lit(0)))
    return F.array_append(F.array_sort(F.array_distinct(F.filter(found, lambda x: (x >= 0) & (x < length)))), length.cast("int"))


def rising_marks(marks: Column, total: Column, grid: int = 4, step: int = 8, least: int = 4) -> Column:
    """Marks snapped down to a grid; one that is not beyond the one before moves `step` on, and the last leave `least` free."""
    snap = lambda x: (F.floor(x / grid) * grid).cast("int")

    def add(acc: Column, mark: Column) -> Column:
        prev = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
        b = F.when(snap(mark) <= prev, snap(prev + step)).otherwise(snap(mark))
        top = total - least
        low = snap(top - 4)
        return F.array_append(acc, F.when(b >= top, F.when(low <= prev, prev + least).otherwise(low)).otherwise(b).cast("int"))

    return F.aggregate(marks, F.array().cast("array<int>"), add)


def evicted(entries: DataFrame, key: Sequence[str], age_order: Sequence[str], size: str, cap: float, protected: str | None = None) -> DataFrame:
    """The oldest entries that must go until the rest fits a cap; protected ones are passed over. A key may have any number of entries."""
    free = ~F.col(protected) if protected else F.lit(True)
    sums = {"_up": F.when(free, F.col(size)).otherwise(0), "_t": F.col(size)}
    rows = prefix_sums(entries, key, age_order, sums, whole=["_t"])
    return rows.where(free & (F.col("_t_all") - (F.col("_up") - F.col(size)) > cap)).select(*entries.columns)


def queue_positions(items: DataFrame, queue: Sequence[str], enqueued: Sequence[str], mean_s: float = 600.0) -> DataFrame:
    """Items with their place in the queue, from 1, and the seconds until their turn. A queue may have any number of items."""
    return places(items, queue, enqueued, "position").withColumn("eta_s", F.floor(F.col("position") * mean_s).cast("long"))


def high_water(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value exceeds every one before."""
    top = F.max(value).over(by(key, order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_m", top).where(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m")


def lookahead_min(value: str, w: WindowSpec, ahead: int) -> Column:
    return F.min(value).over(w.rowsBetween(0, ahead))


def level_windows(frames: DataFrame, key: Sequence[str], frame: str, energy: str, span: int = 4, floor: float = 10 ** (-45 / 20), percentile: float = 0.5, boost: float = 6.0, cut: float = 4.0) -> DataFrame:
    """(key, frame, level, gain_db) of overlapping windows of `span` hop frames: gains towards a percentile of the active levels.

    `energy` is a hop's mean square; a window needs all its hops. Windows below the floor are never boosted.
    """
    w = by(key, [frame]).rowsBetween(0, span - 1)
    levels = frames.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("level", F.sqrt(F.avg(energy).over(w) + 1e-20)).where(F.col("_n") == span)
    wanted = levels.where(F.col("level") > floor).groupBy(*key).agg(F.percentile("level", F.lit(percentile)).alias("_t"))
    db = 20 * F.log10(F.col("_t") / F.col("level"))
    gain = F.when(F.col("level") < floor, F.greatest(F.lit(-cut), F.least(F.lit(0.0), db))).otherwise(F.greatest(F.lit(-cut), F.least(F.lit(boost), db)))
    return levels.join(wanted, list(key), "left").select(*key, frame, "level", F.coalesce(gain, F.lit(0.0)).alias("gain_db"))


def transitions(sections: DataFrame, plan: Sequence[str], order: str, gain: str, longest: int = 8) -> DataFrame:
    """Changes of gain between sections: (plan, order, from_beat, to_beat, gain_from, gain_to), at most a third of the section long."""
    w = by(plan, [order])
    beats = F.least(F.col("transition_beats"), F.lit(longest), F.floor((F.col("end_beat") - F.col("start_beat")) / 3)).cast("int")
    rows = sections.withColumn("gain_from", F.lag(gain).over(w)).withColumn("_b", beats).withColumn("_last", F.max("end_beat").over(Window.partitionBy(*plan)))
    before = F.floor(F.col("_b") / 2).cast("int")
    kept = rows.where((F.col("_b") > 0) & F.col("gain_from").isNotNull() & (F.abs(F.col("gain_from") - F.col(gain)) >= 0.001))
    return kept.select(*plan, order, F.greatest(F.lit(0), F.col("start_beat") - before).alias("from_beat"), F.least("_last", F.col("start_beat") + F.col("_b") - before).alias("to_beat"), "gain_from", F.col(gain).alias("gain_to"))


def eased(gain_from: Column, gain_to: Column, t: Column) -> Column:
    """Cosine way between two gains, t from 0 to 1."""
    return gain_from + (gain_to - gain_from) * (1 - F.cos(t * F.pi())) / 2


def evenly(rows: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """At most n rows of each key, evenly from the first to the last."""
    w = Window.partitionBy(*key)
    ranked = rows.withColumn("_k", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    size = F.col("_n")
    # row k is one of floor(j * (size - 1) / (n - 1)) for the least j that reaches it
    j = F.ceil(F.col("_k") * (n - 1) / (size - 1))
    hit = (j < n) & (F.floor(j * (size - 1) / (n - 1)) == F.col("_k"))
    return ranked.where((size <= n) | hit).drop("_k", "_n")


def stretched_grid(redetected: Column, scaled: Column, end_beat: Column) -> Column:
    """The re-detected grid if it has more than 10 beats and the plan ends within 1.2 times them, else the scaled one."""
    return F.when((F.size(redetected) > 10) & (end_beat <= 1.2 * F.size(redetected)), redetected).otherwise(scaled)


def absorbed(sections: Column, least: int = 4) -> Column:
    """Sections (an array of structs with start, end, rank and any further fields, in order) after those shorter than `least` join
    their louder neighbour, the left one on ties, until none does or one is left.

    The greater rank and the outer bounds hold; further fields are those of the neighbour. Neighbours' ranks are those
    before the pass; what is merged to the left joins what the pass has already made of it. Each pass that changes
    anything shortens the array, so as many passes as it has entries are enough; a pass without short sections changes nothing.
    """
    short = lambda s: s["end"] - s["start"] < least
    joined = lambda into, start, end, other: into.withField("start", start).withField("end", end).withField("rank", F.greatest(into["rank"], other["rank"]))

    def one(now: Column) -> Column:
        nothing = F.filter(now, lambda _: F.lit(False))

        def step(state: Column, i: Column) -> Column:
            out, s = state["out"], F.get(now, i)
            left, right = F.coalesce(F.get(now, i - 1)["rank"], F.lit(-1)), F.coalesce(F.get(now, i + 1)["rank"], F.lit(-1))
            last, after = F.try_element_at(out, F.lit(-1)), F.get(now, i + 1)
            to_left = F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined(last, last["start"], s["end"], s)))
            to_right = F.array_append(out, joined(after, s["start"], after["end"], s))
            keeps = ~short(s) | (F.size(now) == 1)
            made = F.when(keeps, F.struct(F.array_append(out, s).alias("out"), F.lit(False).alias("skip")))
            made = made.when((i > 0) & (left >= right), F.struct(to_left.alias("out"), F.lit(False).alias("skip"))).otherwise(F.struct(to_right.alias("out"), F.lit(True).alias("skip")))
            return F.when(state["skip"], F.struct(out.alias("out"), F.lit(False).alias("skip"))).otherwise(made)

        pass_ = F.aggregate(F.sequence(F.lit(0), F.size(now) - 1), F.struct(nothing.alias("out"), F.lit(False).alias("skip")), step, lambda state: state["out"])
        return F.when((F.size(now) > 1) & F.exists(now, short), pass_).otherwise(now)

    return F.aggregate(F.sequence(F.lit(0), F.size(sections)), sections, lambda acc, _: one(acc))


def absorb_short(sections: DataFrame, key: Sequence[str], start: str, end: str, rank: str, least: int = 4) -> DataFrame:
    """(key, start, end, rank) of sections after `absorbed`. A song's sections meet in one array."""
    rows = sections.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(start).alias("start"), F.col(end).alias("end"), F.col(rank).alias("rank")))).alias("_s"))
    out = rows.select(*key, F.explode(absorbed(F.col("_s"), least)).alias("_s"))
    return out.select(*key, F.col("_s.start").alias(start), F.col("_s.end").alias(end), F.col("_s.rank").alias(rank))

"""Section analysis of songs from bar energies: boundaries, labels, merging; all songs at once.

Input is the fact table (song_id, stem, bar, rms).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandwork.functions.music import ENERGY_RANK, energy_class, rank_of
from strandwork.functions.rules import first_match
from strandwork.operators import aggregates as agg, scans, sequences as seq

SONG = ["song_id"]
SEGMENT = ["song_id", "segment"]
SPAN = ("segment", "total", "start_bar", "end_bar")
BUCKETS = ("p10", "p50", "p85")


def bar_states(bars: DataFrame, vocal: str = "vocals") -> DataFrame:
    """(song_id, bar, energy, norm, noise_floor, p10, p50, p85, energy_class, vocal_rms, vocal_active, change) of every bar.

    Levels and percentiles of a song are windows over its bars, which are few, so that bars are made once. `change` is the
    largest step of the smoothed stems and of the smoothed norm, null in the first bar.
    """
    c, song = F.col, Window.partitionBy(*SONG)
    stepped = seq.steps(bars.dropna(subset=SONG), ["song_id", "stem"], "bar", "rms", "_d")
    energy = stepped.groupBy("song_id", "bar").agg(agg.summed_above(c("rms")).alias("energy"), F.coalesce(F.max(F.when(c("stem") == vocal, c("rms"))), F.lit(0.0)).alias("vocal_rms"), F.max("_d").alias("_d"))
    p99 = F.percentile(F.when(c("energy") > 0, c("energy")), F.lit(0.99)).over(song)
    scaled = energy.withColumn("_p99", p99).withColumn("norm", agg.norm_of(c("energy"), c("_p99"))).withColumn("_p", agg.buckets_of(c("norm"), song))
    states = agg.classified(scaled.select("song_id", "bar", "energy", "norm", F.lit(agg.NOISE).alias("noise_floor"), *[F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)).alias(p) for k, p in enumerate(BUCKETS)], "vocal_rms", "_d"))
    active = seq.activity(seq.steps(states, SONG, "bar", "norm", "_n"), SONG, "bar", "vocal_rms").withColumnRenamed("active", "vocal_active")
    return active.withColumn("change", F.greatest("_d", "_n")).drop("_d", "_n")


def segments(states: DataFrame) -> DataFrame:
    """(song_id, segment, total, start_bar, end_bar): boundaries of the change signal on the four-bar grid; end exclusive."""
    found = seq.boundaries(states.where("change is not null").select("song_id", "bar", "change"), SONG, "bar")
    totals = states.groupBy("song_id").agg((F.max("bar") + 1).alias("total"))
    marks = totals.join(found, "song_id", "left").withColumn("m", seq.to_grid(F.coalesce("bars", F.array().cast("array<int>")), F.col("total")))
    edges = F.concat(F.array(F.lit(0)), "m", F.array(F.col("total").cast("int")))
    return marks.withColumn("e", edges).select("song_id", "total", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda i: F.struct(F.get(F.col("e"), i).alias("start_bar"), F.get(F.col("e"), i + 1).alias("end_bar")))).alias("segment", "s")).select("song_id", "segment", "total", "s.start_bar", "s.end_bar")


def within(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Bars with the segment that covers them, and its bounds: the last that starts at or before, by one ordered pass and no range join."""
    starts = spans.select("song_id", F.col("start_bar").alias("bar"), F.lit(0).alias("_o"), F.struct(*SPAN).alias("_s"))
    names = [c for c in rows.columns if c not in ("song_id", "bar")]
    both = starts.withColumn("_r", F.lit(None).cast(rows.select(F.struct(*names).alias("r")).schema["r"].dataType)).unionByName(rows.select("song_id", "bar", F.lit(1).alias("_o"), F.lit(None).cast(starts.schema["_s"].dataType).alias("_s"), F.struct(*names).alias("_r")))
    w = Window.partitionBy("song_id").orderBy("bar", "_o").rowsBetween(Window.unboundedPreceding, 0)
    covered = both.withColumn("_s", F.last("_s", ignorenulls=True).over(w)).where(F.col("_o") == 1)
    return covered.select("song_id", "bar", *[F.col(f"_s.{c}").alias(c) for c in SPAN], *[F.col(f"_r.{c}").alias(c) for c in names])


def told_by_bars(rows: DataFrame) -> DataFrame:
    """Segments with their bounds and what the states of their bars tell, in one grouping."""
    c, w = F.col, Window.partitionBy(*SEGMENT)
    placed = rows.where("segment is not null").withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy("bar")))
    third, in_last = agg.third_of(c("_k"), c("_n"))
    quarter, active = F.greatest(F.lit(1), F.floor(c("_n") / 4)), c("vocal_active").cast("double")
    mean = lambda test, value: F.avg(F.when(test, value))
    kept = [F.first(x).alias(x) for x in (*SPAN[1:], "noise_floor", *BUCKETS, "vocal_peak")]
    stats = placed.withColumn("_t", third).groupBy(*SEGMENT).agg(
        *kept, F.first("_n").alias("_n"), F.avg("norm").alias("mean"), F.bool_or("vocal_active").alias("has_vocals"), F.min_by("norm", "bar").alias("first_norm"), F.max_by("norm", "bar").alias("last_norm"), F.max("vocal_rms").alias("loudest_vocal"),
        F.avg(active).alias("_active"), mean(c("_t") == 1, active).alias("_head"), mean(in_last, active).alias("_tail"), mean(c("_k") <= quarter, c("norm")).alias("first_quarter"), mean(c("_k") > c("_n") - quarter, c("norm")).alias("_last"), *[mean(c("_t") == k, c("norm")).alias(f"_m{k}") for k in (1, 2, 3)],
    )
    levels = F.array_compact(F.array(*[F.when(c(m).isNotNull(), energy_class(c(m), c("noise_floor"), *map(c, BUCKETS))) for m in ("_m1", "_m2", "_m3")]))
    out = stats.withColumn("_levels", levels).withColumn("trajectory", agg.way(c("_levels"))).withColumn("vocal_status", agg.status_of(c("_active"), c("_head"), c("_tail"))).withColumn("is_build", seq.builds_up(c("_n"), c("first_quarter"), c("_last")))
    return out.drop("_n", "_active", "_head", "_tail", "_last", "_m1", "_m2", "_m3", "_levels")


def placed(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """Bars (song_id, stem, bar, rms) with `segment` and `vocal_active` of the covered bar; by one pass, as a join by two keys would deal songs anew."""
    kinds = {f.name: f.dataType for f in [*bars.schema, *rows.schema]}
    gone = lambda *names: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
    given = rows.select("song_id", *gone("stem"), "bar", *gone("rms"), "segment", "vocal_active", F.lit(False).alias("_own"))
    both = bars.dropna(subset=["song_id", "bar"]).select("song_id", "stem", "bar", "rms", *gone("segment", "vocal_active"), F.lit(True).alias("_own")).unionByName(given)
    w = Window.partitionBy("song_id", "bar")
    return both.withColumns({n: F.max(n).over(w) for n in ("segment", "vocal_active")}).where("_own").drop("_own")


def told_by_stems(bars: DataFrame, rows: DataFrame, drums: str, vocal: str) -> DataFrame:
    """(song_id, segment, density, prominence_db, drum_mean, drum_p25) from the stems' bars, grouped by stem and then by segment."""
    c, line = F.col, Window.partitionBy("song_id", "stem")
    positive = F.when((c("rms") > 0) & c("stem").isNotNull(), c("rms"))
    own = placed(bars, rows)
    own = own.withColumn("_p", F.percentile(positive, F.array(F.lit(0.25), F.lit(0.90))).over(line)).withColumn("_p25", F.get("_p", F.lit(0))).withColumn("_p90", F.get("_p", F.lit(1))).where("segment is not null")
    stems = own.groupBy(*SEGMENT, "stem").agg(F.avg("rms").alias("_mean"), F.max("rms").alias("_max"), F.first("_p25").alias("_p25"), F.first("_p90").alias("_p90"), F.count_if("vocal_active").alias("_n"), F.sum(F.when(c("vocal_active"), c("rms"))).alias("_sum"))
    of = lambda name, value: F.max(F.when(c("stem") == name, value))
    total = lambda test: F.coalesce(F.sum(F.when(test, c("_sum"))), F.lit(0.0))
    stats = stems.groupBy(*SEGMENT).agg(
        F.count_if(c("_mean") > c("_p25")).alias("_active"), F.coalesce(F.bool_or(c("_max") > c("_p90")), F.lit(False)).alias("_peak"), of(drums, c("_mean")).alias("drum_mean"), of(drums, c("_p25")).alias("drum_p25"),
        of(vocal, c("_n")).alias("_n"), total(c("stem") == vocal).alias("_v"), total(c("stem") != vocal).alias("_o"),
    )
    db = agg.prominence_of(c("_n"), F.try_divide("_v", "_n"), F.try_divide("_o", "_n"), 3)
    return stats.select(*SEGMENT, agg.density_of(c("_active"), c("_peak")).alias("density"), db.alias("prominence_db"), "drum_mean", "drum_p25")


def written(rows: DataFrame, tasks: int | None) -> DataFrame:
    """The rows written once for all that reads them, and dealt by song again, since a checkpoint does not tell how its rows lie."""
    return scans.cut(rows).repartition(*([tasks] if tasks else []), "song_id")


def labelled(bars: DataFrame, states: DataFrame, spans: DataFrame, drums: str = "drums", vocal: str = "vocals", tasks: int | None = None) -> DataFrame:
    """Sections with energy level, trajectory, density, vocal status, prominence, build and drop, and a label by the first rule that holds."""
    peak = F.max("vocal_rms").over(Window.partitionBy(*SONG))
    rows = written(within(states.select("song_id", "bar", "norm", "noise_floor", *BUCKETS, "vocal_rms", "vocal_active", peak.alias("vocal_peak")), spans), tasks)
    joined = told_by_bars(rows).join(told_by_stems(bars, rows, drums, vocal), SEGMENT, "left")
    c = F.col
    buckets = [c(x) for x in ("noise_floor", *BUCKETS)]
    level = energy_class(c("mean"), *buckets)
    calm_start = ~energy_class(c("first_quarter"), *buckets).isin("high", "peak")
    build = F.coalesce(c("is_build") & calm_start, F.lit(False))
    loud, low = level.isin("high", "peak"), level.isin("low", "silent")
    sung, quiet_drums = c("has_vocals"), F.coalesce(c("drum_mean") < c("drum_p25"), F.lit(True))
    last = c("end_bar") == c("total")
    label = first_match(
        [
            ((c("segment") == 0) & (low | ((level == "medium") & ~sung)), "intro"),
            (last & (low | (c("start_bar") / c("total") > 0.85)), "outro"),
            (build, "build"),
            (loud & sung, "chorus"),
            (loud, "instrumental"),
            (quiet_drums & sung, "breakdown"),
            ((level == "medium") & sung, "verse"),
            (~sung, "instrumental"),
        ],
        "verse",
    )
    out = joined.withColumn("energy_level", level).withColumn("label", label).withColumn("is_build", build)
    out = seq.drops(out, SONG, "segment", "first_norm", "last_norm")
    notes = F.array_sort(F.array_compact(F.array(F.when((c("vocal_peak") > 0) & (c("loudest_vocal") < c("vocal_peak") * 0.08), F.lit("GOOD INSTRUMENTAL SOURCE")), F.when(c("is_build"), F.lit("BUILD")), F.when(c("is_drop"), F.lit("DROP")))))
    return out.select(*SEGMENT, "start_bar", "end_bar", "label", "energy_level", "trajectory", "density", "vocal_status", F.round("prominence_db", 1).alias("prominence_db"), notes.alias("annotations"))


def merged(sections: DataFrame) -> DataFrame:
    """Neighbours of one label as one section; level, density and vocal status by rank, notes united and sorted."""
    from strandwork.functions.music import DENSITY_RANK

    marked = seq.runs(sections, SONG, ["segment"], "label", "run")
    by_rank = lambda col, ranks: F.max_by(col, F.struct(rank_of(F.col(col), ranks), -F.col("segment")))
    vox = {"vox:no": 0, "vox:fading": 1, "vox:yes": 2}
    parts = F.transform(F.array_sort(F.collect_list(F.struct("segment", "trajectory"))), lambda s: s["trajectory"])
    return marked.groupBy("song_id", "run", "label").agg(
        F.min("start_bar").alias("start_bar"), F.max("end_bar").alias("end_bar"), by_rank("energy_level", ENERGY_RANK).alias("energy_level"), by_rank("density", DENSITY_RANK).alias("density"), by_rank("vocal_status", vox).alias("vocal_status"),
        F.array_join(F.filter(parts, lambda x, i: (i == 0) | (x != F.get(parts, i - 1))), "->").alias("trajectory"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("annotations")))).alias("annotations"),
    ).withColumnRenamed("run", "section")


def analysed(bars: DataFrame, tasks: int | None = None) -> DataFrame:
    """Merged sections of all songs from their bar energies; bars that are dealt by song to so many `tasks` are not dealt again."""
    states = written(bar_states(bars).drop("energy", "energy_class"), tasks)
    return merged(labelled(bars, states, segments(states), tasks=tasks))


def enriched(bars: DataFrame, given: DataFrame) -> DataFrame:
    """Sections of another source (song_id, start_bar, end_bar, label), told by their bars: label and bounds stay, level, trajectory, density, vocals and notes are ours."""
    states = written(bar_states(bars).drop("energy", "energy_class"), None)
    totals = states.groupBy("song_id").agg((F.max("bar") + 1).alias("total"))
    spans = given.withColumn("segment", F.row_number().over(Window.partitionBy("song_id").orderBy("start_bar")) - 1).join(totals, "song_id")
    told = labelled(bars, states, spans.select("song_id", "segment", "total", "start_bar", "end_bar")).drop("label")
    return told.join(spans.select(*SEGMENT, "label"), SEGMENT).withColumn("section_source", F.lit("enriched"))


def healed(songs: DataFrame, bars: DataFrame) -> DataFrame:
    """Songs (song_id, energy, active, sections) whose energies are degenerate, computed anew from their stems' bars.

    A song is degenerate if it has neither a bar of energy nor an active one. Its sections stay unless it has none; songs
    without bars, and sound ones, stay as they are. `healed` tells which were.
    """
    from strandwork.functions.rules import silent

    broken = songs.where(silent(F.col("energy"), F.col("active"))).select("song_id")
    ours = bars.join(broken, "song_id", "left_semi")
    states = bar_states(ours).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("bar", "energy", "vocal_active"))).alias("_s"))
    made = analysed(ours).groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("start_bar", "end_bar", "label"))).alias("_sections"))
    rows = songs.join(states, "song_id", "left").join(made, "song_id", "left")
    fresh = F.col("_s").isNotNull()
    sections = F.when(fresh & (F.coalesce(F.size("sections"), F.lit(0)) == 0), F.col("_sections")).otherwise(F.col("sections"))
    take = lambda f, old: F.when(fresh, F.transform("_s", lambda x: x[f])).otherwise(F.col(old)).alias(old)
    return rows.select("song_id", take("energy", "energy"), take("vocal_active", "active"), sections.alias("sections"), fresh.alias("healed"))


def pair_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (loudness_diff_db, stretch_pct) for each pair of songs (pair_id, bpm, mean_rms) on two sides."""
    from strandwork.functions.music import loudness_diff, stretch_pct

    both = a.select("pair_id", F.col("bpm").alias("bpm_a"), F.col("mean_rms").alias("rms_a")).join(b.select("pair_id", F.col("bpm").alias("bpm_b"), F.col("mean_rms").alias("rms_b")), "pair_id")
    return both.select("pair_id", loudness_diff(F.col("rms_a"), F.col("rms_b")).alias("loudness_diff_db"), stretch_pct(F.col("bpm_a"), F.col("bpm_b")).alias("stretch_pct"))

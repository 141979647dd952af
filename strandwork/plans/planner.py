"""Arrangement planners: families of candidate plans from parameters, and a fallback layout.

Families are data: configurations, and section templates whose boundaries are shares of the whole or fixed beats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandwork.functions.keys import structure_key
from strandwork.functions.music import clamped_transition, material_budget, snapped, target_bpm
from strandwork.operators.scans import cut
from strandwork.operators.sequences import rising_marks
from strandwork.operators.topk import backfilled, first_per

STEMS = ("lead_vocals", "backing_vocals", "drums", "bass", "guitar", "piano", "other")
VOCAL = ("lead_vocals", "backing_vocals")
TARGET_S = 210.0
#: Plans that may be sent to all tasks; more are joined by a shuffle.
POOL_ROWS = 20_000
# Gains of STEMS by kind of section.
PRESETS = {
    "intro": (0.0, 0.0, 0.6, 0.5, 0.3, 0.2, 0.3),
    "outro": (0.0, 0.0, 0.5, 0.5, 0.3, 0.3, 0.4),
    "breakdown": (0.3, 0.0, 0.1, 0.4, 0.6, 0.7, 0.5),
    "build": (0.5, 0.0, 0.5, 0.6, 0.4, 0.3, 0.4),
    "main": (1.0, 0.3, 0.7, 0.7, 0.5, 0.4, 0.5),
    "peak": (1.0, 0.5, 0.8, 0.8, 0.6, 0.5, 0.6),
    "hook": (1.0, 0.4, 0.6, 0.6, 0.3, 0.3, 0.3),
    "verse": (0.9, 0.3, 0.7, 0.7, 0.5, 0.4, 0.5),
}
# Families with the labels of their sections, and per variant the inner boundaries (beats if above 1, else shares), the transition and its beats, and a vocal gain in dB.
FAMILIES = {
    "standard_arc": (("intro", "build", "main", "breakdown", "peak", "outro"), (
        ((16, 0.25, 0.60, 0.72, 0.88), "crossfade", 4, 0),
        ((8, 0.25, 0.50, 0.62, 0.88), "filter_sweep", 8, 0),
        ((24, 0.25, 0.70, 0.82, 0.88), "crossfade", 4, 0),
        ((16, 0.25, 0.60, 0.72, 0.88), "cut", 2, 0),
    )),
    "hook_first": (("intro", "hook", "verse", "peak", "outro"), (
        ((8, 0.20, 0.55, 0.85), "crossfade", 4, 0),
        ((4, 0.20, 0.55, 0.85), "cut", 2, 3),
        ((8, 0.20, 0.55, 0.85), "crossfade", 4, -3),
    )),
    "dj_lift": (("build", "main", "peak", "breakdown", "outro"), (
        ((0.18, 0.45, 0.78, 0.88), "filter_sweep", 8, 0),
        ((0.25, 0.45, 0.78, 0.88), "crossfade", 4, 0),
        ((0.15, 0.45, 0.78, 0.88), "filter_sweep", 4, 0),
    )),
    "quick_hit": (("intro", "main", "outro"), (
        ((0.08, 0.80), "cut", 2, 0),
        ((0.08, 0.80), "silence_gap", 4, 3),
        ((0.08, 0.80), "crossfade", 4, -3),
    )),
}
#: Families whose first section fades in over 2 beats; the others take 4.
SHORT_FADE = ("hook_first", "quick_hit")
#: Sections whose gains a variant's vocal gain does not move.
UNMOVED = ("intro", "outro")


def budgets(pairs: DataFrame) -> DataFrame:
    """(…, target_bpm, total_beats) of song pairs (bpm_a, duration_a, bpm_b, duration_b): what target and material allow, on the grid, 32 at least."""
    c = F.col
    rows = pairs.withColumn("target_bpm", target_bpm(c("bpm_a"), c("bpm_b")))
    ideal = F.floor(c("target_bpm") * TARGET_S / 60)
    material = F.floor(c("target_bpm") * material_budget(c("bpm_a"), c("duration_a"), c("bpm_b"), c("duration_b"), c("target_bpm")) / 60)
    return rows.withColumn("total_beats", F.greatest(F.lit(32), snapped(F.least(ideal, material))))


def source_window(duration: Column) -> Column:
    """struct<start, end> of the part of a song that a plan uses."""
    return F.struct((duration * 0.25).alias("start"), F.least(duration * 0.25 + TARGET_S, duration).alias("end"))


def moved_gain(gain: float, db: float, vocal: bool) -> float:
    """A gain after vocals are moved by so many dB and everything else by half as many the other way, within 0 and 1."""
    return max(0.0, min(1.0, gain * 10 ** ((db / 20) if vocal else -(db / 40))))


def variants(spark: SparkSession) -> DataFrame:
    """The families' variants as rows; gains of their sections, in the order of STEMS, are constants of each."""
    rows = [
        (fi, family, vi, list(labels), [float(m) for m in marks], transition, beats, 2 if family in SHORT_FADE else 4, [[g if label in UNMOVED else moved_gain(g, db, s in VOCAL) for s, g in zip(STEMS, PRESETS[label])] for label in labels])
        for fi, (family, (labels, configs)) in enumerate(FAMILIES.items())
        for vi, (marks, transition, beats, db) in enumerate(configs)
    ]
    return spark.createDataFrame(rows, "family_pos int, family string, variant int, labels array<string>, marks array<double>, transition string, beats int, fade int, preset array<array<double>>")


def generated(pairs: DataFrame) -> DataFrame:
    """(plan key columns, family_pos, family, variant, sections) of every family and variant for each row with a total of beats."""
    rows = pairs.crossJoin(F.broadcast(variants(pairs.sparkSession)))  # 13 variants
    total = F.col("total_beats")
    marks = F.transform("marks", lambda m: F.floor(F.when(m > 1, m).otherwise(total * m)).cast("int"))
    edges = F.concat(F.array(F.lit(0)), rising_marks(marks, total), F.array(total.cast("int")))
    rows = rows.withColumn("edges", edges)
    n = F.size("labels")

    def section(label: Column, i: Column) -> Column:
        start, end = F.get(F.col("edges"), i), F.get(F.col("edges"), i + 1)
        kind = F.when(i == 0, "fade").when(i == n - 1, "crossfade").otherwise(F.col("transition"))
        beats = F.when(i == 0, F.col("fade")).when(i == n - 1, 4).otherwise(F.col("beats"))
        return F.struct(label.alias("label"), start.alias("start_beat"), end.alias("end_beat"), F.map_from_arrays(F.array(*map(F.lit, STEMS)), F.get("preset", i)).alias("stem_gains"), kind.alias("transition_in"), clamped_transition(beats, end - start).alias("transition_beats"))

    return rows.withColumn("sections", F.transform("labels", section)).select(*pairs.columns, "family_pos", "family", "variant", "sections")


def pool(totals: DataFrame, least: int = 8, most: int = 12, spare: DataFrame | None = None) -> DataFrame:
    """(total_beats, family_pos, family, variant, sections, hash): the plans of each total, at least and at most so many.

    Of plans with one structure the first by family and variant stays. Where fewer than `least` are left, `spare` plans (of
    the same columns, by default the families' own, which add none that is new) fill up, families with fewest plans first. All
    of a plan but its pair follows from the total, so a pool has as many rows as there are totals and variants.
    """
    order = ["family_pos", "variant"]
    plans = generated(totals.select("total_beats").distinct()).withColumn("hash", structure_key(F.col("sections")))
    one = ["total_beats", "hash"]
    kept = first_per(plans, one, order)
    if spare is not None:
        fresh = first_per(spare.select(*plans.columns).join(kept.select(*one), one, "left_anti"), one, order)
        size = kept.groupBy("total_beats", "family").agg(F.count(F.lit(1)).alias("_c"))
        room = kept.groupBy("total_beats").agg((F.lit(least) - F.count(F.lit(1))).alias("_room"))
        ranked = fresh.join(size, ["total_beats", "family"], "left").join(room.where("_room > 0"), "total_beats")
        place = F.row_number().over(Window.partitionBy("total_beats").orderBy(F.coalesce("_c", F.lit(0)), *order))
        kept = kept.unionByName(ranked.withColumn("_p", place).where("_p <= _room").select(*plans.columns))
    return first_per(kept, ["total_beats"], order, most)


def candidates(pairs: DataFrame, least: int = 8, most: int = 12, spare: DataFrame | None = None) -> DataFrame:
    """Distinct plans of each pair in order of family and variant, each with its structure key.

    Plans are made once for each total of beats, and a pool of up to POOL_ROWS plans is sent to the pairs; they are not shuffled.
    """
    rows = budgets(pairs)
    totals = cut(rows.select("total_beats").distinct())
    plans = pool(totals, least, most, spare)
    few = totals.count() * sum(len(v) for _, v in FAMILIES.values()) <= POOL_ROWS
    return rows.join(F.broadcast(plans) if few else plans, "total_beats")


def filled(kept: DataFrame, spare: DataFrame, least: int) -> DataFrame:
    """Plans of one pair with spare ones until there are enough, least represented families first."""
    rank = lambda d: d.withColumn("_place", F.col("family_pos") * 1000 + F.col("variant"))
    return backfilled(rank(kept), rank(spare), "hash", "family", "_place", least).drop("_place")


def family_counts(plans: DataFrame) -> DataFrame:
    """(family, n) with the families that no plan is of."""
    names = plans.sparkSession.createDataFrame([(f,) for f in FAMILIES], "family string")
    return names.join(plans.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "family", "left").select("family", F.coalesce("n", F.lit(0)).alias("n"))


# Fallback layouts with least beats, labels, shares of the inner boundaries, lead and backing vocals and the instrumental preset of each section.
BODY, INTRO, BREAK, OUTRO, BRIDGE = (0.7, 0.7, 0.5, 0.4, 0.5), (0.6, 0.5, 0.3, 0.2, 0.3), (0.1, 0.4, 0.6, 0.7, 0.5), (0.5, 0.5, 0.3, 0.3, 0.4), (0.3, 0.5, 0.7, 0.6, 0.5)
LAYOUTS = (
    (192, (("intro", 0.0, 0.0, INTRO), ("verse", 0.9, 0.0, BODY), ("drop", 1.0, 0.4, BODY), ("breakdown", 0.3, 0.0, BREAK), ("verse", 0.9, 0.0, BODY), ("drop", 1.0, 0.4, BODY), ("breakdown", 0.5, 0.0, BRIDGE), ("outro", 0.0, 0.0, OUTRO)), (0.08, 0.23, 0.35, 0.43, 0.58, 0.70, 0.82)),
    (96, (("intro", 0.0, 0.0, INTRO), ("build", 0.5, 0.0, BODY), ("main", 1.0, 0.3, BODY), ("breakdown", 0.4, 0.0, BREAK), ("drop", 0.8, 0.3, BODY), ("outro", 0.0, 0.0, OUTRO)), (0.125, 0.25, 0.625, 0.75, 0.875)),
    (0, (("intro", 0.0, 0.0, INTRO), ("build", 0.5, 0.0, BODY), ("main", 1.0, 0.3, BODY), ("breakdown", 0.4, 0.0, BREAK), ("outro", 0.0, 0.0, OUTRO)), (0.125, 0.25, 0.75, 0.875)),
)
PHRASE, LEAST_SECTION, UNSNAPPED_BELOW = 16, 8, 48


def _edges(total: Column, shares: tuple[float, ...]) -> Column:
    """Inner boundaries snapped down to phrases (short arrangements not), each at least 8 beats after the one before and 8 a section before the end."""
    n, out = len(shares), []
    for k, share in enumerate(shares):
        raw = F.floor(total * share)
        at = F.when(total < UNSNAPPED_BELOW, raw).otherwise(F.floor(raw / PHRASE) * PHRASE)
        prev = out[-1] if out else F.lit(0)
        fitted = F.greatest(prev + LEAST_SECTION, F.least(at, total - (n - k) * LEAST_SECTION))
        out.append(F.when(total < UNSNAPPED_BELOW, at).otherwise(fitted).cast("int"))
    return F.array(*out)


def fallback(pairs: DataFrame) -> DataFrame:
    """Pairs with a budget, and `sections`: an 8-, 6- or 5-section layout by total beats."""
    total, chain = F.col("total_beats"), None
    for least, sections, shares in LAYOUTS:
        edges = F.concat(F.array(F.lit(0)), _edges(total, shares), F.array(total.cast("int")))
        last = len(sections) - 1
        built = []
        for i, (label, lead, backing, rest) in enumerate(sections):
            start, end = F.get(edges, F.lit(i)), F.get(edges, F.lit(i + 1))
            beats = F.lit(4) if i == 0 else F.greatest(F.lit(1), F.least(F.lit(8), F.floor((end - start) / (2 if i == last else 3))))
            gains = F.create_map(*[x for s, g in zip(STEMS, (lead, backing, *rest)) for x in (F.lit(s), F.lit(g))])
            built.append(F.struct(F.lit(label).alias("label"), start.alias("start_beat"), end.alias("end_beat"), gains.alias("stem_gains"), F.lit("fade" if i == 0 else "crossfade").alias("transition_in"), beats.cast("int").alias("transition_beats")))
        made = F.array(*built)
        chain = F.when(total >= least, made) if chain is None else chain.when(total >= least, made)
    return pairs.withColumn("sections", chain)


def explained(plans: DataFrame, key: str) -> DataFrame:
    """(key, idx, label, start_beat, end_beat, stem, gain): the long form of plans."""
    s = plans.select(key, F.posexplode("sections").alias("idx", "s"))
    return s.select(key, "idx", "s.label", "s.start_beat", "s.end_beat", F.explode("s.stem_gains").alias("stem", "gain"))


def chosen(intended: DataFrame, spare: DataFrame, key: str) -> DataFrame:
    """The intended plan of each key, else the fallback, with `used_fallback`."""
    return spare.alias("f").join(intended.alias("i"), key, "left").select(key, F.coalesce("i.sections", "f.sections").alias("sections"), F.col("i.sections").isNull().alias("used_fallback"))

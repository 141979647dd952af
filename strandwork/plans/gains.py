"""From intended roles to gains: a base by role, energy and loudness, then four constraints in order, each one window pass.

Rows are (plan_id, idx, label, energy, stem, role, lufs); stems without a role are silent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandwork.functions.music import lufs_adjustment
from strandwork.functions.rules import lookup

STEMS = ("lead_vocals", "backing_vocals", "drums", "bass", "guitar", "piano", "other")
INSTRUMENTAL = ("drums", "bass", "guitar", "piano", "other")
BASE = {"lead": 0.92, "support": 0.82, "background": 0.55, "texture": 0.30, "silent": 0.0}
ENERGY = {"low": 0.75, "medium": 0.90, "high": 1.0, "peak": 1.05}
FLOORS = {"support": 0.60, "background": 0.40, "texture": 0.20}
ENERGY_RANK = {"peak": 4, "high": 3, "medium": 2, "low": 1}
#: Least total gain of a section, by label.
BUDGET = {"intro": 1.5, "outro": 1.5, "verse": 3.0, "bridge": 3.0, "chorus": 4.0, "drop": 4.0, "breakdown": 2.0}
LEAST_ACTIVE, ACTIVE_ABOVE, MOST_MUTED = 3, 0.10, 0.15
BUMP, UNMUTE = 0.30, 0.25


def every_stem(sections: DataFrame) -> DataFrame:
    """Long rows of sections (plan_id, idx, label, energy, stem_roles map), one for each stem in order."""
    stems = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(s).alias("stem")) for k, s in enumerate(STEMS)])
    rows = sections.withColumn("_s", F.explode(stems))
    return rows.select("plan_id", "idx", "label", "energy", F.col("_s.pos").alias("pos"), F.col("_s.stem").alias("stem"), F.coalesce(F.try_element_at("stem_roles", F.col("_s.stem")), F.lit("silent")).alias("role"))


def base_gains(rows: DataFrame) -> DataFrame:
    """Rows with `gain` by role, energy and loudness, within 0 and 1 and not below the role's floor."""
    role, sounding = F.col("role"), F.col("role") != "silent"
    gain = lookup(role, BASE, 0.0) * lookup(F.col("energy"), ENERGY, 0.90)
    gain = gain * F.when(sounding & F.col("lufs").isNotNull(), lufs_adjustment(F.col("lufs"))).otherwise(F.lit(1.0))
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain))
    return rows.withColumn("gain", F.when(sounding, F.greatest(gain, lookup(role, FLOORS, 0.0))).otherwise(gain))


def _instrumental() -> F.Column:
    return F.col("stem").isin(*INSTRUMENTAL)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with `n_instrumental`, the instrumental entries of their plan. As the first window it deals rows by plan, if they do not lie so yet."""
    return rows.withColumn("n_instrumental", F.count_if(_instrumental()).over(Window.partitionBy("plan_id")))


def least_active(rows: DataFrame) -> DataFrame:
    """Sections but intro and outro: the quietest inactive instrumental stems come up until three are active."""
    section = Window.partitionBy("plan_id", "idx")
    low = _instrumental() & (F.col("gain") <= ACTIVE_ABOVE)
    active = F.count_if(_instrumental() & (F.col("gain") > ACTIVE_ABOVE)).over(section)
    turn = F.row_number().over(section.orderBy(F.when(low, 0).otherwise(1), "gain", "pos"))
    up = low & ~F.col("label").isin("intro", "outro") & (turn <= LEAST_ACTIVE - active)
    return rows.withColumn("gain", F.when(up, F.lit(BUMP)).otherwise(F.col("gain")))


def none_muted(rows: DataFrame) -> DataFrame:
    """An instrumental stem that is silent everywhere comes up in the section of most energy, the first of equal ones."""
    stem = Window.partitionBy("plan_id", "stem")
    best = F.row_number().over(stem.orderBy(F.desc(lookup(F.col("energy"), ENERGY_RANK, 0)), "idx")) == 1
    up = _instrumental() & (F.max("gain").over(stem) == 0) & best
    return rows.withColumn("gain", F.when(up, F.lit(BUMP)).otherwise(F.col("gain")))


def muting_budget(rows: DataFrame) -> DataFrame:
    """At most 15 % of instrumental entries stay silent: those in sections of most energy come up first. Rows are `numbered`."""
    plan = Window.partitionBy("plan_id")
    zero = _instrumental() & (F.col("gain") == 0)
    excess = F.count_if(zero).over(plan) - F.floor(F.col("n_instrumental") * MOST_MUTED)
    turn = F.row_number().over(plan.orderBy(F.when(zero, 0).otherwise(1), F.desc(lookup(F.col("energy"), ENERGY_RANK, 0)), "idx", "pos"))
    return rows.withColumn("gain", F.when(zero & (turn <= excess), F.lit(UNMUTE)).otherwise(F.col("gain")))


def energy_budget(rows: DataFrame) -> DataFrame:
    """A section below its label's least total is scaled up to it, each stem to 1 at most; none is scaled down."""
    total = F.sum("gain").over(Window.partitionBy("plan_id", "idx"))
    least = lookup(F.col("label"), BUDGET)
    scaled = F.least(F.lit(1.0), F.col("gain") * F.try_divide(least, total))
    return rows.withColumn("gain", F.when((total < least - 1e-12) & (F.col("gain") > 0), scaled).otherwise(F.col("gain")))


def gains(rows: DataFrame) -> DataFrame:
    """All steps in order; later constraints see what earlier ones have changed. Each window's key holds the plan, so rows are shuffled
    once, by plan, and not at all if they lie so already."""
    return energy_budget(muting_budget(none_muted(least_active(numbered(base_gains(rows)))))).drop("n_instrumental")


def assembled(rows: DataFrame) -> DataFrame:
    """(plan_id, idx, stem_gains map)."""
    return rows.groupBy("plan_id", "idx").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stem", "gain"))), lambda s: F.struct(s["stem"], s["gain"]))).alias("stem_gains"))

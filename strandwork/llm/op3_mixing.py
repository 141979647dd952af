"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

A source's share rises with its weight until it would repeat its documents more than `max_epochs` times; what
it cannot take goes to the others by weight. On sources sorted by cap per weight the water level has a closed
form: running sums of caps before and of weights from each source on. A source then takes every document
floor(target / size) times and fills what is left, in seeded hash order, with further whole documents and a
beginning of the one at which it is full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strandwork.llm.common import Scratch

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the seeded hash by which a source is split for its running sum: 4096 parts.
SPLIT_DIGITS = 3


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_key, source_size, target) of each source of (source, source_key, size).

    One row a source goes into the windows. Targets add up to the size of all sources.
    """
    by_name, every = Window.orderBy(F.col("source").isNull(), "source"), Window.partitionBy()
    sources = sized.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    number = (F.row_number().over(by_name) - 1) % len(weights) + 1
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), number.cast("int")))
    sources = sources.withColumn("cap", F.col("source_size") * max_epochs).withColumn("fill", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fill", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("fill", "source_key").rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    sources = sources.withColumn("level", left / F.sum("weight").over(onward))
    # the first source that the level of its turn does not clamp sets the level of all that follow
    water = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "source_key", "level"))).over(every)["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(water, F.lit(0.0)) * F.col("weight"))
    return sources.select("source_key", "source_size", target.alias("target"))


#: Columns that the mix makes.
OWN = {"doc_id", "source", "source_key", "source_size", "size", "turn", "part", "part_size", "part_start", "start", "target", "whole", "extra", "taken"}


def mix(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, whole, extra, taken) of every document.

    `size` counts words, null texts have none. `whole` is how often a document is taken whole, `extra` how many
    of its first words are taken once more, `taken` = whole * size + extra <= max_epochs * size. The taken words of
    a source differ from its target by less than one word. A null source is a source of its own and sorts last;
    null ids are allowed; rows with equal ids are documents of their own; an empty table gives no rows; a source
    without words has target 0. Columns `keep` follow and settle ties; one that is called like a column of the mix
    gets `_kept` at its end. Other columns are not read. The seeded hash makes reruns agree.

    A source may hold any share of the rows: sums are partial before they are shuffled, and its running sum is
    split by leading digits of the hash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [f"{k}_kept" if k in OWN else k for k in keep]
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source_key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))).alias("turn"),
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keep, kept)],
    ).withColumn("part", F.substring("turn", 1, SPLIT_DIGITS))
    sized = scratch.table(sized, "sized")
    targets = source_targets(sized, weights, max_epochs)
    earlier = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sized.groupBy("source_key", "part").agg(F.sum("size").alias("part_size"))
    parts = parts.select("source_key", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"))
    parts = parts.join(targets, "source_key")
    within = Window.partitionBy("source_key", "part").orderBy("turn", "size", *[F.col(f"`{n}`") for n in kept]).rowsBetween(Window.unboundedPreceding, -1)
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    placed = sized.join(parts, ["source_key", "part"]).withColumn("start", F.col("part_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    room = F.round("target").cast("long") - F.col("whole") * F.col("source_size") - F.col("start")
    return (
        placed.withColumn("whole", whole)
        .withColumn("extra", F.greatest(F.lit(0), F.least("size", room)))
        .select("doc_id", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), *[F.col(f"`{n}`") for n in kept])
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def repeat(docs: DataFrame, plan: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", plan_id_col: str = "doc_id") -> DataFrame:
    """Each document as often as `plan` (from `mix`, one row an id, which is its `plan_id_col`) takes it; the columns of `docs`.

    The last repetition may be a beginning of the text, whose length then replaces `n_chars_col`. Ids of `docs`
    must be unique; of repeated ids every row is repeated by every plan row of the id.
    """
    plan = plan.select(F.struct(F.col(plan_id_col).alias("id"), "size", "whole", "extra").alias("p")).where("p.whole > 0 or p.extra > 0")
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))  # whatever its columns are called
    own = F.col("d")
    rows = held.join(plan, own[id_col].eqNullSafe(F.col("p.id")))
    times = (F.col("p.whole") + (F.col("p.extra") > 0).cast("int")).cast("int")
    rows = rows.select("d", "p", F.explode(F.sequence(F.lit(1), times)).alias("turn"))
    cut = (F.col("turn") > F.col("p.whole")) & (F.col("p.extra") < F.col("p.size"))
    rows = rows.select("d", cut.alias("cut"), F.when(cut, first_words(own[text_col], F.col("p.extra"))).otherwise(own[text_col]).alias("text"))
    new = {text_col: F.col("text")}
    if n_chars_col in docs.columns:
        new[n_chars_col] = F.when(F.col("cut"), F.length("text").cast("long")).otherwise(own[n_chars_col])
    return rows.select(*[new.get(c, own[c]).alias(c) for c in docs.columns])


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}' || coalesce(':' || doc_id, '')) AS turn
  FROM documents),
named AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight
  FROM sized GROUP BY source),
capped AS (
  SELECT *, 3 * source_size AS cap, 3 * source_size / weight::DOUBLE AS fill FROM named),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, source IS NOT NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY fill, source IS NOT NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM capped),
targets AS (
  SELECT source, source_size,
         least(cap::DOUBLE, coalesce((SELECT level FROM levels WHERE level <= fill ORDER BY fill, source IS NOT NULL, source LIMIT 1), 0) * weight) AS target
  FROM levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size = 0 THEN 0 ELSE floor(t.target / t.source_size) END::BIGINT AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       whole * size + greatest(0, least(size, round(target)::BIGINT - whole * source_size - start)) AS taken
FROM placed
"""

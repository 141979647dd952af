"""From raw documents to packed training windows: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it and hands it to the next. All
but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.llm import op2_jaccard, op3_mixing, op4_language, op5_weak_labels, op9_packing
from strandwork.llm.common import Scratch, cleared

#: A text of whose n-grams its language has less than this part of what it has of nearly every text that it was learnt
#: from (all but this share of them) is in no learned language. The limit rests on all learned rows.
LEAST_KNOWN, LEARNT_BELOW = 0.5, 0.05
#: Words of a shingle and least similarity, in percent, of near copies; the query of op2 has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: Bytes of texts that go to a Python worker at once: by rows alone, long texts would fill it and Spark's own buffers.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold BATCH_BYTES at most, or one row."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, or in none of the learned languages, go. An empty table stays empty, as in all stages.

    The limit is on how much of a text its language explains, so it does not depend on the number of languages.
    """
    bounded_batches(spark)
    learnt = docs.where(~F.coalesce(op4_language.remainder(F.col("doc_id")) == 2, F.lit(False)))
    guess = op4_language.predict(spark, op4_language.fit(learnt))
    # one expression: a filter would stand between two guesses, and each task would hold two Python workers
    g = guess(F.col("text"))
    known = learnt.where("lang is not null").select(F.when(g["lang"] != op4_language.UNKNOWN, g["known"]).alias("known"))
    usual = known.agg(F.percentile_approx("known", LEARNT_BELOW, 10_000)).first()[0] or 0.0
    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), guess(F.col("text")).alias("g"))
    return scored.where((F.col("g.lang") != op4_language.UNKNOWN) & (F.col("g.known") >= LEAST_KNOWN * usual)).select("d.*")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below its threshold go."""
    bounded_batches(spark)
    _, linear = op5_weak_labels.fit(docs)
    return docs.where(op5_weak_labels.scorer(spark, linear)(F.col("text")) >= op5_weak_labels.THRESHOLD)


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """`docs`, written once with a number of its own for each row, since ids may be null or stand twice; and the number's name."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return scratch.table(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of similar documents the one with the least id stays, once.

    A document without an id stays only if none of its group has one; ties go by source, language and text.
    Documents without a word are in no group.
    """
    bounded_batches(spark)
    rows, row = numbered(docs, Scratch(spark, "rows"))
    classes = op2_jaccard.similar_classes(spark, rows, Scratch(spark, "dedupe"), id_col=row, words=NEAR_WORDS, percent=NEAR_PERCENT)
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "source", "lang", F.xxhash64("text"), F.col(row).alias("row"))
    ranks = rows.select(F.col(row).alias("row"), rank.alias("rank"))
    kept = ranks.join(classes.select(F.col("doc_id").alias("row"), "component_id"), "row").groupBy("component_id").agg(F.min("rank")["row"].alias("kept"))
    return rows.join(kept, F.col(row) == F.col("kept"), "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: every document as often as the mix takes it."""
    bounded_batches(spark)
    rows, row = numbered(docs, Scratch(spark, "rows"))
    plan = op3_mixing.mix(spark, rows, Scratch(spark, "mix"), keep=[row])
    return op3_mixing.repeat(rows, plan, id_col=row, plan_id_col=row).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: token pieces of all documents in windows."""
    bounded_batches(spark)
    return op9_packing.pack(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("quality_classifier", keep_good_quality),
    ("ngram_jaccard_join", keep_one_of_similar),
    ("mixing_sources", mix_sources),
    ("packing", pack_windows),
]

#: Language models, vote patterns and token ids have no SQL; tests/llm holds the brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`, each written and read again before the next."""
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        with cleared(spark):
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)

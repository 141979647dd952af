"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.llm import op1_ogg, op2_jaccard, op3_mixing, op4_language, op5_weak_labels, op6_html, op7_wavelet, op8_chat, op9_packing, op10_forest, op11_phrases, op12_trie, op13_patterns
from strandwork.llm.common import Scratch, documents


def op1_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", op1_ogg.encode(F.col("text")).alias("media"))
    rows = rows.withColumn("d", op1_ogg.decode(F.col("media")))
    d = lambda f: F.col(f"d.{f}")
    feature = F.format_string("pages=%d bad=%d lost=%d streams=%d packets=%d seconds=%.6f", d("pages"), d("bad_pages"), d("lost"), d("streams"), d("packets"), d("seconds"))
    return rows.select(
        "doc_id",
        d("n_bytes").alias("n_bytes"),
        F.octet_length(d("payload")).cast("long").alias("payload_bytes"),
        F.sha2(d("payload"), 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(d.payload, -16, 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_jaccard.similar_classes(spark, documents(spark, sf_dir), Scratch(spark, "op2"))


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixing.mix(spark, documents(spark, sf_dir), Scratch(spark, "op3")).select("doc_id", "size", "source_size", "target", "taken")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_language.identify(spark, documents(spark, sf_dir))


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_weak_labels.classify(spark, documents(spark, sf_dir))


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", op6_html.extract(F.col("html")).alias("t"))
    return pages.select("page_id", "t.text", "t.tables")


def op7_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_wavelet.read_digests(op7_wavelet.write_shards(spark, documents(spark, sf_dir), Scratch(spark, "op7")))


def op8_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op9_packing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_packing.pack(documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op10_forest.judge(spark, documents(spark, sf_dir), labels, Scratch(spark, "op10"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_phrases.mine(spark, documents(spark, sf_dir), Scratch(spark, "op11"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    turns = scratch.table(op12_trie.turn_places(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "placed")
    return op12_trie.trie(spark, *op12_trie.rebuilt(turns, scratch), scratch)


def op13_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op13_patterns.search(spark, documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Scratch(spark, "op13"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = (op1_ogg_media, op2_ngram_jaccard, op3_mixing_sources, op4_language_id, op5_weak_label_quality, op6_html_layout, op7_wavelet_shards, op8_chat_snapshots, op9_packing_windows, op10_quality_rules, op11_phrase_mining, op12_prefix_trie, op13_benchmark_leaks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing_sources": op3_mixing.ORACLE_SQL, "op8_chat_snapshots": op8_chat.ORACLE_SQL, "op11_phrase_mining": op11_phrases.ORACLE_SQL, "op12_prefix_trie": op12_trie.ORACLE_SQL, "op13_benchmark_leaks": op13_patterns.ORACLE_SQL}

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandwork.llm import op4_language, op5_weak_labels, op10_forest, stats
from strandwork.llm.common import Scratch

SF = "/root/testdata/sf0.01"
SPACE = r"[^\x20\x09-\x0D]+"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = op4_language.identify(spark, docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    judged = [r for r in out if r["held_out"] and r["lang"] is not None and r["lang_pred"] != "und"]
    right = sum(r["lang"] == r["lang_pred"] for r in judged)
    assert len(judged) > 100 and right / len(judged) > 0.93


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, score int, p int"
    rows = [(1, "der die das und", "de", 1, 1), (None, "the and of to", "en", 1, 1), (3, None, "en", 1, 1), (4, "12 !", "en", 1, 1), (5, "the and", None, 1, 1), (5, "the and", None, 1, 1)]
    out = op4_language.identify(spark, spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 6 and [r["lang_pred"] for r in out if r["doc_id"] in (3, 4)] == ["und", "und"]
    assert op4_language.identify(spark, spark.createDataFrame([], schema)).count() == 0


def test_masks_hold_all_members():
    rng = np.random.default_rng(1)
    members = [rng.integers(1, 2**63, 500).astype(np.uint64) for _ in range(3)]
    model = op4_language.LanguageModel.fit(["a", "b", "c"], members)
    for bit, hashes in enumerate(members):
        found = np.full(len(hashes), 255, np.uint8)
        for slot in op4_language._slots(hashes, len(model.masks[0])):
            found &= model.masks[0][slot]
        assert ((found >> bit) & 1).all()


def plain(text):
    """The fields that the contract fixes, one text at a time."""
    text = text or ""
    words = re.findall(SPACE, text)
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 8))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_statistics_equal_plain_loops():
    rng = random.Random(5)
    parts = ["a", "b", "éa", "#x", "<|>", "\n", "\n\n", " ", "\t", "a b c d e f g h i ", "x y\n", "漢", "\r\n", "\xa0"]
    texts = [None, "", "\n", "a" * 5000] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(120))) for _ in range(300)]
    table = stats.measure(pa.array(texts, pa.string()))
    for row, text in zip(table[:, :5].tolist(), texts):
        assert row == plain(text), text


def test_quality_rules_on_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = op10_forest.judge(spark, docs, labels, Scratch(spark, "t10"))
    for r, text in ((r, r["text"]) for r in out.join(docs.select("doc_id", "text"), "doc_id").collect()):
        n, repeated = r["n_words"], r["n_repeat_words"]
        assert [r[c] for c in op10_forest.BASE] == plain(text)
        assert r["base_failed"] == (n < 20 or 100 * repeated > 30 * n) and not (r["kept"] and r["base_failed"])
    good = out.where(~F.col("base_failed")).join(labels.where("quality = 1 and toxic = 0"), "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.98


def test_forest_isolates_the_far():
    rng = np.random.default_rng(2)
    x = rng.normal(0.5, 0.05, (500, 3))
    forest = op10_forest.IsolationForest.fit(x, np.zeros(3), np.ones(3))
    far = forest.score(np.array([[0.02, 0.98, 0.02]]))[0]
    assert far > forest.score(x).max()


def test_rules_edges(spark):
    schema, marks = "doc_id long, text string, x int, s string, kept int", "doc_id long, quality int, toxic int"
    rows = [(None, None, 1, "a", 1), (1, "", 1, "a", 1), (2, "w " * 30, 1, "a", 1), (2, " ".join(map(str, range(30))), 1, "a", 1)]
    docs = spark.createDataFrame(rows, schema)
    for labels in ([], [(None, 1, 0), (2, None, 0), (2, 1, 0), (2, 0, 1)]):
        out = op10_forest.judge(spark, docs, spark.createDataFrame(labels, marks), Scratch(spark, "t10")).collect()
        assert sorted(r["n_words"] for r in out) == [0, 0, 30, 30]
    assert op10_forest.judge(spark, docs.limit(0), spark.createDataFrame([], marks), Scratch(spark, "t10")).count() == 0


def test_voters_agree_with_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = op5_weak_labels.classify(spark, docs).withColumnRenamed("quality", "p").join(labels, "doc_id").collect()
    kept_good = [r["kept"] for r in rows if r["quality"] == 1]
    kept_bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(kept_good) / len(kept_good) > 0.97 > sum(kept_bad) / max(1, len(kept_bad))


def test_em_finds_the_reliable_voter():
    rng = np.random.default_rng(4)
    truth = rng.integers(0, 2, 20_000)
    right = np.array([0.95, 0.8, 0.6])
    votes = np.where(rng.random((len(truth), 3)) < right, truth[:, None], 1 - truth[:, None])
    votes[rng.random(votes.shape) < 0.3] = op5_weak_labels.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = op5_weak_labels.WeakLabels.fit(patterns, counts.astype(float))
    assert list(np.argsort(-model.accuracy)) == [0, 1, 2]
    assert ((model.posterior(votes) > 0.5) == truth)[(votes != op5_weak_labels.NONE).any(1)].mean() > 0.85


def test_classifier_edges(spark):
    schema = "doc_id long, text string, code int, quality string"
    rows = [(None, None, 1, "x"), (1, "", 1, "x"), (1, "Some words. More of them.", 1, "x"), (1, "Some words. More of them.", 1, "x")]
    out = op5_weak_labels.classify(spark, spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 4 and all(0 <= r["quality"] <= 1 for r in out)
    assert len({r["quality"] for r in out[:2]}) == len({r["quality"] for r in out[2:]}) == 1  # equal texts, equal scores
    assert op5_weak_labels.classify(spark, spark.createDataFrame([], schema)).count() == 0

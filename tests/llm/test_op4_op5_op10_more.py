"""Decisions of language ID, the quality classifier and the rules against plain versions, and their edges."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandwork.llm import op4_language, op5_weak_labels, op10_forest
from strandwork.llm.common import Scratch

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, score int, known string"


def plain_grams(text):
    """3- and 4-grams of letters inside words, whose edges are one character each."""
    letters = [c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else "_" for c in text]
    edged = "".join(["_", *letters, "_"])
    while "__" in edged:
        edged = edged.replace("__", "_")
    three = [edged[i : i + 3] for i in range(len(edged) - 2) if edged[i + 1] != "_"]
    four = [edged[i : i + 4] for i in range(len(edged) - 3) if edged[i + 1] != "_" and edged[i + 2] != "_"]
    return three + four


def plain_decision(text, shares):
    """Winner and score by the exact sets of n-grams; shares: {lang: {gram: part of its documents}}."""
    best = {}
    for grams in shares.values():
        for g, x in grams.items():
            best[g] = max(best.get(g, 0), x)
    member = {lang: {g for g, x in grams.items() if x >= op4_language.MIN_SHARE and x >= op4_language.MIN_RATIO * best[g]} for lang, grams in shares.items()}
    found = plain_grams(text or "")
    count = {lang: sum(g in grams for g in found) for lang, grams in member.items()}
    total = sum(count.values())
    if not found:
        return "und", 0.0, 0.0
    lang = max(sorted(count), key=lambda k: count[k])
    return lang, count[lang] / total if total else 0.0, count[lang] / len(found)


def test_language_decisions_equal_plain_sets(spark):
    rng = random.Random(3)
    words = {k: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(60)] for k, letters in {"aa": "abcdeö", "bb": "efghiß", "cc": "ijklmñ"}.items()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randrange(1, 40))) + rng.choice(["", ".", " 12", "İx"]), k, 1, "x") for i, k in enumerate(rng.choice(list(words)) for _ in range(150))]
    model = op4_language.fit(spark.createDataFrame(rows, DOC))
    shares = {}
    for k in words:
        texts = [t for _, t, lang, *_ in rows if lang == k]
        counts = {}
        for t in texts:
            for g in set(plain_grams(t)):
                counts[g] = counts.get(g, 0) + 1
        shares[k] = {g: n / len(texts) for g, n in counts.items()}
    texts = [t for _, t, *_ in rows] + ["", None, "12 !", "zzz qqq", "a" * 300_000, " ".join(words["aa"][:20] + words["bb"][:20])]
    names, scores, known = model.score(pa.array(texts, pa.string()))
    for text, name, score, part in zip(texts, names, scores, known):
        want = plain_decision(text, shares)
        assert name == want[0] or want[1] == 0 or abs(score - want[1]) < 0.02
        assert abs(score - want[1]) < 0.03 and abs(part - want[2]) < 0.03, text


@pytest.mark.parametrize("n", [1, 63, 64, 65, 150])
def test_any_number_of_languages(n):
    rng = np.random.default_rng(n)
    members = [rng.integers(1, 2**63, 50).astype(np.uint64) for _ in range(n)]
    model = op4_language.LanguageModel.fit([f"l{k:03}" for k in range(n)], members)
    assert len(model.masks) == -(-n // 64) and (model.false_positive < 0.01).all()
    for k in {0, n // 2, n - 1}:
        counts = list(model._counts(np.zeros(50, np.int64), members[k], 1))
        assert len(counts) == n and counts[k][0] == 50 and sum(c[0] for c in counts) < 50 + n


def test_ties_and_null_ids_of_languages(spark):
    rows = [(None, "abab abab", k, 1, "x") for k in ("x", "y")] * 40
    out = op4_language.identify(spark, spark.createDataFrame(rows, DOC)).collect()
    assert {r["lang_pred"] for r in out} == {"x"} and {round(r["score"], 6) for r in out} == {0.5}


def test_posteriors_and_scores_equal_plain_loops():
    rng = np.random.default_rng(8)
    accuracy = rng.uniform(0.55, 0.95, len(op5_weak_labels.VOTERS))
    votes = rng.integers(0, 3, (50, len(accuracy)))
    got = op5_weak_labels.WeakLabels(accuracy).posterior(votes)
    for row, p in zip(votes, got):
        good = math.prod(a if v == 1 else 1 - a for v, a in zip(row, accuracy) if v != 2)
        bad = math.prod(1 - a if v == 1 else a for v, a in zip(row, accuracy) if v != 2)
        assert abs(p - good / (good + bad)) < 1e-9


def test_scorer_learns_words_that_no_voter_sees():
    rng = random.Random(2)
    made = lambda kind: " ".join(rng.choice(["alpha", "beta", "gamma"] if kind else ["delta", "kappa", "sigma"]) for _ in range(12))
    labels = [k % 2 for k in range(600)]
    texts = pa.array([made(k) for k in labels])
    rows, buckets, weights, n = [], [], [], 0
    for first, last, data, offsets, table in op5_weak_labels._tables(texts):
        r, b, w = op5_weak_labels.features(data, offsets, table)
        order = np.argsort(r, kind="stable")
        rows.append(r[order] + first), buckets.append(b[order]), weights.append(w[order])
    row, bucket, weight = map(np.concatenate, (rows, buckets, weights))
    model = op5_weak_labels.LinearScorer.fit(row, bucket, weight, np.array(labels, float))
    unseen = [k % 2 for k in range(100)]
    assert ((model.score(pa.array([made(k) for k in unseen])) > 0.5) == np.array(unseen)).mean() > 0.97


def test_sample_is_bounded_in_documents_and_characters(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some words here. "), F.col("id")).alias("text"))
    drawn = []
    keep = op5_weak_labels.LinearScorer.fit
    try:
        op5_weak_labels.LinearScorer.fit = classmethod(lambda cls, row, bucket, weight, target, **k: drawn.append(len(target)) or keep(row, bucket, weight, target, epochs=1))
        op5_weak_labels.fit(rows, sample_docs=400)
        op5_weak_labels.fit(rows, sample_docs=4000, sample_chars=4000)
    finally:
        op5_weak_labels.LinearScorer.fit = keep
    assert 250 < drawn[0] < 550 and drawn[1] < 400


def plain_path(forest, tree, x):
    node = 0
    while forest.feature[tree, node] >= 0:
        node = 2 * node + 1 + (x[forest.feature[tree, node]] > forest.place[tree, node])
    return forest.path[tree, node]


def test_anomaly_scores_equal_plain_walks():
    rng = np.random.default_rng(5)
    x = rng.random((300, 8))
    forest = op10_forest.IsolationForest.fit(x, x.min(0), x.max(0), trees=20)
    got = forest.score(x[:40])
    want = [2 ** -(sum(plain_path(forest, t, row) for t in range(20)) / 20 / forest.norm) for row in x[:40]]
    assert np.allclose(got, want)


def test_rule_errors_on_labels_left_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    judged = op10_forest.judge(spark, docs, labels.where(~out), Scratch(spark, "t10"))
    errors = op10_forest.held_out_errors(judged, labels.where(out))
    assert errors["good_dropped"] is None or errors["good_dropped"] <= 0.05
    assert errors["bad_kept"] is None or errors["bad_kept"] <= 1.0
    print(errors)


def test_threshold_is_the_best_of_all_cuts(spark):
    rng = random.Random(4)
    rows = [(i, min(0.9995, max(0.0, rng.gauss(0.4 + 0.2 * bad, 0.05))), 1 - bad) for i, bad in enumerate([0] * 400 + [1] * 200)]
    scored = spark.createDataFrame([(i, a) for i, a, _ in rows], "doc_id long, anomaly double")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    bins = op10_forest.BINS

    def gain(limit):
        lost = sum(q == 1 and int(a * bins) >= limit for _, a, q in rows) / 400
        return sum(q == 0 and int(a * bins) >= limit for _, a, q in rows) / 200 - lost if lost <= 0.01 else -1

    best = max(range(bins + 1), key=lambda k: (gain(k), -k))
    assert op10_forest.threshold(scored, labels, 0.01) == best / bins
    assert op10_forest.threshold(scored, labels.where("quality = 1")) > 1


def test_long_and_repeated_texts_of_rules(spark):
    text = "w " * 400_000
    docs = spark.createDataFrame([(1, text), (1, text), (2, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = sorted(map(tuple, op10_forest.judge(spark, docs, labels, Scratch(spark, "t10")).select("doc_id", "n_words", "base_failed", "kept").collect()))
    assert out == [(1, 400_000, True, False)] * 2 + [(2, 2, True, False)]

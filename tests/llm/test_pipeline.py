import random

import pytest

import corpus_pipeline
from strandwork.llm import op2_jaccard
from strandwork.llm.common import Scratch
from test_op2_jaccard import brute, made

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], DOC)


def similarity(x, y, words):
    a, b = ({tuple(w[j : j + words]) for j in range(len(w) - words + 1)} for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("seed", [11, 12])
def test_dedupe_stage_equals_brute_force(spark, seed):
    rows = made(seed)
    kept = corpus_pipeline.keep_one_of_similar(spark, documents(spark, rows).repartition(3), "")
    classes = brute(rows, words=5, percent=80)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, component in classes if i == component)


def test_dedupe_stage_drops_copies_between_the_two_limits(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for family in range(4):
        base = [word() for _ in range(50)]
        rows += [(10 * family, " ".join(base)), (10 * family + 1, " ".join([*base[:25], word(), *base[26:]]))]
        base = [word() for _ in range(100)]
        rows += [(10 * family + 2, " ".join(base)), (10 * family + 3, " ".join([*base, *(word() for _ in range(15))]))]
    for (_, x), (_, y) in zip(rows[::2], rows[1::2]):
        assert 0.8 <= similarity(x, y, 5) < 0.9 and similarity(x, y, 3) < 0.9
    kept = corpus_pipeline.keep_one_of_similar(spark, documents(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [i for i, _ in rows[::2]]


@pytest.mark.parametrize("seed", [7, 8])
def test_five_words_equal_brute_force(spark, seed):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int").repartition(3)
    out = op2_jaccard.similar_classes(spark, docs, Scratch(spark, "t2"), words=5, percent=80)
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, words=5, percent=80))

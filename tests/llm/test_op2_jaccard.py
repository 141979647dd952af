import random
import re
from collections import defaultdict

import pytest

from strandwork.llm import op2_jaccard
from strandwork.llm.common import Scratch

DOC = "doc_id long, text string, key string, n int"


def brute(rows, words=3, percent=90):
    """{row number: (n_shingles, component id)} by comparing all pairs that share a shingle."""
    sets, where = [], defaultdict(list)
    for i, (_, text) in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.append(s)
        for x in s:
            where[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in where[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i))) for i, (doc_id, _) in enumerate(rows)]


def made(seed, n_families=12, copies=14):
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{i}" for i in range(300)] + ["the", "A", "Ünd", "x."]
    for _ in range(n_families):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 9, 12, 14, 20, 40, 90, 300, 900]))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8, len(base) // 20])):
                if copy:
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = copy[: max(1, len(copy) - rng.randrange(1 + len(copy) // 10))]
            rows.append(rng.choice([" ", "\n", "  "]).join(copy))
    rows += ["", None, " \n", "one", "ONE", "one two", "a b c", "a  B c"] * 2
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,deletions,percent", [(1, None, 90), (2, 0, 90), (3, 1, 90), (4, 1000, 90), (5, None, 70), (6, 2, 80)])
def test_equals_brute_force(spark, seed, deletions, percent):
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOC).repartition(3)
    out = op2_jaccard.similar_classes(spark, docs, Scratch(spark, "t2"), percent=percent, deletions=deletions)
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, percent=percent))


def test_nulls_ties_and_nothing(spark):
    rows = [(None, "a b c d"), (None, None), (4, "A b  c d"), (4, "A b  c d"), (4, "other words entirely here"), (9, "other words entirely here"), (2, ""), (None, "lonely text of no one")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOC)
    out = op2_jaccard.similar_classes(spark, docs, Scratch(spark, "t2"))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(brute(rows), key=key)
    assert op2_jaccard.similar_classes(spark, docs.limit(0), Scratch(spark, "t2")).count() == 0


def test_layouts_cover_every_difference():
    for percent in (50, 80, 90):
        lows = op2_jaccard.bands(percent)
        for b in range(20):
            low, high = int(lows[b]), int(lows[b + 1]) - 1
            assert high * 100 // percent < lows[b + 2]
            for sets in (10, 10**6, 10**10):
                x = op2_jaccard.allocate(low, high, sets, percent)
                most = 2 * high * (100 - percent) // (100 + percent)
                assert x.segments + x.deletions == most + 1 + x.slack if most else x.segments == 0
                assert 0 <= x.deletions <= x.segments

"""Phrase mining against plain loops: many small tables, blocks and runs, ties, nulls; the perfect hash by itself."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandwork.llm import op11_phrases
from strandwork.llm.common import Scratch
from strandwork.llm.perfect_hash import PerfectHash

DOC = "lang string, text string, n long, word string"


def brute(rows, least=10, share=50, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
            ws = re.findall(rb"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for k in (1, 2, 3):
                for i in range(len(ws) - k + 1):
                    counts[lang, tuple(ws[i : i + k])] += 1
    found = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        if any(q[0] == lang and len(q[1]) > len(p) and p in (q[1][:2], q[1][1:]) and 100 * b >= share * a for q, b in found.items() if len(q[1]) > len(p)):
            continue
        cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        s, k = min(cuts)
        out.setdefault(lang, []).append((-s, -a, b" ".join(p), counts[lang, p[:k]], counts[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top]))


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "The", "é", "New", "york", "City", "x#y", *(f"w{k}" for k in range(12))]
    rows = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(60)):
            text += "new York city" if rng.random() < 0.08 else rng.choice(vocabulary)
            text += rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "  "])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([text, text, text, None]) if rng.random() < 0.1 else text))
    return rows


def run(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 5, "clash") for r in rows], DOC).repartition(4)
    out = op11_phrases.mine(spark, frame, Scratch(spark, "t11"), **options)
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"limit": 7, "least": 4, "top": 30}), (3, {"least": 1, "share": 90})])
def test_equals_plain_loops(spark, monkeypatch, seed, options):
    for name, value in (("RUN_KEYS", 50), ("PART_KEYS", 400), ("BLOCK", 4), ("FAN", 2), ("CHUNK", 300), ("SLICE", 200)) if seed > 1 else ():
        monkeypatch.setattr(op11_phrases, name, value)
    rows = made(seed, 60 if "limit" in options else 120)
    assert run(spark, rows, **options) == brute(rows, options.get("least", 10), options.get("share", 50), options.get("top", 2000))


def test_empty_wordless_and_long_texts(spark):
    assert run(spark, []) == [] and run(spark, [("en", None), (None, " ,.\n")]) == []
    rows = [("en", "deep blue sea " * 30_000), ("en", "sea" * 50_000)]
    assert run(spark, rows) == brute(rows)


def test_counts_beyond_64_bits_stay_exact(spark):
    big = 3_000_000_000_001
    row = spark.sql(f"SELECT {big} a, {big + 7} l, {big + 11} r").selectExpr(op11_phrases.SCORE.format(a="a", l="l", r="r")).first()[0]
    assert row == 10**6 * big * big // ((big + 7) * (big + 11))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal_and_strangers_are_told(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**62), 2**62, n))
    table = op11_phrases.KeyTable(keys, 5)
    assert sorted(PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))
    assert sorted(table.ids(keys).tolist()) == list(range(5, 5 + len(keys)))
    assert not table.ids(rng.integers(2**62, 2**63 - 1, 1000)).any()


def test_equal_keys_have_no_perfect_hash():
    with pytest.raises(ValueError):
        PerfectHash(np.array([3, 3]))

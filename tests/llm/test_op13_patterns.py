"""Wu-Manber search against plain loops: short items, edges, several passes, hot buckets."""

import hashlib
import random
import re

import pytest

from strandwork.llm import op13_patterns
from strandwork.llm.common import Scratch

DOC, ITEM = "doc_id long, text string, item long, hits string", "item_id long, text string, doc_id long"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, window=10):
    held = []
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        held += [(tuple(w[i : i + n]), item) for i in range(len(w) - n + 1) if n]
    by: dict = {}
    for string, item in held:
        by.setdefault(len(string), {}).setdefault(string, set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n, strings in by.items():
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in strings:
                    hit |= set(range(i, i + n))
                    found |= strings[s]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOC).repartition(3)
    b = spark.createDataFrame([(i, t, 1) for i, t in items], ITEM).repartition(2)
    out = op13_patterns.search(spark, d, b, Scratch(spark, "t13"), **options)
    return sorted((tuple(r)[:6] for r in out.collect()), key=str), out


def made(seed, n_docs=60, n_items=14, vocabulary=30):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["a", "bb", "é", "x9", "Zed", "naïve", *(f"w{k}" for k in range(vocabulary))]) for _ in range(n)]
    join = lambda ws: "".join(w + rng.choice([" ", ", ", "\n", "-", " \u0000"]) for w in ws)
    items = [(k, join(some(rng.choice([1, 2, 3, 7, 9, 10, 11, 12, 25, 60])))) for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        ws = some(rng.choice([0, 1, 5, 40, 300]))
        for _ in range(rng.randrange(3)):
            part = words(rng.choice(items)[1])
            low = rng.randrange(len(part))
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = [p.decode().upper() if rng.random() < 0.2 and p.isascii() else p.decode() for p in part[low : low + rng.randrange(1, 40)]]
        docs.append((k, join(ws)))
    return docs, items


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"shard_strings": 40}), (3, {"window": 4}), (4, {"shard_bytes": 900})])
def test_equals_plain_loops(spark, seed, options):
    docs, items = made(seed)
    assert run(spark, docs, items, **options)[0] == brute(docs, items, options.get("window", 10))


def test_small_vocabularies_fill_few_buckets(spark, monkeypatch):
    monkeypatch.setattr(op13_patterns, "RUN", 5)
    monkeypatch.setattr(op13_patterns, "COMPARE_BYTES", 64)
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("ab") for _ in range(40))) for k in range(20)] + [(99, "a")]
    docs = [(k, " ".join(rng.choice("ab") for _ in range(200))) for k in range(10)] + [(77, "b b b")]
    assert run(spark, docs, items)[0] == brute(docs, items)


def test_nulls_repeats_and_empty_tables(spark):
    line = " ".join(f"t{k}" for k in range(12))
    docs = [(1, None), (2, ""), (3, "... !"), (None, line), (4, line), (4, line.upper()), (5, "One"), (6, "x" * 300_000 + " " + line)]
    items = [(7, line), (7, "one"), (None, "one"), (8, None), (9, "?!"), (10, line), (70, line)]
    assert run(spark, docs, items)[0] == brute(docs, items)
    assert run(spark, docs, [])[0] == brute(docs, [])
    assert run(spark, [], items)[0] == []
    assert run(spark, docs, [(None, "one")])[0] == brute(docs, [(None, "one")])


def test_text_ids_and_names_found(spark):
    docs = spark.createDataFrame([("d", "so it is one two")], "doc_id string, text string")
    items = spark.createDataFrame([("b,1", "one two"), ("a", "IT is")], "item_id string, text string")
    row = op13_patterns.search(spark, docs, items, Scratch(spark, "t13")).first()
    assert (row["doc_id"], row["n_hit"], row["items"]) == ("d", 4, ["a", "b,1"])

import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandwork.llm import op3_mixing, op8_chat
from strandwork.llm.common import Scratch

DOC = "doc_id long, text string, source string, n_chars long, size string, whole int"


def documents(spark):
    sizes = {"a": [900, 40, 60], "b": [3, 0, 2, 5], "c": [100] * 7, None: [1, 9], "z": [0]}
    rows = [(s, n) for s, ns in sizes.items() for n in ns]
    data = [(i, None if n == 0 else " ".join(["w"] * n), s, 2 * n, "x", 1) for i, (s, n) in enumerate(rows)]
    return data, spark.createDataFrame(data, DOC).repartition(3)


def water(sizes, weights, most=3):
    """Targets by clamping and sharing again until none is above its cap."""
    total, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        level = total / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * level > most * sizes[i]]
        if not above:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in above:
            target[i] = most * sizes[i]
            total -= target[i]
            open_.discard(i)
    return target


def test_targets_and_takes(spark):
    data, docs = documents(spark)
    out = op3_mixing.mix(spark, docs, Scratch(spark, "t3")).collect()
    assert len(out) == len(data)
    words = {i: len((t or "").split()) for i, t, *_ in data}
    names = sorted({s for _, _, s, *_ in data if s is not None}) + [None]
    sizes = [sum(words[i] for i, _, s, *_ in data if s == n) for n in names]
    wanted = dict(zip(names, water(sizes, [k % 3 + 1 for k in range(len(names))])))
    source, taken = {i: s for i, _, s, *_ in data}, defaultdict(int)
    for r in out:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[names.index(s)]
        assert abs(r["target"] - wanted[s]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[n] - wanted[n]) <= 1 for n in names)
    again = op3_mixing.mix(spark, docs.repartition(5), Scratch(spark, "t3")).collect()
    assert sorted(out, key=str) == sorted(again, key=str)


def test_repetitions_have_the_words_taken(spark):
    data, docs = documents(spark)
    plan = op3_mixing.mix(spark, docs, Scratch(spark, "t3"))
    want = {r["doc_id"]: r["taken"] for r in plan.collect() if r["taken"]}
    rows = op3_mixing.repeat(docs, plan)
    assert rows.columns == docs.columns
    got = defaultdict(int)
    for r in rows.collect():
        got[r["doc_id"]] += len(re.findall(op3_mixing.WORD, r["text"] or ""))
    assert {k: n for k, n in got.items() if n} == want


def test_mix_of_nothing_and_odd_rows(spark):
    assert op3_mixing.mix(spark, spark.createDataFrame([], DOC), Scratch(spark, "t3")).count() == 0
    same = spark.createDataFrame([(None, "a b", None, None, None, None), (1, "a b", None, 3, None, None), (1, "a b", None, 3, None, None)], DOC)
    assert sum(r["taken"] for r in op3_mixing.mix(spark, same, Scratch(spark, "t3")).collect()) == 6


CHAT = "conv_id long, turn long, role string, text string, place int, l string"


def test_snapshots_collapse(spark):
    long = [("user", "hi"), ("assistant", "yes"), (None, None), ("user", "")]
    talks = {1: long[:1], 2: long[:3], 3: long, 4: long, 5: [("user", "other")], 6: long[:2] + [("user", "fork")], None: [("user", "no id")]}
    rows = [(k, 10 * n, r, t, 1, "x") for k, turns in talks.items() for n, (r, t) in enumerate(turns)]
    out = {r["conv_id"]: r for r in op8_chat.render(spark.createDataFrame(rows, CHAT).repartition(4)).collect()}
    assert out.keys() == {3, 5, 6, None}
    assert out[3]["n_copies"] == 2 and out[3]["n_turns"] == 4
    assert out[6]["rendered"] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in talks[6])
    assert op8_chat.render(spark.createDataFrame([], CHAT)).count() == 0


def test_long_conversations_are_split_alike(spark):
    turns = [(k, t, "user", f"t{t}", 1, "x") for k, n in ((1, 1500), (2, 3000), (3, 1024)) for t in range(n)]
    out = op8_chat.render(spark.createDataFrame(turns, CHAT)).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(2, 3000)]


def test_repeated_turns_count(spark):
    rows = [(1, 0, "user", "a", 1, "x")] * 2 + [(2, 0, "user", "a", 1, "x")]
    out = op8_chat.render(spark.createDataFrame(rows, CHAT)).select(F.col("conv_id"), F.col("n_turns")).collect()
    assert [tuple(r) for r in out] == [(1, 2)]


def test_turns_without_an_id_stand_alone(spark):
    rows = [(None, t, "user", x, 1, "x") for t, x in ((0, "a"), (1, "b"), (2, "b"), (None, "c"), (3, "first"))]
    rows += [(7, 0, "user", "first", 1, "x"), (7, 1, "user", "second", 1, "x"), (9, None, "user", "c", 1, "x")]
    out = op8_chat.render(spark.createDataFrame(rows, CHAT).repartition(4)).collect()
    text = lambda *t: "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in t)
    want = [(None, 1, 1, text("a")), (None, 1, 2, text("b")), (9, 1, 2, text("c")), (7, 2, 1, text("first", "second"))]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_ties_and_null_turn_numbers_equal_plain_sorting(spark):
    long = [(1, 0, "user", f"t{i % 6000}", 1, "x") for i in range(7000)]
    short = [(2, None, "user", "n", 1, "x"), (2, 5, "user", "y", 1, "x"), (2, 5, None, "x" * 300_000, 1, "x")]
    turns = spark.createDataFrame(long + short, CHAT).repartition(5)
    named = op8_chat.prefixes(turns.withColumnRenamed("conv_id", "conv"))
    places = defaultdict(list)
    for r in named.collect():
        places[r["conv"]].append(r["place"])
    assert sorted(places[1]) == list(range(1, 7001)) and sorted(places[2]) == [1, 2, 3]
    assert len({(r["h1"], r["h2"]) for r in named.where("conv = 1").collect()}) == 7000
    out = {r["conv_id"]: r for r in op8_chat.render(turns).collect()}
    assert out[1]["n_turns"] == 7000 and out[2]["rendered"].startswith("<|im_start|>user\nn<|im_end|>") and len(out[2]["rendered"]) > 300_000
    again = {r["conv_id"]: r["rendered"] for r in op8_chat.render(turns.repartition(3)).collect()}
    assert again == {k: r["rendered"] for k, r in out.items()}


def test_kept_columns_may_have_any_name(spark):
    rows = [(k, f"s{k % 2}", "a b c " * (k + 1), k * 10, -k, "x") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size long, start long, `a.b` string")
    out = op3_mixing.mix(spark, docs, Scratch(spark, "clash"), keep=["size", "start", "source", "a.b"])
    assert out.columns == ["doc_id", "size", "source_size", "target", "whole", "extra", "taken", "size_kept", "start_kept", "source_kept", "a.b"]
    plain = {r["doc_id"]: r["taken"] for r in op3_mixing.mix(spark, docs, Scratch(spark, "clash")).collect()}
    for r in out.collect():
        assert (r["size_kept"], r["start_kept"], r["source_kept"], r["a.b"]) == (r["doc_id"] * 10, -r["doc_id"], f"s{r['doc_id'] % 2}", "x")
        assert r["size"] == 3 * (r["doc_id"] + 1) and r["taken"] == plain[r["doc_id"]]

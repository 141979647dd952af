"""The trie against plain loops: families, copies, deep shared prefixes, nulls, ties, many members of a node."""

import hashlib
import random
import zlib

import pytest

from strandwork.llm import op12_trie
from strandwork.llm.common import Scratch

ROWS = "conv_id long, turn long, role string, text string, conv long, depth string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return out


def brute(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids, leaves, saved = {}, {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = leaves.get(path, 0) or 1
        saved[path] = saved.get(path, 0) + ((len(members[path]) - 1) * len(path[-1][1]) if path else 0)
        if path:
            up = path[:-1]
            kids[up], leaves[up], saved[up] = kids.get(up, 0) + 1, leaves.get(up, 0) + leaves[path], saved.get(up, 0) + saved[path]
    out = []
    for path, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids.get(path, 0), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS).repartition(3)
    scratch = Scratch(spark, "t12")
    turns = scratch.table(op12_trie.turn_places(frame), "placed")
    return sorted(map(tuple, op12_trie.trie(spark, *op12_trie.rebuilt(turns, scratch), scratch).collect()), key=str)


def made(seed, n=60, texts=3, most=12):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([None, t, t, t, 0]), rng.choice(["user", "user", "bot", None]), rng.choice([None, "", "é", *(f"text {k}" for k in range(texts))])))
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 1000), (2, 3)])
def test_equals_plain_loops(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(op12_trie, "HOT_ROWS", hot)
    monkeypatch.setattr(op12_trie, "PACK", 4)
    rows = made(seed)
    assert run(spark, rows) == brute(rebuilt(rows))


def test_copies_of_one_conversation_and_one_long_one(spark, monkeypatch):
    monkeypatch.setattr(op12_trie, "HOT_ROWS", 20)
    monkeypatch.setattr(op12_trie, "PACK", 7)
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 180) for t in range(4)] + [(7, t, "user", f"turn {t % 5}") for t in range(300)]
    assert run(spark, rows) == brute(rebuilt(rows))


def test_turnless_lost_and_negative_ids_and_an_empty_table(spark):
    rows = [(3, 0, "user", "a"), (3, 1, "bot", "b"), (4, 0, "user", "a"), (None, 0, "user", "a"), (-7, 0, None, None), (8, None, "user", "z" * 200_000), (8, None, "user", "z" * 200_000)]
    convs = {c: t for c, t in rebuilt([r for r in rows if r[0] is None or r[0] >= 0]).items()}
    found = run(spark, [r for r in rows if r[0] is None or r[0] >= 0])
    assert found == brute(convs) and any(not t for t in convs.values())
    assert len(run(spark, rows)) >= len(found) and run(spark, []) == []


def test_deep_copies_share_all_levels(spark):
    rows = [(c, t, "user", str(t)) for c in (11, 12) for t in range(25)]
    got = run(spark, rows)
    assert got == brute(rebuilt(rows)) and max(r[1] for r in got if r[3] == 2) >= 9


def test_no_plan_holds_the_joins_of_all_levels(spark, monkeypatch):
    made, table = {}, Scratch.table

    def noted(self, df, name):
        made[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return table(self, df, name)

    monkeypatch.setattr(Scratch, "table", noted)
    rows = spark.createDataFrame([(c, t, "user", "same" if t < 6 else f"own {c}") for c in range(0, 30, 5) for t in range(8)], "conv_id long, turn long, role string, text string")
    scratch = Scratch(spark, "op12-plans")
    turns, lengths = op12_trie.rebuilt(scratch.table(op12_trie.turn_places(rows), "placed"), scratch)
    assert op12_trie.trie(spark, turns, lengths, scratch).count() == 1 + 6 + 6 * 2
    assert made["ends"] == 0 and max(n for name, n in made.items() if name.startswith("step-")) == 1

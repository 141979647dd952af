"""Small blocks, portions and no star round: what large groups go through, against brute force; many null and repeated ids."""

import random
import time

import numpy as np
import pytest

from strandwork.llm import op2_jaccard
from strandwork.llm.common import Scratch
from test_op2_jaccard import DOC, brute, made


@pytest.mark.parametrize("seed,stars,percent", [(21, 0, 80), (22, 1, 90)])
def test_small_blocks_equal_brute_force(spark, monkeypatch, seed, stars, percent):
    for name, value in (("BLOCK", 3), ("PAIRS_AT_ONCE", 16), ("INDEX_HASHES", 64), ("STARS", stars), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(op2_jaccard, name, value)
    rows = made(seed, n_families=6)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOC).repartition(3)
    out = op2_jaccard.similar_classes(spark, docs, Scratch(spark, "t2"), percent=percent)
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows, percent=percent))


def test_no_frame_is_made_of_a_list(spark, monkeypatch):
    """Its rows would pass through Python workers beside those of the Arrow tasks."""
    rows = made(23, n_families=6)
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], DOC).repartition(3)
    monkeypatch.setattr(spark, "createDataFrame", None)
    out = op2_jaccard.similar_classes(spark, docs, Scratch(spark, "t2"))
    assert sorted(map(tuple, out.collect())) == sorted(brute(rows))


def test_blocks_compare_each_pair_of_different_roots_once():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    sketch = rng.integers(-(2**62), 2**62, (40, op2_jaccard.SKETCH_WORDS))
    sketch[20:] = sketch[:20]  # twins
    members = [(entry, key) for entry in range(5) for key in rng.choice(40, 17, replace=False).tolist()]
    root = [k % 7 for k in range(40)]
    rows, blocks = [], 3
    for entry, key in members:
        own = key % blocks
        for other in range(blocks):
            rows.append((entry, min(own, other), max(own, other), own, key, root[key], 50, *sketch[key].tolist()))
    rows.sort(key=lambda r: r[:3])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 11])], [f"c{j}" for j in range(len(rows[0]))]) for k in range(0, len(rows), 11)]
    got = {(r["a"], r["b"], r["ra"], r["rb"]) for b in op2_jaccard._block_task(iter([batches[0].slice(0, 0), *batches]), 80) for r in b.to_pylist()}
    want = {(a, b, root[a], root[b]) for e, a in members for f, b in members if e == f and a < b and root[a] != root[b] and b - a == 20}
    assert got == want


@pytest.mark.parametrize("percent", [80, 90])
def test_blocks_measure_exact_distances_of_random_sketches(percent):
    import pyarrow as pa

    rng, size, n = np.random.default_rng(percent), 400, 60
    base = rng.integers(0, 2, op2_jaccard.SKETCH_WORDS * 64)
    bits = np.stack([base ^ (rng.random(len(base)) < share) for share in rng.uniform(0, 0.12, n)])  # signs of words differ too
    words = np.packbits(bits.astype(np.uint8), axis=1).view(np.int64)
    sizes = rng.integers(size - 40, size + 40, n)
    rows = [(0, 0, 0, 0, k, k, int(sizes[k]), *words[k].tolist()) for k in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f"c{j}" for j in range(len(rows[0]))])
    got = {(r["a"], r["b"]) for b in op2_jaccard._block_task(iter([batch]), percent) for r in b.to_pylist()}
    far = lambda a, b: max(int((bits[a] != bits[b]).sum()), abs(int(sizes[a] - sizes[b])))
    want = {(a, b) for a in range(n) for b in range(a + 1, n) if far(a, b) * (100 + percent) <= int(sizes[a] + sizes[b]) * (100 - percent)}
    assert got == want and 0 < len(want) < n * (n - 1) // 2


def test_many_rows_of_one_id_or_none_take_linear_time(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(30))
    rows = [(None if k % 2 else 7, text(), "k", 1) for k in range(3000)]
    start = time.perf_counter()
    out = op2_jaccard.similar_classes(spark, spark.createDataFrame(rows, DOC).repartition(4), Scratch(spark, "t2"))
    assert out.count() == 3000 and time.perf_counter() - start < 90


def test_text_ids_and_free_scratch(spark):
    docs = spark.createDataFrame([("b", "one two three four"), ("a", "one two three four"), (None, "x")], "doc_id string, text string")
    scratch = Scratch(spark, "t2")
    out = op2_jaccard.similar_classes(spark, docs, scratch)
    assert sorted(map(tuple, out.collect()), key=str) == [("a", 2, "a"), ("b", 2, "a"), (None, 1, None)] and scratch.names == {"classes"}


def test_slack_spares_sets_of_few_empty_segments_only():
    lows = op2_jaccard.bands(80)
    b = int(np.searchsorted(lows, 300, "right")) - 1
    layout = op2_jaccard.allocate(int(lows[b]), int(lows[b + 1]) - 1, 10**6, 80)
    most = 2 * layout.high * 20 // 180
    assert layout.slack > 0 and layout.segments + layout.deletions == most + 1 + layout.slack

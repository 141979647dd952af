import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from strandwork.llm import op7_wavelet, op9_packing, tokens
from strandwork.llm.common import Scratch

DOC = "doc_id long, text string, n_tokens string, start double"
ODD = [
    (5, "a\x1cb c", "x", 1.0),
    (3, "É̈ x \xa0 y　z", None, None),
    (2, "<|endoftext|> hi<|startoftext|>x <|ENDOFTEXT|>", "", 0.0),
    (1, "", "1", 1.0),
    (None, "Hi, there. it's we'LL 12 34 9, é,", "1", 1.0),
    (9, None, "1", 1.0),
    (9, None, "1", 1.0),
    (7, "ΑΣ ΑΣ. İ ǆ", "1", 1.0),
    (4, "the words of a long text, again. " * 900, "1", 1.0),
]


def expected(text):
    return tokens.tokenizer(tokens.default_path()).encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_encoder_equals_the_library():
    rng = random.Random(1)
    pieces = ["the", "The", "don't", "x,", ".", ",.", "\n", "  ", "\t", "12", "é.", "###", "a.b", "<|endoftext|>", "漢字", "\x85", "a̐"]
    texts = [rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)]
    for text, ids in zip(texts, tokens.encode_column(pa.array(texts, pa.string()))):
        assert ids.tolist() == expected(text), text


class Counted:
    """The library's tokenizer, counting the texts that it is given."""

    def __init__(self):
        self.found, self.texts = tokens.tokenizer(tokens.default_path()), 0

    def __getattr__(self, name):
        return getattr(self.found, name)

    def encode_batch_fast(self, texts, **more):
        self.texts += len(texts)
        return self.found.encode_batch_fast(texts, **more)


def test_new_plain_words_are_encoded_together():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=9)) + rng.choice(["", "é", "!!", ".%", "7", ";a"]) for _ in range(5000)]
    raw, encoder = np.frombuffer(" ".join(words).encode(), np.uint8), tokens.Encoder()
    encoder.tokenizer = counted = Counted()
    ids, _ = encoder.encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == expected(" ".join(words))
    assert counted.texts <= 5


@pytest.mark.parametrize("odd", ["İx", "a'sb", "'s", "(\"'s", "it's''re", "x'", "<|", "|>", "ａ１", "²x", "x²", "Ǆ", "ﬁ", "각", "ᄀ", "a\x00b", "~\x7f", "ªº", "\u0378x", "x\U0001e030"])
def test_odd_words_among_plain_ones(odd):
    text = f"plain {odd} words {odd}. and more!! {odd}x 1{odd}2"
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, _ = tokens.Encoder().encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == expected(text)


def test_encoder_starts_anew_when_full():
    small = tokens.Encoder(slots=16)
    texts = [f"w{i} v{i}x" for i in range(3)] * 2
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, _ = small.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == expected(t)


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.geometric(0.01, 300_000) - 1, 65535).astype(np.uint16)
    m = op7_wavelet.WaveletMatrix(op7_wavelet.build(ids))
    assert (m.decode() == ids).all()
    for i in (0, 1, 511, 512, 131071, 131072, 299_999, *rng.integers(0, len(ids), 30).tolist()):
        assert m.access([i])[0] == ids[i]
    assert (m.access(np.arange(len(ids))[::7]) == ids[::7]).all()
    for value in (0, 1, 50, 700, 65535):
        places = np.flatnonzero(ids == value)
        assert m.count(value) == len(places)
        assert m.count(value, 1000, 200_001) == ((places >= 1000) & (places < 200_001)).sum()
        for j in {0, len(places) // 2, len(places) - 1} - {-1}:
            assert m.select(value, j) == (places[j] if j < len(places) else -1)
        assert m.select(value, len(places)) == -1
    empty = op7_wavelet.WaveletMatrix(op7_wavelet.build(ids[:0]))
    assert len(empty.decode()) == 0 and empty.count(5) == 0


@pytest.mark.parametrize("shard_tokens", [64, op7_wavelet.SHARD_TOKENS])
def test_shards_round_trip(spark, shard_tokens):
    docs = spark.createDataFrame(ODD, DOC).repartition(3)
    shards = op7_wavelet.write_shards(spark, docs, Scratch(spark, "t7"), shard_tokens=shard_tokens)
    assert shards.columns == ["part", "shard", "n_tokens", "file"]
    rows = sorted(map(tuple, op7_wavelet.read_digests(shards).collect()), key=lambda r: r[1])
    want, start = [], 0
    for doc_id, text, *_ in sorted(ODD, key=lambda r: (r[0] is not None, r[0])):
        ids = expected(text)
        want.append((doc_id, start, len(ids), crc(ids), list(ids).count(1), True))
        start += len(ids)
    assert rows == want


def test_many_rows_of_one_id_or_none_are_many_tasks(spark):
    rng = random.Random(7)
    rows = [(None if k % 3 else 8, " ".join(rng.choice(["red", "blue", "green"]) for _ in range(8)), "x", 1.0) for k in range(900)] + [(99, "last", "x", 1.0)]
    shards = op7_wavelet.write_shards(spark, spark.createDataFrame(rows, DOC).repartition(4), Scratch(spark, "t7"), shard_tokens=64)
    per_part = [r["count"] for r in shards.groupBy("part").count().collect()]
    got = sorted(map(tuple, op7_wavelet.read_digests(shards).collect()), key=lambda r: r[1])
    assert len(per_part) >= 6 and max(per_part) < 0.4 * sum(per_part)
    assert [r[0] for r in got] == [None] * 600 + [8] * 300 + [99] and sorted(r[3] for r in got) == sorted(crc(expected(t)) for _, t, *_ in rows)
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()


def test_shards_of_nothing(spark):
    shards = op7_wavelet.write_shards(spark, spark.createDataFrame([], DOC), Scratch(spark, "t7"))
    assert op7_wavelet.read_digests(shards).count() == 0


def check_packing(docs, rows, window):
    by_doc, by_sequence = {}, {}
    for doc_id, start, length, c, total, seq, offset in rows:
        by_doc.setdefault((doc_id, total), []).append((start, length, c))
        by_sequence.setdefault(seq, []).append((offset, length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
    copies = {}
    for doc_id, text in docs:
        copies.setdefault((doc_id, len(expected(text))), []).append(text)
    assert by_doc.keys() == copies.keys()
    for key, texts in copies.items():
        ids, seen = expected(texts[0]), []
        for start, length, c in by_doc[key]:
            assert c == crc(ids[start : start + length])
            seen += range(start, start + length)
        assert sorted(seen) == sorted(list(range(len(ids))) * len(texts))
    return by_sequence


@pytest.mark.parametrize("window", [2, 64, 2048])
def test_packing_covers_every_id_once(spark, window):
    rows = [tuple(r) for r in op9_packing.pack(spark.createDataFrame(ODD, DOC).coalesce(1), window=window).collect()]
    windows = check_packing([(r[0], r[1]) for r in ODD], rows, window)
    short = [n for n in (sum(n for _, n in w) for w in windows.values()) if n < window]
    assert all(n & (n - 1) == 0 for n in short) and len(short) == len(set(short))


def test_packing_edges(spark):
    assert op9_packing.pack(spark.createDataFrame([], DOC)).count() == 0
    with pytest.raises(ValueError):
        op9_packing.pack(spark.createDataFrame([], DOC), window=1)


def test_level_choice_is_the_least_sum_of_squares():
    rng, packer = np.random.default_rng(0), op9_packing.LevelPacker(32)
    for k in range(500):
        size, before = int(rng.integers(1, 32)), packer.counts.copy()
        best = None
        for level in [0, *np.flatnonzero(before)]:
            if level + size <= 32:
                after = before.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 32
                best = min(x for x in (best, int((after[1:32] ** 2).sum())) if x is not None)
        packer.place((k, 0, size))
        assert int((packer.counts[1:32] ** 2).sum()) == best
        assert all(len(packer.open.get(h, [])) == packer.counts[h] for h in range(33))

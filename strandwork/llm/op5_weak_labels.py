"""Quality classifier without labels: a weak-label model over heuristic voters, and a hashed linear scorer.

Voters say good, bad or nothing of a document. Expectation-maximisation over the counts of vote patterns in the
whole corpus estimates how often each voter is right, and so each pattern's probability of good; silence is no
evidence, and no share of good documents is assumed. These posteriors then train a linear scorer on hashed words,
word shapes and binned statistics, which scores every document, whether the voters say anything of it or not, and
learns from words what no voter looks at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.llm.stats import FIELDS, statistics
from strandwork.llm.text import LOWER, U64, chunks, mix, word_hashes, word_spans

#: Documents (about; a hash decides) and characters at most on which the scorer is trained, and its number of weights.
SAMPLE_DOCS, SAMPLE_CHARS, BUCKETS = 20_000, 1 << 27, 1 << 16
ROUNDS, EPOCHS, SEED = 60, 12, 11
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, 2

#: A voter's rightness before any evidence, as right and wrong votes already seen.
RIGHT, WRONG = 40.0, 10.0

#: Statistics that voters judge by, as shares of a document's words, letters or lines.
RATIOS = (
    ("symbols", lambda c: c["n_symbols"] / c["w"]),
    ("capitals", lambda c: c["n_upper"] / np.maximum(c["n_letters"], 1)),
    ("repeats", lambda c: c["n_repeat_words"] / c["w"]),
    ("stutter", lambda c: c["n_same_words"] / c["w"]),
    ("sentences", lambda c: c["n_ends"] / c["w"]),
    ("length", lambda c: c["word_chars"] / c["w"]),
    ("lines", lambda c: c["n_dup_lines"] / np.maximum(c["n_lines"], 1)),
    ("digits", lambda c: c["n_digits"] / np.maximum(c["word_chars"], 1)),
)
#: Voters: verdict, least words for a vote, and the test of a document's ratios (and words).
VOTERS = (
    ("symbols", BAD, 5, lambda r, n: r["symbols"] > 0.15),
    ("capitals", BAD, 5, lambda r, n: r["capitals"] > 0.4),
    ("repeats", BAD, 16, lambda r, n: r["repeats"] > 0.25),
    ("stutter", BAD, 10, lambda r, n: r["stutter"] > 0.2),
    ("no sentences", BAD, 40, lambda r, n: r["sentences"] < 0.008),
    ("long words", BAD, 20, lambda r, n: r["length"] > 9.5),
    ("lines", BAD, 10, lambda r, n: r["lines"] > 0.4),
    ("digits", BAD, 10, lambda r, n: r["digits"] > 0.4),
    ("prose", GOOD, 8, lambda r, n: (r["sentences"] > 0.02) & (r["sentences"] < 0.4) & (r["symbols"] < 0.03) & (r["stutter"] < 0.03)),
    ("variety", GOOD, 8, lambda r, n: (r["repeats"] < 0.1) & (r["stutter"] < 0.02) & (r["symbols"] < 0.05) & (r["capitals"] < 0.2)),
)

#: Classes of bytes of a word's shape: lower-case or beyond ASCII, upper-case, digit; other bytes stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_WORD = U64(0x8EBC6AF09C88C6E3)
_SHAPE[97:123], _SHAPE[128:], _SHAPE[65:91], _SHAPE[48:58] = 97, 97, 65, 48


def ratios(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    c = table | {"w": np.maximum(table["n_words"], 1)}
    return {name: f(c) for name, f in RATIOS}


def votes(table: dict[str, np.ndarray]) -> np.ndarray:
    """GOOD, BAD or NONE of each voter (columns) on each document (rows)."""
    r, n = ratios(table), table["n_words"]
    return np.stack([np.where((n >= least) & test(r, n), verdict, NONE) for _, verdict, least, test in VOTERS], 1)


def features(data: np.ndarray, offsets: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight): shares of hashed words, word shapes and shape pairs, and one bucket for each binned statistic."""
    rows = len(offsets) - 1
    shape = _SHAPE[data]
    inside = np.ones(len(shape), bool)
    inside[1:] = shape[1:] != shape[:-1]
    inside[offsets[:-1][np.diff(offsets) > 0]] = True
    inside |= (shape == 32) | ((shape >= 9) & (shape <= 13))
    at = np.r_[0, np.cumsum(inside)][offsets]
    short = shape[inside]
    starts, ends, first = word_spans(short, at)
    words = word_hashes(short, starts, ends)
    row = np.repeat(np.arange(rows), np.diff(first))
    pair = row[:-1] == row[1:] if len(row) else np.zeros(0, bool)
    same = np.zeros(len(words), bool)
    exact_starts, exact_ends, _ = word_spans(data, offsets)
    exact = word_hashes(LOWER[data], exact_starts, exact_ends)
    same[1:] = (exact[1:] == exact[:-1]) & (row[1:] == row[:-1])
    share = 1.0 / np.maximum(table["n_words"], 1)
    where = [row, row, row[1:][pair], row[same]]
    what = [words, mix(exact ^ _WORD), mix(words[:-1][pair] * U64(3) + words[1:][pair]), np.full(int(same.sum()), U64(99))]
    weight = [share[r] for r in where]
    for k, value in enumerate(ratios(table).values()):
        where.append(np.arange(rows))
        what.append(mix((np.floor(value * 20) + 1000 * (k + 1)).astype(U64)))
        weight.append(np.full(rows, 0.5))
    return np.concatenate(where), (np.concatenate(what) % U64(BUCKETS)).astype(np.int64), np.concatenate(weight)


def _tables(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    for first, last, data, offsets in chunks(texts):
        yield first, last, data, offsets, dict(zip(FIELDS, statistics(data, offsets)))


def pattern_codes(texts: pa.Array) -> np.ndarray:
    """The votes on each text as one number in base 3."""
    base = 3 ** np.arange(len(VOTERS))
    parts = [votes(t) @ base for *_, t in _tables(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass
class WeakLabels:
    """How often each voter is right when it votes."""

    accuracy: np.ndarray

    @classmethod
    def fit(cls, patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> WeakLabels:
        """EM: posteriors from the accuracies, then accuracies from the posteriors of what each voter has voted on."""
        model = cls(np.full(patterns.shape[1], RIGHT / (RIGHT + WRONG)))
        for _ in range(rounds):
            p = model.posterior(patterns)[:, None]
            right = (counts[:, None] * np.where(patterns == GOOD, p, np.where(patterns == BAD, 1 - p, 0))).sum(0)
            cast = (counts[:, None] * (patterns != NONE)).sum(0)
            model = cls((right + RIGHT) / (cast + RIGHT + WRONG))
        return model

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        trust = np.log(self.accuracy / (1 - self.accuracy))
        odds = ((patterns == GOOD) * trust - (patterns == BAD) * trust).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class LinearScorer:
    weights: np.ndarray
    bias: float

    @classmethod
    def fit(cls, row: np.ndarray, bucket: np.ndarray, weight: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> LinearScorer:
        """Logistic regression on soft targets by AdaGrad over shuffled batches; a document without votes weighs nothing."""
        rng, n = np.random.default_rng(seed), len(target)
        w, b, g, gb = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-6), 1e-6
        at = np.searchsorted(row, np.arange(n + 1))
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(n), max(1, n // 128)):
                take = np.concatenate([np.arange(at[i], at[i + 1]) for i in batch]) if len(batch) else np.zeros(0, np.int64)
                local = np.repeat(np.arange(len(batch)), at[batch + 1] - at[batch])
                score = np.bincount(local, w[bucket[take]] * weight[take], len(batch)) + b
                y = target[batch]
                error = (1 / (1 + np.exp(-score)) - y) * np.abs(2 * y - 1)
                grad = np.bincount(bucket[take], error[local] * weight[take], BUCKETS) / max(1, len(batch))
                g += grad**2
                w -= 0.3 * grad / np.sqrt(g)
                gb += error.mean() ** 2 if len(batch) else 0
                b -= 0.3 * (error.mean() if len(batch) else 0.0) / np.sqrt(gb)
        return cls(w.astype(np.float32), float(b))

    def score(self, texts: pa.Array) -> np.ndarray:
        parts = []
        for first, last, data, offsets, table in _tables(texts):
            row, bucket, weight = features(data, offsets, table)
            z = np.bincount(row, self.weights[bucket] * weight, last - first) + self.bias
            parts.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(parts) if parts else np.zeros(0)


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = pattern_codes(batch.column(1))
        for first, last, data, offsets, table in _tables(batch.column(1)):
            row, bucket, weight = features(data, offsets, table)
            pair, at = np.unique(row * BUCKETS + bucket, return_inverse=True)
            total = np.bincount(at, weight)
            ends = np.searchsorted(pair // BUCKETS, np.arange(last - first + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in ((pair % BUCKETS).astype(np.int32), total.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(codes[first:last]), *lists], ["turn", "code", "buckets", "weights"])


def _unpack(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(VOTERS)) % 3


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> tuple[WeakLabels, LinearScorer]:
    """Learn voters from the patterns of all documents, and the scorer from about `sample_docs` of them.

    To the driver come counts of at most 3 ** 10 patterns and the sample's hashed features: about `sample_docs` rows and
    `sample_chars` characters, whichever is less.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    code = F.arrow_udf(lambda texts: pa.array(pattern_codes(texts).astype(np.int64)), "long")
    seen = rows.select(code(F.col("text")).alias("code"), F.length("text").alias("chars")).groupBy("code").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).orderBy("code").toArrow()
    codes, counts = seen["code"].to_numpy(), seen["count"].to_numpy().astype(float)
    share = min(1.0, sample_docs / max(1.0, counts.sum()), sample_chars / max(1, sum(seen["chars"].to_pylist())))
    model = WeakLabels.fit(_unpack(codes), counts)
    turn = F.xxhash64("id", F.length("text"), F.lit(SEED))
    drawn = rows.where(F.pmod(turn, F.lit(1 << 30)) < int(share * (1 << 30))).select(turn.alias("turn"), "text")
    sample = drawn.mapInArrow(_sample_task, "turn long, code long, buckets array<int>, weights array<float>").orderBy("turn", "code").toArrow()
    buckets, weights = sample["buckets"].combine_chunks(), sample["weights"].combine_chunks()
    row = np.repeat(np.arange(len(buckets)), np.diff(buckets.offsets.to_numpy()))
    target = model.posterior(_unpack(sample["code"].to_numpy()))
    return model, LinearScorer.fit(row, buckets.flatten().to_numpy(), weights.flatten().to_numpy().astype(float), target)


def scorer(spark: SparkSession, model: LinearScorer) -> Callable[[Column], Column]:
    """A function from a text column to its probability of being good."""
    shared = spark.sparkContext.broadcast(model)
    scored = F.arrow_udf(lambda texts: pa.array(shared.value.score(texts)), "double")
    return lambda text: scored(text.cast("string"))


def classify(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, quality double, kept) of every row; kept where quality is at least `threshold`.

    A null text is scored as an empty one. Null ids and repeated rows are scored by their texts. Texts are read whole.
    An empty table gives no rows; other columns are not read.
    """
    _, linear = fit(docs, id_col=id_col, text_col=text_col, sample_docs=sample_docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), scorer(spark, linear)(F.col(text_col)).alias("quality"))
    return rows.select("doc_id", "quality", (F.col("quality") >= threshold).alias("kept"))

"""Quality rules: fixed limits on rule statistics, then an isolation forest over them.

Trees split the box that the corpus spans at random features and places, and count there a small sample of
documents labelled good; where few splits leave none of these, a document is an anomaly. Junk is too common in
a raw corpus to be isolated among itself. The score above which a document is dropped comes from labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.llm.common import Scratch
from strandwork.llm.stats import FIELDS, rule_statistics

#: Documents labelled good (about; a hash decides) from which trees draw; trees, documents of a tree, levels.
SAMPLE_DOCS, TREES, TREE_DOCS, LEVELS = 8192, 100, 256, 10
SEED = 7
#: Largest share of good labelled documents that the threshold may drop, and bins of scores in its search.
MAX_LOSS, BINS = 0.004, 2000
#: Words, lines or letters of usual text that are added to each document's own before a ratio is taken.
STEADY = 40
BASE = FIELDS[:5]


def features(s: Callable[[str], Column]) -> Column:
    """Array of doubles: what the trees split on, roots of ratios that are drawn to usual values, or few words would make them extreme."""
    drawn = lambda part, whole, usual: F.sqrt((s(part) + usual * STEADY) / (s(whole) + STEADY))
    return F.array(
        drawn("word_chars", "n_words", 5.0),
        drawn("n_symbols", "n_words", 0.0),
        drawn("n_dup_lines", "n_lines", 0.0),
        drawn("n_repeat_words", "n_words", 0.0),
        drawn("n_upper", "n_letters", 0.02),
        drawn("n_same_words", "n_words", 0.0),
        drawn("n_digits", "word_chars", 0.0),
        drawn("n_ends", "n_words", 0.08),
    )


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n keys of a binary search tree."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


@dataclass
class IsolationForest:
    """Each tree as arrays of a complete binary tree: feature (-1 at leaves), place of the split, path length at leaves."""

    feature: np.ndarray
    place: np.ndarray
    path: np.ndarray
    norm: float

    @classmethod
    def fit(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, size: int = TREE_DOCS, levels: int = LEVELS, seed: int = SEED) -> IsolationForest:
        rng, size, nodes = np.random.default_rng(seed), min(size, len(x)), 2 ** (levels + 1) - 1
        feature, place, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        wide = np.flatnonzero(high > low)
        for t in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), size, replace=False)] if size else x, low, high)]
            while todo:
                node, level, rows, a, b = todo.pop()
                if level == levels or len(rows) < 2 or not len(wide):
                    path[t, node] = level + _expected(len(rows))
                    continue
                f = int(rng.choice(wide))
                at = rng.uniform(a[f], b[f])
                feature[t, node], place[t, node] = f, at
                left, below, above = rows[:, f] <= at, b.copy(), a.copy()
                below[f] = above[f] = at
                todo += [(2 * node + 1, level + 1, rows[left], a, below), (2 * node + 2, level + 1, rows[~left], above, b)]
        return cls(feature, place, path, float(max(_expected(size), 1e-9)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for anomalies, 0.5 and less for the common."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, place, path in zip(self.feature, self.place, self.path):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.maximum(feature[node], 0)
                node = np.where(inner, 2 * node + 1 + (x[rows, f] > place[node]), node)
            total += path[node]
        return 2.0 ** -(total / max(1, len(self.feature)) / self.norm)


def _scorer(spark: SparkSession, forest: IsolationForest) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def scored(values: pa.Array) -> pa.Array:
        flat = values.flatten().to_numpy(zero_copy_only=False)
        return pa.array(shared.value.score(flat.reshape(len(values), -1)) if len(values) else np.zeros(0))

    return scored


def _sample(rows: DataFrame, n: int) -> np.ndarray:
    """Features of about `n` rows, or of all where there are less, in an order of their own: the same trees each time."""
    share = min(1.0, n / max(1, rows.count()))
    drawn = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))
    x = np.array(rows.where(drawn).select("x").toArrow()["x"].to_pylist(), float).reshape(-1, 8)
    return x[np.lexsort(x.T)]


def _box(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each feature over all rows; zeros without a row."""
    found = rows.agg(*[f(F.col("x")[k]) for f in (F.min, F.max) for k in range(8)]).first()
    low, high = np.array([0.0 if v is None else v for v in found]).reshape(2, 8)
    return low, high


def threshold(scored: DataFrame, labels: DataFrame, max_loss: float = MAX_LOSS) -> float:
    """The score that best parts labelled rows: most bad above it less good above it, with at most `max_loss` of the good.

    Counts per bin and label come to the driver: at most 2 * BINS rows. Without labels of both kinds nothing is above it.
    """
    bins = scored.join(labels, "doc_id").groupBy("quality", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    above = np.zeros((2, BINS + 1))
    for r in bins.where("quality in (0, 1)").collect():
        above[r["quality"], r["bin"]] += r["count"]
    share = [c[::-1].cumsum()[::-1] / c.sum() if c.sum() else None for c in above]
    if share[0] is None or share[1] is None:
        return 1.01
    gain = np.where(share[1] <= max_loss, share[0] - share[1], -1.0)
    return int(gain.argmax()) / BINS if gain.max() > 0 else 1.01


def held_out_errors(judged: DataFrame, labels: DataFrame) -> dict[str, float]:
    """Shares of judged documents that passed the base rules and are wrong: `good_dropped` and `bad_kept`.

    Judge with labels of some documents, and measure with the labels of others.
    """
    rows = judged.where(~F.col("base_failed")).join(labels.select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    kept = F.col("kept").cast("double")
    found = rows.agg(F.avg(F.when(F.col("quality") == 1, 1 - kept)).alias("good_dropped"), F.avg(F.when(F.col("quality") == 0, kept)).alias("bad_kept")).first()
    return found.asDict()


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, max_loss: float = MAX_LOSS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly) of every row.

    `base_failed`: fewer than 20 words, or more than 30 % of them in repeated 8-word windows. `kept`: not failed
    and no anomaly. Null texts have no words. Null ids and repeated rows are judged by their text; labels with a
    null id, or an id twice, count as they stand. The statistics of all texts are measured once; all documents that
    pass the base rules span the box, about `sample_docs` of them that are labelled good (or, without any, of all)
    fill the trees, and all labelled ones set the threshold. An empty table gives no rows. Texts are read whole, whatever
    their length. Other columns of `docs` and `labels` are not read, so their names do not matter.
    """
    s = lambda f: F.col(f"s.{f}")
    measured = docs.select(F.col(id_col).alias("doc_id"), rule_statistics(F.col(text_col)).alias("s"))
    failed = (s("n_words") < 20) | (100 * s("n_repeat_words") > 30 * s("n_words"))
    measured = scratch.table(measured.select("doc_id", *[s(f).alias(f) for f in BASE], failed.alias("base_failed"), features(s).alias("x")), "stats")
    passed, marks = measured.where(~F.col("base_failed")), labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    good = passed.join(marks.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    x, (low, high) = _sample(good, sample_docs), _box(passed)
    x = x if len(x) else _sample(passed, sample_docs)
    scored = measured.withColumn("anomaly", _scorer(spark, IsolationForest.fit(x, low, high))(F.col("x"))).drop("x")
    limit = threshold(scored.where(~F.col("base_failed")), marks, max_loss)
    return scored.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("anomaly") < limit)).alias("kept"), "anomaly")

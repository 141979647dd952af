"""Language identification by bit-sliced Bloom filters of letter n-grams.

One table of bit masks serves all languages: bit l of a slot belongs to the Bloom filter of language l, so the
AND of an n-gram's slots is the set of all languages that contain it. For a text the bits are counted per
language, and each count is corrected for the false positives that its filter's fill makes likely. Masks have as
many 64-bit words as the languages need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandwork.llm.text import U64, chunks, mix

#: Documents per language from which n-grams are learnt (about; a hash of id and text decides).
SAMPLE_DOCS = 4000
#: An n-gram belongs to a language if this share of its sampled documents has it, and at least this part of the largest such share of any language.
MIN_SHARE, MIN_RATIO = 0.004, 0.1
SLOTS_PER_GRAM, HASHES = 24, 3
UNKNOWN = "und"
#: Bytes of text whose n-grams are looked up at once: each takes some ten numbers of 8 bytes.
CHUNK = 1 << 17

_fold: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """For every code point: its lower-case letter, or 0 where there is no letter."""
    if not _fold:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold.append(table)
    return _fold[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every 3- and 4-gram of letters inside words, whose edges count as one character each; in row order for each length."""
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _fold_table()[codes]
    codes = np.append(np.insert(codes, at[:-1], 0), np.uint32(0))
    row = np.repeat(np.arange(len(at)), np.append(np.diff(at) + 1, 1))
    keep = (codes != 0) | np.append(codes[1:] != 0, True)  # the last of several edges
    codes, row = codes[keep].astype(U64), row[keep]
    a, b, c = codes[:-2], codes[1:-1], codes[2:]
    three = mix(a << U64(42) | b << U64(21) | c)
    inside = b != 0
    four = inside[:-1] & (c[:-1] != 0)
    return (
        np.concatenate([row[1:-1][inside], row[1:-2][four]]),
        np.concatenate([three[inside], mix(three[:-1][four] + codes[3:][four])]),
    )


def _slots(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    step = mix(hashes) | U64(1)
    for k in range(HASHES):
        yield ((hashes + step * U64(k)) & U64(size - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    """masks[w]: for each slot, word w of its set of languages; each word is as narrow as its languages allow."""

    languages: list[str]
    masks: list[np.ndarray]
    false_positive: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], members: list[np.ndarray]) -> LanguageModel:
        """members: the n-gram hashes of each language."""
        size = 1 << max(10, int(SLOTS_PER_GRAM * max([1, *map(len, members)]) - 1).bit_length())
        masks, fill = [], []
        for first in range(0, len(languages), 64):
            part = members[first : first + 64]
            kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(k).bits >= len(part))
            word = np.zeros(size, kind)
            for bit, hashes in enumerate(part):
                for slot in _slots(hashes, size):
                    word[slot] |= kind(1 << bit)
            fill += [np.count_nonzero(word >> kind(b) & kind(1)) / size for b in range(len(part))]
            masks.append(word)
        return cls(languages, masks, np.array(fill) ** HASHES)

    def _counts(self, row: np.ndarray, hashes: np.ndarray, rows: int) -> Iterator[np.ndarray]:
        """For each language, how many of each row's n-grams its filter has."""
        for at, word in enumerate(self.masks):
            found = np.full(len(hashes), np.iinfo(word.dtype).max, word.dtype)
            for slot in _slots(hashes, len(word)):
                found &= word[slot]
            for b in range(min(64, len(self.languages) - 64 * at)):
                yield np.bincount(row, (found >> word.dtype.type(b)) & word.dtype.type(1), minlength=rows)

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text the language, its part of all languages' corrected counts, and its part of the text's n-grams."""
        names, scores, known = [], [np.zeros(0)], [np.zeros(0)]
        for first, last, data, offsets in chunks(texts, CHUNK):
            row, hashes = grams(data, offsets)
            rows = last - first
            n = np.bincount(row, minlength=rows).astype(float)
            total, most, best = np.zeros(rows), np.full(rows, -1.0), np.zeros(rows, np.int64)
            for language, (count, fp) in enumerate(zip(self._counts(row, hashes, rows), self.false_positive)):
                corrected = np.maximum(0.0, (count - n * fp) / max(1 - fp, 1e-9))
                total += corrected
                best[corrected > most] = language
                most = np.maximum(most, corrected)
            most = np.maximum(most, 0.0)
            scores.append(np.where(total > 0, most / np.maximum(total, 1e-12), 0.0))
            known.append(np.minimum(1.0, most / np.maximum(n, 1.0)))
            names += [self.languages[b] if k and self.languages else UNKNOWN for b, k in zip(best.tolist(), n.tolist())]
        return names, np.concatenate(scores), np.concatenate(known)


def _gram_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, docs): in how many of the batch's documents of a language an n-gram stands."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes, names = langs.indices.to_numpy(zero_copy_only=False), langs.dictionary.to_pylist()
        for first, last, data, offsets in chunks(batch.column(1), CHUNK):
            row, hashes = grams(data, offsets)
            order = np.lexsort((hashes, row))
            row, hashes = row[order], hashes[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
            lang, hashes = codes[first + row[new]], hashes[new]
            for code in np.unique(lang):
                gram, docs = np.unique(hashes[lang == code], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([names[code]] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(docs)], ["lang", "gram", "docs"])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4: what decides who is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> LanguageModel:
    """Learn from all given rows with a text and a language, or from about `sample_docs` of each language where there are more.

    Only counts per language and the kept n-grams come to the driver: with L languages and texts of g distinct
    n-grams on average at most L * g / min_share hashes. Any number of languages may be learnt. An empty table gives
    a model without languages.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("sample")).alias("h")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").collect()}
    if not sizes:
        return LanguageModel.fit([], [])
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))])
    sample = rows.where(F.pmod("h", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)).select("lang", "text")
    counted = sample.mapInArrow(_gram_task, "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    taken = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(float(min(n, sample_docs))))])
    shares = counted.withColumn("share", F.col("docs") / F.element_at(taken, F.col("lang"))).where(F.col("share") >= min_share)
    best = shares.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("lang", "share")).alias("langs"))
    kept = best.select("gram", F.explode("langs").alias("l"), "best").where(F.col("l.share") >= min_ratio * F.col("best"))
    table = kept.select(F.col("l.lang").alias("lang"), "gram").toArrow()
    lang, gram = np.array(table["lang"].to_pylist(), object), table["gram"].to_numpy().view(U64)
    return LanguageModel.fit(list(sizes), [np.sort(gram[lang == k]) for k in sizes])


def predict(spark: SparkSession, model: LanguageModel) -> Callable[[Column], Column]:
    """A function from a text column to struct<lang, score, known>.

    `lang` is `und` with score 0 for a null text or one without a letter. The score is the winner's part of the
    corrected counts of all languages: 0 if no n-gram is known, 1 if all that are known are the winner's alone.
    `known` is the winner's part of the text's own n-grams, whatever other languages have them.
    Ties go to the language that sorts first. Texts are read whole, whatever their length.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, known double")
    def predicted(texts: pa.Array) -> pa.Array:
        names, *numbers = shared.value.score(texts)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], ["lang", "score", "known"])

    return lambda text: predicted(text.cast("string"))


def identify(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learnt from the rows that are not held out.

    Rows with a null id are learnt from and count as not held out. Repeated rows are predicted alike. Texts are read
    whole, whatever their length; null and empty ones are `und` with score 0. An empty table gives no rows. Other
    columns are not read, so their names do not matter.
    """
    held = F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False))
    model = fit(docs.where(~held), id_col=id_col, text_col=text_col, lang_col=lang_col)
    guess = predict(spark, model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), guess(F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))

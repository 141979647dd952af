"""All five stages on small tables against plain Python: nulls, copies, repeated rows, clashing columns, nothing."""

import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandwork.llm import op4_language, op5_weak_labels
from test_op2_jaccard import brute
from test_op7_op9_tokens import check_packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with the names that operators use.
CLASHING = ", _row long, row string, size string, taken int, component_id string, rank string, d string, p int, g string, turn string, cut int"


def documents(spark, seed, clashing=False):
    rng = random.Random(seed)
    vocabulary = {k: ["".join(rng.choice(x) for _ in range(rng.randrange(2, 8))) for _ in range(80)] for k, x in (("en", "abcdefgh"), ("de", "klmnopqöä"))}
    sentence = lambda k: " ".join(rng.choice(vocabulary[k]) for _ in range(rng.randrange(6, 14))).capitalize() + ". "
    rows = []
    for i in range(90):
        lang = rng.choice(["en", "en", "de"])
        rows.append((i if i % 11 else None, "".join(sentence(lang) for _ in range(rng.randrange(2, 9))).strip(), lang, rng.choice(["web", "books", None])))
    for k in rng.sample(range(90), 25):  # copies, near and exact, and rows that stand twice
        i, text, lang, source = rows[k]
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows += [(rng.randrange(200, 300), " ".join(words), lang, source), (i, text, lang, source)]
    rows += [(400, None, "en", "web"), (401, "", None, "web"), (402, " \n ", "de", None), (403, "12345 678 !!", "en", "web"), (404, "xyzzy zzyzx vwvw zyxw wvyz " * 6, None, "web"), (405, "### $$$ %%% &&& ||| " * 30, "en", "web")]
    rng.shuffle(rows)
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    if not clashing:
        return spark.createDataFrame(rows, DOC).repartition(3)
    more = [(*r, k, f"r{k}", "s", k, "c", "k", "d", k, "g", "t", k) for k, r in enumerate(rows)]
    return spark.createDataFrame(more, DOC + CLASHING).repartition(3)


def collected(df):
    return [tuple(r) for r in df.collect()]


def plain_language(rows, model):
    """Rows whose language explains at least half of what it explains of nearly all that it was learnt from."""
    import zlib

    names, _, known = model.score(pa.array([r[1] for r in rows], pa.string()))
    learnt = sorted(k for r, n, k in zip(rows, names, known) if n != "und" and r[2] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2))
    usual = learnt[max(0, math.ceil(0.05 * len(learnt)) - 1)]
    return [r for r, n, k in zip(rows, names, known) if n != "und" and k >= 0.5 * usual]


def plain_mix(rows):
    """{source: (words of all its rows, words that the mix takes)} by filling water step by step."""
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 3 * size[s]
            left -= 3 * size[s]
        free -= full
    return {s: (size[s], target[s]) for s in names}


@pytest.mark.parametrize("seed", [1, 2])
def test_stages_equal_plain_versions(spark, seed):
    docs = documents(spark, seed)
    model = op4_language.fit(docs.where("not (doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)"))
    first = corpus_pipeline.keep_known_languages(spark, docs, "")
    rows = collected(first)
    assert first.columns == docs.columns and Counter(rows) == Counter(plain_language(collected(docs), model))
    assert not {400, 401, 402, 403, 404} & {r[0] for r in rows}

    first = spark.createDataFrame(rows, docs.schema).repartition(3)
    _, linear = op5_weak_labels.fit(first)
    second = corpus_pipeline.keep_good_quality(spark, first, "")
    scores = linear.score(pa.array([r[1] for r in rows], pa.string()))
    rows2 = collected(second)
    assert Counter(rows2) == Counter(r for r, x in zip(rows, scores) if x >= op5_weak_labels.THRESHOLD)

    second = spark.createDataFrame(rows2, docs.schema).repartition(3)
    rows3 = collected(corpus_pipeline.keep_one_of_similar(spark, second, ""))
    classes = brute(list(enumerate(r[1] for r in rows2)), words=5, percent=80)
    best = {}
    for k, _, component in classes:
        rank = (rows2[k][0] is None, rows2[k][0] or 0)
        if component not in best or rank < best[component][0]:
            best[component] = rank, k
    assert len(rows3) == len(best) and sorted((r[0] is None, r[0] or 0) for r in rows3) == sorted(rank for rank, _ in best.values())

    third = spark.createDataFrame(rows3, docs.schema).repartition(3)
    fourth = corpus_pipeline.mix_sources(spark, third, "")
    rows4, taken = collected(fourth), defaultdict(int)
    texts = {r[:1] + r[2:4]: r[1] for r in rows3}
    for r in rows4:
        taken[r[3]] += len(WORD.findall(r[1] or ""))
        assert r[4] == len(r[1]) and (r[0] is None or texts[r[:1] + r[2:4]].startswith(r[1]))
    for source, (size, target) in plain_mix(rows3).items():
        assert abs(taken[source] - target) <= 1 and taken[source] <= 3 * size
    assert Counter(collected(corpus_pipeline.mix_sources(spark, third.repartition(2), ""))) == Counter(rows4)

    last = [tuple(r) for r in corpus_pipeline.pack_windows(spark, spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows4)], docs.schema).coalesce(2), "").collect()]
    check_packing([(k, r[1]) for k, r in enumerate(rows4)], last, 2048)


def test_language_stage_guesses_once_for_the_limit_and_once_for_the_verdict(spark, monkeypatch):
    guessed, predict = spark.sparkContext.accumulator(0), op4_language.predict

    def counted(session, model):
        guess = predict(session, model)

        @F.arrow_udf("string")
        def seen(texts: pa.Array) -> pa.Array:
            guessed.add(len(texts))
            return texts

        return lambda text: guess(seen(text))

    docs = documents(spark, 5)
    want = Counter(collected(corpus_pipeline.keep_known_languages(spark, docs, "")))
    monkeypatch.setattr(op4_language, "predict", counted)
    kept = corpus_pipeline.keep_known_languages(spark, docs, "")
    learnt = docs.where("lang is not null and not (doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 = 2)").count()
    assert guessed.value == learnt
    assert Counter(collected(kept)) == want and guessed.value == learnt + docs.count()


def test_stages_keep_columns_whatever_their_names(spark):
    plain, wide = documents(spark, 3), documents(spark, 3, clashing=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        a, b = stage(spark, plain, ""), stage(spark, wide, "")
        assert b.columns == wide.columns
        assert Counter(r[:5] for r in collected(b)) == Counter(collected(a)) or stage is corpus_pipeline.keep_one_of_similar
        numbers = {r[5]: r[8] for r in collected(wide)}
        assert all(numbers[r[5]] == r[8] == r[5] for r in collected(b))


def test_stages_of_nothing(spark):
    empty = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    null = spark.createDataFrame([(None, None, None, None, None)] * 3, DOC)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, null, "").count()


def test_run_chains_all_stages(spark, tmp_path):
    docs = documents(spark, 4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, step, "").write.parquet(str(tmp_path / f"s{k}"))
        step = spark.read.parquet(str(tmp_path / f"s{k}"))
    want = corpus_pipeline.pack_windows(spark, step, "").selectExpr("sum(length)", "count(distinct doc_id)", "max(doc_tokens)").first()
    assert out.columns[:3] == ["doc_id", "start", "length"] and tuple(out.selectExpr("sum(length)", "count(distinct doc_id)", "max(doc_tokens)").first()) == tuple(want)

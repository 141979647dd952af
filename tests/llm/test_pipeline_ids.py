from collections import Counter

import corpus_pipeline

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_repeated_ids_are_documents_of_their_own(spark):
    base = [f"w{i}" for i in range(60)]
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (58, 59)]  # similar to the whole and to each other
    alone = [" ".join(f"{k}-{i}" for i in range(30)) for k in range(6)]
    rows = [(None, near[0]), (None, near[1]), (5, " ".join(base)), (None, alone[0]), (None, alone[1]), (7, alone[2]), (7, alone[3]), (8, alone[4]), (None, alone[5])]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], DOC)
    kept = corpus_pipeline.keep_one_of_similar(spark, docs, "").collect()
    want = rows[2:]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(want)
    # one source takes each document once
    mixed = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in mixed) == Counter(rows)

import random

from pyspark.sql import functions as F

from strandwork.llm import op10_forest
from strandwork.llm.common import Scratch


def test_rare_junk_outside_the_sample_is_isolated(spark):
    rng = random.Random(4)
    plain = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(rng.randint(30, 60))) for _ in range(400)]
    marked = " ".join(w[:-1] + "#" for w in plain[0].split())  # like the first, but the only one with symbols
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*enumerate(plain), *((i, marked) for i in (1000, 1001))], "doc_id long, text string")
    out = op10_forest.judge(spark, docs, labels, Scratch(spark, "t10"), sample_docs=20)
    top = out.orderBy(F.desc("anomaly")).select("doc_id", "anomaly").take(3)
    assert {r["doc_id"] for r in top[:2]} == {1000, 1001} and top[1]["anomaly"] > top[2]["anomaly"]

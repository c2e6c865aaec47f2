import numpy as np

from itemweld.llm import quality
from itemweld.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    taught = labels.where("doc_id % 3 <> 0")
    model = quality.fit(docs, taught)
    rows = quality.score(docs.join(labels, "doc_id").where("doc_id % 3 = 0"), model).select("quality", "quality_view.keep").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [not r.keep for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) > 0.95
    assert model.rounds and all(sum(r) >= 0 for r in model.rounds)


def test_rounds_pass_labels_between_the_views():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 2000)
    t, m = np.zeros((2000, 30)), np.zeros((2000, 12))
    t[np.arange(2000), rng.integers(0, 15, 2000) + 15 * y] = 1
    m[np.arange(2000), rng.integers(0, 6, 2000) + 6 * y] = 1
    model = quality.co_train(t[:40], m[:40], y[:40], t[40:1500], m[40:1500], ["x"], per_round=100, sure=0.6)
    assert sum(a for a, _ in model.rounds) > 0 and sum(b for _, b in model.rounds) > 0
    p = model.score(t[1500:], m[1500:])
    assert ((p >= 0.5) == (y[1500:] == 1)).mean() > 0.97


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(none, labels)
    assert quality.score(none, model).collect() == []
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (None, "words here", None, "s", 10),
                                 (5, "long " * 100_000, "en", "s", -1)], schema)
    got = quality.score(odd.withColumn("quality_view", odd.lang), model).collect()
    assert [r.quality_view.keep for r in sorted(got, key=lambda r: r.doc_id or 9)][:3] == [False] * 3
    one_class = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (2, 7)], "doc_id long, quality int")
    assert all(0 <= r.quality_view.score <= 1 for r in quality.score(odd, quality.fit(odd, one_class)).collect())


def test_query_covers_the_table(spark):
    assert QUERIES["op1_cotrained_quality"](spark, "/root/testdata/sf0.01").count() == 1000

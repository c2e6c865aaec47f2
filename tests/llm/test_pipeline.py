import corpus_pipeline as C
import pytest

from itemweld.llm import langid, quality

import sys
sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_linededup import brute as brute_lines
from test_neardup import brute as brute_near

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def plain(df):
    return {r.doc_id: r for r in df.collect()}


def test_stage_order_and_columns(spark, docs):
    assert [n for n, _ in C.STAGES] == ["quality", "language", "lines", "near_duplicates", "packing"]
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns


def test_filters_keep_what_their_operators_accept(spark, docs):
    before = plain(docs)
    kept = plain(C.quality_stage(spark, docs, FOLDER))
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, model).collect() if r.quality_view.score >= 0.5}
    assert set(kept) == want and all(kept[i] == before[i] for i in kept)
    named = plain(C.language_stage(spark, docs, FOLDER))
    want = {r.doc_id for r in langid.identify(docs, langid.learn(docs)).collect() if r.language.accepted}
    assert set(named) == want and all(named[i] == before[i] for i in named)


def test_line_and_near_duplicate_stages_equal_brute_force(spark, docs):
    before = plain(docs)
    gone = brute_lines([(i, r.text) for i, r in before.items()])
    cleaned = plain(C.line_stage(spark, docs, FOLDER))
    for i, r in before.items():
        text = "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone[i])
        if gone[i] and not text.strip():
            assert i not in cleaned
        else:
            assert cleaned[i].text == text and cleaned[i].n_chars == len(text)
    groups = brute_near([(i, r.text) for i, r in before.items()])
    assert set(plain(C.neardup_stage(spark, docs, FOLDER))) == {i for i, (_, c) in groups.items() if c == i}


def test_run_chains_the_stages(spark, docs):
    rows = C.run(spark, FOLDER).collect()
    left = {r.doc_id for r in rows}
    assert 0 < len(left) < docs.count()
    assert all(sum(p.length for p in rows if p.doc_id == i) == next(p.doc_tokens for p in rows if p.doc_id == i) for i in list(left)[:20])


def test_empty_and_odd_tables(spark, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", None), (3, "12 34", "xx", "s", 5),
                                 (4, "word " * 3000, "en", "s", 15000), (4, "word " * 3000, "en", "s", 15000)], docs.schema)
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
        stage(spark, odd, FOLDER).collect()
    one = C.neardup_stage(spark, odd.withColumn("component_id", odd.source), FOLDER).collect()
    assert sum(r.doc_id == 4 for r in one) == 1 and len(one) == 5


def test_rows_of_one_id_are_judged_by_their_own_texts(spark, docs):
    a, b, c = ("".join(f"{x}{i} " for i in range(60)) for x in "abc")
    rows = [(1, a), (2, b), (2, c), (3, c), (4, a), (4, "other words of this row only"), (5, b), (5, b), (6, None), (6, None), (None, a)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], docs.schema)
    left = sorted(((r.doc_id, r.text) for r in C.neardup_stage(spark, df, FOLDER).collect()), key=repr)
    assert [t for _, t in left].count(b) == 1 and (1, a) in left and (3, c) in left and (None, a) in left
    assert (4, "other words of this row only") in left and left.count((6, None)) == 2 and len(left) == 7

import zlib

from itemweld.llm import langid
from itemweld.llm.queries import QUERIES


def test_held_out_accuracy_whole_table(spark):
    rows = QUERIES["op10_language_id"](spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    train = spark.createDataFrame([(i, "the thing and that other " * 5, "en") for i in range(20)]
                                  + [(i, "der die das und nicht ein " * 5, "de") for i in range(20)]
                                  + [(99, None, "en"), (98, "x", None), (None, "the", "en")],
                                  "doc_id long, text string, lang string")
    known = langid.learn(train)
    assert list(known) == ["de", "en"]
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (4, "und das nicht " * 30), (5, "the other " * 40_000),
                                 (5, "the other " * 40_000), (None, "q")], "doc_id long, text string")
    got = langid.identify(odd.withColumn("language", odd.text), known).collect()
    by = {r.doc_id: r.language for r in got}
    assert len(got) == 7
    assert all(by[i].lang_pred == "und" and not by[i].accepted and by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred == "de" and by[5].lang_pred == "en" and by[5].accepted
    assert by[None].margin == 0 and not by[None].accepted      # nothing to tell by: a tie is narrow


def test_nothing_learned(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(none) == {}
    assert langid.identify(none, {}).collect() == []
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert langid.identify(one, {}).first().language.lang_pred == "und"

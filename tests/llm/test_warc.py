import gzip
import hashlib

import pytest
from compare import compare

from itemweld.llm import warc
from itemweld.llm.queries import QUERIES, SQL
from itemweld.sources.staging import Stages


@pytest.fixture
def rows():
    big, other = "x" * 1500, "ü" * 700
    return [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", other), (None, "n", other), (5, "s", "small"),
            (6, "s", "small"), (7, "z", None), (8, "z", ""), (9, "l", "<p>long</p>" * 400_000), (9, "l", "<p>long</p>" * 400_000)]


def test_round_trip_revisits_and_edges(spark, rows):
    stages = Stages(spark, "t")
    folder = f"{stages.folder}/archives"
    df = spark.createDataFrame([r + ("clash", 0) for r in rows], "page_id long, url string, html string, digest string, size int")
    index = warc.write(df, folder, stages=stages, archive_bytes=2000)
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert {p: (by[p].record_type, by[p].refers_to) for p in by} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), None: ("revisit", 4),
        5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None)}
    for p, _, html in rows:
        body = (html or "").encode()
        assert by[p].payload_bytes == len(body) and by[p].payload_digest == hashlib.sha1(body).hexdigest()
        assert by[p].html == ((html or "") if by[p].record_type == "response" else None)
    assert by[2].url == "http://b%0D%0AX: y" and by[3].url == ""
    # Any archive is also one plain gzip stream of records.
    system, base = warc.store(folder)
    for r in index.select("file").distinct().collect():
        with system.open_input_stream(f"{base}/{r.file}", compression=None) as s:
            assert gzip.decompress(s.read()).startswith(b"WARC/1.1\r\n")


def test_selected_records_only(spark, rows):
    stages = Stages(spark, "t")
    folder = f"{stages.folder}/archives"
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder, stages=stages)
    assert [r.html for r in warc.read(index.where("page_id = 4"), folder).collect()] == ["ü" * 700]
    assert warc.read(index.where("page_id = 77"), folder).collect() == []


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("a", 200, 5), ("b", 205, 1)]
    assert [len(r) for r in warc.ranges(rows, gap=30, most=100)] == [3, 1, 1]
    assert [len(r) for r in warc.ranges(rows, gap=30, most=20)] == [2, 1, 1, 1]


def test_empty_table(spark):
    stages = Stages(spark, "t")
    index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"), stages.folder + "/a", stages=stages)
    assert warc.read(index, stages.folder + "/a").collect() == []


def test_query_matches_sql(spark):
    name = "op6_warc_index_first"
    problem, rows, _, _ = compare(spark, "/root/testdata/sf0.01", name, QUERIES[name], SQL[name])
    assert problem is None and rows == 250, problem

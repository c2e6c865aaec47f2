import numpy as np
import pytest
from compare import compare

from itemweld.llm import mtree
from itemweld.llm.queries import QUERIES, SQL


def brute(rows, every=50, k=5):
    """Repeated rows count each; of the rows of a query's id the first asks."""
    vecs = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    out = set()
    for q, a in {i: v for i, v in reversed(vecs)}.items():
        if q % every == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in vecs if v != q and len(b) == len(a)))
            out |= {(q, r + 1, v, -s) for r, (s, v) in enumerate(scored[:k])}
    return out


def test_query_matches_sql(spark):
    name = "op7_mtree_topk"
    problem, rows, _, _ = compare(spark, "/root/testdata/sf0.01", name, QUERIES[name], SQL[name])
    assert problem is None and rows == 50, problem


def test_copies_ties_small_blocks_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PIVOTS", 5)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, -0.25, 1.0, 0.0, 2.0, -1.5]) for i in range(150)]          # one hot vector: ties
    rows += [(1000 + i, rng.normal(0, 40, 3).tolist()) for i in range(3)]               # fewer candidates than five
    df = spark.createDataFrame(rows + rows[:20], "vec_id long, embedding array<double>")
    got = mtree.top_k(df.selectExpr("*", "1 AS dim", "'x' AS x")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute(rows + rows[:20])


def test_components_of_any_size(spark):
    """Scores beyond 2^53 to the last digit, and products far beyond a long that no result needs."""
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0, 1, 4) * 2.0 ** (3 * (i % 8))).tolist()) for i in range(120)]
    rows += [(120 + i, [2.0 ** 22, 1.0 + i / 256, -1.0, 0.0]) for i in range(60)]          # scores differ in the last digits
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in mtree.top_k(df).collect()} == brute(rows)
    apart = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1e30]), (3, [-1e300, 5.0])] + [(10 + i, [1.5, float(i)]) for i in range(6)]
    df = spark.createDataFrame(apart, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in mtree.top_k(df).collect()} == brute(apart)
    for x in (1e30, -1e30):
        with pytest.raises(Exception, match="does not fit a long"):
            mtree.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (6, [x, 1.0])], df.schema)).collect()


def test_repeated_rows_count_each(spark):
    rows = [(50, [1.0, 1.0])] * 3 + [(1, [2.0, 2.0])] * 3 + [(2, [3.0, 0.0])] * 40 + [(3, [1.0, 4.0])]
    got = [tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert len(got) == 5 and set(got) == brute(rows)


def test_rows_that_take_no_part(spark):
    bad = [(0, [1.0, 2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (None, [1.0, 1.0]),
           (5, []), (7, [0.0, 0.0]), (50, [0.0, 0.0])]
    df = spark.createDataFrame(bad, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in mtree.top_k(df).collect()}
    assert got == brute([(i, v) for i, v in bad if i in (0, 7, 50)])
    assert mtree.top_k(df.limit(0)).collect() == []


def test_tree_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 300, (40, 8))
    x = np.floor(centers[rng.integers(0, 40, 3000)] + rng.normal(0, 6, (3000, 8))).astype(np.int64)
    ids, x = np.arange(3000) + 1, x.astype(float)
    unit = float(np.sqrt((x ** 2).sum(1).max())) * mtree.SMALL
    tree = mtree.Tree(mtree.build("b", ids, x, unit), 8, unit)
    for q, found in zip(x[:20], tree.search(np.full(20, -1), x[:20], 5, np.full(20, np.nan))):
        want = sorted(zip((-(x @ q)).tolist(), ids.tolist()))[:5]
        assert found == [(-a, b) for a, b in want]
    assert tree.computed < 20 * 3000 / 3

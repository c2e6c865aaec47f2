import numpy as np
import pytest
from compare import compare

from itemweld.llm import hardneg
from itemweld.llm.queries import QUERIES, SQL


def brute(rows, every=50, positives=5, negatives=3):
    vecs = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows]
    out = []
    for a, own, q in vecs:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w)), i, label) for i, label, w in vecs if i != a and len(w) == len(q))
        for s, p, _ in [r for r in scored if r[2] == own][:positives]:
            fit = [(n, i) for n, i, label in scored if label != own and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, **options).collect())


def test_query_matches_sql(spark):
    name = "op12_bond_hard_negatives"
    problem, rows, _, _ = compare(spark, "/root/testdata/sf0.01", name, QUERIES[name], SQL[name])
    assert problem is None and rows > 0, problem


def test_small_blocks_ties_repeats_and_hot_label(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 64)
    monkeypatch.setattr(hardneg, "ANCHORS", 4)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0.4, 1, 12).tolist(), int(rng.integers(0, 3)) if i % 3 else 7) for i in range(600)]
    rows += [(1000 + i, [0.5, -0.25, 1.0, 0.25] * 3, i % 2) for i in range(120)]             # ties, equal vectors
    rows += rows[10:40]                                                                     # repeated rows, no anchors
    rows += [(2000 + i, rng.normal(1, 1, 5).tolist(), i % 2) for i in range(60)]             # another length
    assert mined(spark, rows) == brute(rows)


def test_scores_below_zero_and_few_partners(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [-1.0, 0.0], 1), (2, [0.5, 0.0], 1), (3, [0.3, 9.0], 2), (4, [-0.4, 0.0], 2), (50, [0.0, 0.0], 3)]
    assert mined(spark, rows) == brute(rows) and mined(spark, rows)


def test_wide_components_are_exact(spark):
    big = float(1 << 22)
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big * 0.9, 2.0], 2), (3, [big * 0.9, 2.01], 2), (4, [big * 0.6, 0.0], 2)]
    assert mined(spark, rows) == brute(rows) and len(mined(spark, rows)) == 3
    with pytest.raises(Exception, match="64-bit"):
        mined(spark, [(0, [1e12], 1), (1, [1e12], 1), (2, [0.9e12], 2)])


def test_rows_that_take_no_part_and_empty(spark):
    rows = [(None, [1.0], 1), (0, None, 1), (50, [None, 1.0], 1), (100, [float("nan"), 1.0], 1), (150, [float("inf"), 1.0], 1),
            (200, [], 1), (250, [1.0, 1.0], None), (1, [1.0, 1.0], 1), (2, [0.8, 0.8], 2)]
    assert mined(spark, rows) == []
    assert mined(spark, rows[:0]) == []
    df = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1), (2, [0.7], 2)], "vec_id long, embedding array<double>, label int")
    got = hardneg.hard_negatives(df.selectExpr("*", "1 AS dim", "'x' AS x", "2 AS slot", "3 AS chunk", "4 AS score")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 256 * 179)]


def test_bitmap_shrinks():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(0, 1, (4000, 32)) * np.geomspace(4, 0.01, 32))
    held = hardneg.Columns(np.arange(4000), x)
    got = held.scan(x[0], 0, [(None, None)], 5)[0]
    s = x @ x[0]
    order = [i for i in np.lexsort([np.arange(4000), -s]) if i != 0][:5]
    assert got == [(int(s[i]), i) for i in order] and held.read < 0.5 * x.size

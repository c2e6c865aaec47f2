import numpy as np
import pytest
from pyspark.sql import functions as F

from itemweld.operators import dual_cells as D
from itemweld.functions.vectors import similarity
from itemweld.plans import matching as M, reports
from test_neighbors import brute_pairs, catalogue, dist, frame

PERCENT = lambda d: F.floor(similarity(d) * 100)


def brute_counts(rows, radius):
    kind = {r[0]: r[1] for r in rows}
    out = {}
    for (a, _), d in brute_pairs(rows, radius).items():
        key = kind[a], int(1.0 / (1.0 + d) * 100)
        out[key] = out.get(key, 0) + 1
    return out


def counted(folded, size, stages, radius):
    got = D.count_pairs(folded, ["part_category", "material"], size, stages, radius, PERCENT)
    rows = got.rows.groupBy("part_category", "bin").agg(F.sum("pairs").alias("n")).collect()
    return {(r.part_category, r.bin): r.n for r in rows}, got.compared


@pytest.mark.parametrize("size", [1, 4, 14])
def test_counts_equal_brute_force(spark, stages, size):
    rows = catalogue(3, 300, size)
    got, _ = counted(M.fold(frame(spark, rows), stages), size, stages, 0.9)
    want = brute_counts(rows, 0.9)
    assert want and got == want


def test_counts_of_no_rows_and_of_null_blocks(spark, stages):
    rows = [("a", None, "m", [0.0]), ("b", None, "m", [0.0]), ("c", "k", None, [0.0])]
    assert counted(M.fold(frame(spark, rows), stages), 1, stages, 0.3)[0] == {}
    assert counted(M.fold(frame(spark, []), stages), 1, stages, 0.3)[0] == {}


def test_counting_a_dense_block_is_not_quadratic(spark, stages):
    def work(n):
        rng = np.random.default_rng(n)
        rows = [(f"p{i:05d}", "c", "m", [float(x) for x in np.round(rng.uniform(0, 0.03, 2), 6)]) for i in range(n)]
        counts, compared = counted(M.fold(frame(spark, rows), stages), 2, stages, 0.3)
        assert sum(counts.values()) == n * (n - 1) // 2     # every pair lies within the radius
        return compared
    small, large = work(1_000), work(4_000)
    assert large < 10 * small and large < 4_000 * 4_000 / 4


def cells_frame(spark, cells):
    rows = [(c, f"{c}{i:05d}", [float(x) for x in v]) for c, vs in cells.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "node string, rep string, feature_vector array<double>")


@pytest.mark.parametrize("size", [2, 13])
def test_linked_cells_equal_brute_force(spark, stages, size):
    rng = np.random.default_rng(size)
    cells = {f"c{i}": np.round(rng.normal(0, 0.7 / size ** 0.5, size) + rng.normal(0, 0.1 / size ** 0.5, (int(rng.integers(1, 60)), size)), 6)
             for i in range(14)}
    asked = [(a, b) for a in cells for b in cells if a < b]
    got = D.linked(cells_frame(spark, cells), spark.createDataFrame(asked + asked[:3] + [("c0", "none")], "a string, b string"), size, stages, 0.3)
    want = {(a, b) for a, b in asked if any(dist(list(u), list(v)) <= 0.3 for u in cells[a] for v in cells[b])}
    found = [(r.a, r.b) for r in got.rows.collect()]
    assert 0 < len(want) < len(asked) and len(found) == len(set(found)) and set(found) == want


@pytest.mark.parametrize("gap, answer", [(0.29, 1), (0.31, 0)])
def test_two_touching_dense_cells_cost_about_linear(spark, stages, gap, answer):
    def work(n):
        rng = np.random.default_rng(n)
        one = np.round(rng.uniform(0, 0.3, (n, 2)), 6)
        two = np.round(rng.uniform(0, 0.3, (n, 2)), 6) + [0.3 + gap, 0.0]
        one[0], two[0] = (0.3, 0.15), (0.3 + gap, 0.15)
        got = D.linked(cells_frame(spark, {"a": one, "b": two}), spark.createDataFrame([("a", "b")], "a string, b string"), 2, stages, 0.3)
        assert got.rows.count() == answer
        return got.compared
    small, large = work(4_000), work(16_000)
    assert large < 6 * small + 100 and large < 16_000


@pytest.mark.parametrize("work", [0, 40, 2_000])
def test_histogram_counts_sparse_blocks_where_vectors_meet(spark, stages, monkeypatch, work):
    rng = np.random.default_rng(5)
    sparse = [(f"s{i:04d}", "c", "m", [float(x) for x in np.round(rng.normal(0, 1, 3), 6)]) for i in range(600)]
    dense = [(f"d{i:04d}", "c", "n", [float(x) for x in np.round(rng.uniform(0, 0.05, 3), 6)]) for i in range(200)]
    rows = sparse + dense + [("t1", *sparse[0][1:]), ("t2", *sparse[0][1:]), ("u1", None, "m", [0.0] * 3), ("u2", None, "m", [0.0] * 3)]
    asked, real = [], reports.count_pairs

    def count(folded, *rest):
        asked.extend(r.material for r in folded.select("material").distinct().collect())
        return real(folded, *rest)

    monkeypatch.setattr(reports, "count_pairs", count)
    got = reports.similarity_histogram(M.fold(frame(spark, rows), stages), 3, stages, 0.3, work).collect()
    assert {(r.part_category, r.percent): r.pairs for r in got} == brute_counts([r for r in rows if r[1]], 0.3)     # no category, no pair
    assert sorted(asked) == {0: ["m", "n"], 40: ["n"], 2_000: []}[work]

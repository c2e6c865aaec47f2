import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemweld import registry
from itemweld.operators import crowds as K, economics as E, features as FT, neighbors as N
from itemweld.plans import matching as M

RADIUS = 0.3


def catalogue(seed=1, n=400, size=4):
    """Spread points, near copies, exact copies and two blocks."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 5 == 0:
            v = rng.normal(0, 0.05, size)
        elif i % 7 == 0:
            v = np.full(size, 2.0)
        else:
            v = rng.normal(0, 1.0, size)
        rows.append((f"p{i:04d}", "c" if i % 2 else "d", "m" if i % 3 else "x", [round(float(x), 6) + 0.0 for x in v]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "part_id string, part_category string, material string, feature_vector array<double>")


def dist(u, v):
    total = 0.0
    for x, y in zip(u, v):
        total = total + (x - y) * (x - y)
    return total ** 0.5


def brute_pairs(rows, radius):
    out = {}
    for p, c, m, u in rows:
        for q, d, n, v in rows:
            if p < q and (c, m) == (d, n) and dist(u, v) <= radius:
                out[p, q] = dist(u, v)
    return out


def listed(df):
    got = {(r.a, r.b): r.dist for r in df.collect()}
    assert len(got) == df.count()       # no pair twice
    return got


@pytest.mark.parametrize("crowded", [4_000, 3])
def test_exact_pairs_equal_brute_force(spark, stages, crowded):
    rows = catalogue()
    points = frame(spark, rows)
    folded = M.fold(points, stages)
    pairs = N.folded_pairs_exact(folded, 4, stages, RADIUS, crowded=crowded)
    got = listed(N.unfold_pairs(stages.save(pairs, "pairs"), N.copies_of(points, folded), stages, crowded))
    want = brute_pairs(rows, RADIUS)
    assert got == pytest.approx(want)
    assert N.counted_pairs(pairs, folded).agg(F.sum("pairs")).first()[0] == len(want)


def test_pair_at_the_radius_is_kept(spark, stages):
    rows = [("a", "c", "m", [0.0]), ("b", "c", "m", [0.3]), ("d", "c", "m", [-0.3]), ("e", "c", "m", [0.6000001])]
    folded = M.fold(frame(spark, rows), stages)
    got = N.folded_pairs_exact(folded, 1, stages, RADIUS).collect()
    assert {(r.a, r.b) for r in got} == {("a", "b"), ("a", "d")}


def test_grid_and_lsh_find_subsets(spark, stages):
    rows = catalogue()
    points = frame(spark, rows)
    folded = M.fold(points, stages)
    exact = {(r.a, r.b) for r in N.folded_pairs_exact(folded, 4, stages, RADIUS).collect()}
    for method in (N.folded_pairs_grid, N.folded_pairs_lsh):
        found = [(r.a, r.b) for r in method(folded, 4, stages, RADIUS).collect()]
        assert found and len(found) == len(set(found)) and set(found) <= exact


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_brute_force(spark, stages, k):
    rows = catalogue(n=160)
    points = frame(spark, rows)
    got = {(r.part_id, r["rank"]): (r.neighbor_id, r.dist) for r in N.nearest(points, points, k, 4, stages, crowded=5).collect()}
    want = {}
    for p, c, m, u in rows:
        near = sorted((dist(u, v), q) for q, d, n, v in rows if q != p and (c, m) == (d, n))
        for i, (x, q) in enumerate(near[:k]):
            want[p, i + 1] = (q, x)
    assert set(got) == set(want)
    assert all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1]) for x in want)


def test_nearest_returns_short_lists_in_small_blocks(spark, stages):
    rows = [("a", "c", "m", [0.0]), ("b", "c", "m", [50.0]), ("z", "c", "other", [0.0])]
    points = frame(spark, rows)
    got = sorted((r.part_id, r.neighbor_id) for r in N.nearest(points, points, 3, 1, stages).collect())
    assert got == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_crowd_path_gives_the_same_groups_and_similarities(spark, stages, seed):
    points = frame(spark, catalogue(seed, 500, 3))
    folded = M.fold(points, stages)
    pairs = M.find_pairs(folded, 3, stages, RADIUS)
    plain = M.label_parts(points, folded, pairs, 3, stages, RADIUS)
    crowd = M.label_parts(points, folded, None, 3, stages, RADIUS)
    assert plain.count() > 0
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, crowd.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_method_gives_the_same_groups_without_listing_pairs(spark, stages, seed):
    points = frame(spark, catalogue(seed, 500, 3))
    folded = M.fold(points, stages)
    plain = M.label_parts(points, folded, M.find_pairs(folded, 3, stages, 0.25, "grid"), 3, stages, 0.25, "grid")
    crowd = M.label_parts(points, folded, None, 3, stages, 0.25, "grid")
    assert plain.count() > 0
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, crowd.collect()))
    assert K.grid_is_crowded(folded, 3, work=0.5) and not K.grid_is_crowded(folded, 3)


@pytest.mark.parametrize("crowded", [4_000, 3])
def test_faster_partners_equal_brute_force(spark, stages, crowded):
    rows = catalogue(4, 300, 3)
    points = frame(spark, rows)
    folded = M.fold(points, stages)
    rank = {r[0]: (None if i % 11 == 0 else (i * 7) % 5) for i, r in enumerate(rows)}
    kinds = spark.createDataFrame([(p, rank[p], (i // 4) % 2) for i, p in enumerate(sorted(rank))], "part_id string, rank int, kind int")
    parts = N.copies_of(points, folded).select("part_id", "rep").join(kinds, "part_id")
    kind = {p: (i // 4) % 2 for i, p in enumerate(sorted(rank))}
    got = N.faster_partners(folded, parts.where("kind = 1").drop("kind"), parts.where("kind = 0").drop("kind"), 3, stages, RADIUS, crowded)
    pairs = brute_pairs(rows, RADIUS)
    want = sorted((x, y, rank[x], rank[y]) for a, b in pairs for x, y in ((a, b), (b, a))
                  if kind[x] == 0 and kind[y] == 1 and None not in (rank[x], rank[y]) and rank[y] < rank[x])
    assert want and sorted((r.x, r.y, r.x_rank, r.y_rank) for r in got.collect()) == want
    assert all(r.dist == pytest.approx(pairs[min(r.x, r.y), max(r.x, r.y)]) for r in got.collect())


def test_member_links_join_cells_whose_hubs_are_apart(spark, stages):
    """Two micro-cells connected only by members near their border."""
    rows = ([(f"a{i}", "c", "m", [round(0.01 * i, 6)]) for i in range(1, 29)]
            + [(f"b{i}", "c", "m", [round(0.55 + 0.01 * i, 6)]) for i in range(1, 29)])
    folded = M.fold(frame(spark, rows), stages)
    comps = {r.id: r.comp for r in K.crowd_components(folded, 1, stages, 0.3).collect()}
    assert len(comps) == 56 and set(comps.values()) == {"a1"}


def test_hot_group_of_copies_adds_no_pairs(spark, stages):
    rows = [(f"p{i:05d}", "c", "m", [1.0, 2.0]) for i in range(3000)] + [("q", "c", "m", [1.0, 2.1]), ("r", "c", "m", [9.0, 9.0])]
    points = frame(spark, rows)
    folded = M.fold(points, stages)
    assert folded.count() == 3
    pairs = M.find_pairs(folded, 2, stages, RADIUS)
    assert pairs.count() == 1
    labels = M.label_parts(points, folded, pairs, 2, stages, RADIUS)
    assert labels.count() == 3001 and labels.select("comp").distinct().count() == 1
    assert labels.where("similarity = 1.0").count() == 3000


@pytest.mark.parametrize("length", [5, 21])
def test_compacting_keeps_distances(spark, stages, length):
    names = [f"f{i}" for i in range(length)]
    rng = np.random.default_rng(3)
    rows = [(f"p{i}", "c" if i % 2 else "d", "m",
             *[float(rng.normal()) if (j + i % 2) % 3 or length > 5 else 7.0 for j in range(length)]) for i in range(60)]
    parts = spark.createDataFrame(rows, "part_id string, part_category string, material string, "
                                  + ", ".join(f"{n} double" for n in names))
    stats = stages.save(FT.feature_stats(parts, names), "stats")
    vectors = stages.save(FT.feature_vectors(parts, stats, names), "vectors")
    points, size = FT.compact(vectors, stats, names)
    assert size <= length
    whole = brute_pairs([tuple(r) for r in vectors.collect()], 4.0)
    small = brute_pairs([tuple(r) for r in points.collect()], 4.0)
    assert whole == small
    folded = M.fold(points, stages)
    assert listed(N.folded_pairs_exact(folded, size, stages, 4.0)) == pytest.approx(small)


def test_vector_rules(spark, stages):
    """NULL, constant and absent features are 0; statistics use base parts only."""
    parts = spark.createDataFrame(
        [("a", "c", "m", 1.0, 5.0, None), ("b", "c", "m", 3.0, 5.0, None), ("e", "c", "m", None, 5.0, None),
         ("a-D", "c", "m", 100.0, 6.0, 1.0), ("z-D", "new", "m", 1.0, 1.0, 1.0)],
        "part_id string, part_category string, material string, x double, y double, w double")
    stats = FT.feature_stats(parts, ["x", "y", "w"])
    assert {(r.feature, r["mean"], r["std"]) for r in stats.collect()} == {("x", 2.0, 1.0), ("y", 5.0, 0.0)}
    got = {r.part_id: list(r.feature_vector) for r in FT.feature_vectors(parts, stats, ["x", "y", "w"]).collect()}
    assert got == {"a": [-1.0, 0.0, 0.0], "b": [1.0, 0.0, 0.0], "e": [0.0, 0.0, 0.0],
                   "a-D": [98.0, 0.0, 0.0], "z-D": [0.0, 0.0, 0.0]}


def test_no_cartesian_product_in_the_plan(spark, stages):
    folded = M.fold(frame(spark, catalogue()), stages)
    plan = N.folded_pairs_exact(folded, 4, stages, RADIUS)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearest_work_is_linear_in_a_dense_cluster(spark, stages, monkeypatch):
    """Rows leaving the cell join, for one narrow cluster with some points far from it."""
    rng = random.Random(3)
    left = []
    inner = N.meet

    def counted(*args, **kw):
        out = stages.save(inner(*args, **kw), "met")
        left.append(out.count())
        return out

    monkeypatch.setattr(N, "meet", counted)

    def work(n):
        left.clear()
        rows = [(f"p{i}", "A", "m", [rng.random() * 0.001 for _ in range(3)]) for i in range(n)]
        rows += [(f"q{i}", "A", "m", [rng.random() * 50 for _ in range(3)]) for i in range(100)]
        df = stages.save(spark.createDataFrame(rows, "part_id string, part_category string, material string, feature_vector array<double>"), "points")
        found = N.nearest(df.where("part_id LIKE 'p%'"), df, 3, 3, stages).collect()
        assert len(found) == 3 * n
        some = [r for r in rows[:5]]
        for p in some:
            want = sorted((sum((a - b) ** 2 for a, b in zip(p[3], q[3])) ** 0.5, q[0]) for q in rows if q[0] != p[0])[:3]
            assert [r.neighbor_id for r in sorted((r for r in found if r.part_id == p[0]), key=lambda r: r["rank"])] == [q for _, q in want]
        return sum(left)

    small, large = work(1500), work(6000)
    assert large < 8 * small and large < 6000 * 400


def test_percentiles_name_every_pair_of_parts(spark, stages):
    rows = catalogue()
    points = frame(spark, rows)
    folded = M.fold(points, stages)
    pairs = stages.save(N.folded_pairs_exact(folded, 4, stages, RADIUS), "pairs")
    ws = SimpleNamespace(stages=stages, folded=folded, wide_folded_pairs=pairs, copies=N.copies_of(points, folded))
    want = brute_pairs(rows, RADIUS)
    kind = {r[0]: r[1] for r in rows}
    got = {}
    for r in registry.similarity_percentile(ws).collect():
        assert (r.a, r.b) not in got
        got[r.a, r.b] = r.sim_pct
    assert set(got) == set(want)
    for pair, pct in got.items():
        others = [d for p, d in want.items() if kind[p[0]] == kind[pair[0]]]
        assert pct == pytest.approx(sum(d > want[pair] + 1e-12 for d in others) / max(len(others) - 1, 1))


def test_buckets_do_not_compare_all_their_rows(spark, stages, monkeypatch):
    """A slab through a wide block holds a share of all rows; few of them are near each other."""
    rng = random.Random(5)
    met = []
    inner = N.meet

    def counted(left, right, keys, right_id, condition, *rest, **kw):
        met.append(inner(left, right, keys, right_id, F.lit(True), *rest, **kw).count())
        return inner(left, right, keys, right_id, condition, *rest, **kw)

    monkeypatch.setattr(N, "meet", counted)
    rows = [(f"p{i}", "A", "m", [rng.random() * 6 for _ in range(3)]) for i in range(3000)]
    folded = M.fold(frame(spark, rows), stages)
    got = {(r.a, r.b) for r in N.folded_pairs_lsh(folded, 3, stages, RADIUS).collect()}
    assert sum(met) < 30 * len(rows)
    width = N.lsh_width(RADIUS, 3)
    hashes = {r[0]: [sum(N.lsh_coefficient(t, i) * round(z * 1e6) for i, z in enumerate(r[3])) // width for t in range(N.LSH_TABLES)] for r in rows}
    assert got == {p for p in brute_pairs(rows, RADIUS) if any(x == y for x, y in zip(hashes[p[0]], hashes[p[1]]))}


def test_vectors_are_sorted_by_a_number_first(spark, stages):
    points = frame(spark, catalogue())
    folded = M.fold(points, stages)
    for df in (N.fold_copies(points), N.copies_of(points, folded)):
        assert "xxhash64(part_category" in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r.part_id: r.rep for r in N.copies_of(points, folded).collect()} == {
        p[0]: min(q[0] for q in catalogue() if q[1:] == p[1:]) for p in catalogue()}


def test_cheapest_offers_sort_by_part_first(spark):
    offers = spark.createDataFrame([("s1", "p1", 2.0, 0.0, 7, "USD", "A"), ("s1", "p1", 1.0, 0.0, 7, "USD", "B"), ("s1", "p2", 3.0, 0.0, 7, "USD", "A")],
                                   "supplier_id string, part_id string, price_per_unit double, unit_discount double, lead_time_days int, currency string, material_quality_grade string")
    best = E.best_offers(offers)
    assert "SortAggregate(key=[part_id" in best._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.supplier_id, r.part_id, r.net_price) for r in best.collect()) == [("s1", "p1", 1.0), ("s1", "p2", 3.0)]

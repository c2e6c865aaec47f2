import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemweld.operators import neighbors as N
from itemweld.operators.neighbor_index import NeighborIndex
from test_neighbors import catalogue, frame


def dist(u, v):
    total = 0.0
    for x, y in zip(u, v):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def brute(probes, rows, k):
    out = set()
    for p, c, m, u in probes:
        found = sorted((dist(u, v), q) for q, d, n, v in rows if q != p and (c, m) == (d, n))
        out |= {(p, q, d, r + 1) for r, (d, q) in enumerate(found[:k])}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("part_id", "neighbor_id", "dist", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_search_equals_brute_force_and_filters(spark, stages):
    rows = catalogue(n=300) + [("lone", "q", "x", [0.0] * 4), ("nought", None, "x", [0.0] * 4)]
    index = NeighborIndex(spark, stages.path("index"), rows_per_file=25)
    index.build(frame(spark, rows))
    outside = [("new1", "c", "m", [0.1, 0.2, 0.0, 0.0]), ("new2", "d", "x", [9.0, 9.0, 9.0, 9.0]), ("new3", "nowhere", "x", [0.0] * 4)]
    probes = rows[::7] + outside
    known = [r for r in rows if r[1] is not None]
    want = brute([p for p in probes if p[1] is not None], known, 4)
    assert got(index.similar(frame(spark, probes), 4, 4, stages)) == want
    flat = [(p, c, m, [0.0, 0.0, v[2], 0.0]) for p, c, m, v in rows]      # a build that ended before its manifest
    N.plan_bands(frame(spark, flat), 0.25).write.parquet(f"{index.root}/bands/version=2")
    narrow = index.similar(frame(spark, probes), 4, 4, stages, part_category="c", material="m")
    assert got(narrow) == {w for w in want if next(p for p in probes if p[0] == w[0])[1:3] == ("c", "m")}
    assert got(index.similar(frame(spark, rows[:0] or [("z", "none", "x", [0.0] * 4)]), 4, 4, stages)) == set()


def test_few_probes_read_few_files(spark, stages):
    rng = np.random.default_rng(3)
    rows = [(f"p{i:05d}", "c", "m", np.round(rng.uniform(-10, 10, 3), 6).tolist()) for i in range(20_000)]
    index = NeighborIndex(spark, stages.path("index"), rows_per_file=100)
    index.build(frame(spark, rows))
    every = index.manifest().select("file").distinct().count()
    found = got(index.similar(frame(spark, rows[:2]), 3, 3, stages))
    assert found == brute(rows[:2], rows, 3)
    assert every >= 150 and 0 < len(index.read_files) <= every / 8


def test_refresh_rewrites_only_touched_files(spark, stages):
    rows = catalogue(n=300)
    index = NeighborIndex(spark, stages.path("index"), rows_per_file=20)
    index.build(frame(spark, rows))
    before = {r.file for r in index.manifest().select("file").distinct().collect()}
    moved = (rows[3][0], rows[4][1], rows[4][2], [0.5, 0.5, 0.5, 0.5])
    added = ("zz", "fresh", "m", [1.0, 2.0, 3.0, 4.0])
    changes = [(*moved, "update"), (*rows[10], "delete"), (*added, "insert"), ("gone", "c", "m", [0.0] * 4, "delete")]
    did = index.refresh(spark.createDataFrame(changes, "part_id string, part_category string, material string, feature_vector array<double>, op string"))
    after = {r.file for r in index.manifest().select("file").distinct().collect()}
    assert did["replaced"] <= 2 and len(before - after) == did["replaced"] and len(after - before) == did["written"]
    now = [r for r in rows if r[0] not in (rows[3][0], rows[10][0])] + [moved, added]
    assert got(index.similar(frame(spark, now), 3, 4, stages)) == brute(now, now, 3)
    index.refresh(frame(spark, rows[:1]).withColumn("op", F.lit("x")).limit(0))          # nothing changed
    assert {r.file for r in index.manifest().select("file").distinct().collect()} == after


def test_copies_fill_many_files_and_empty_tables(spark, stages):
    rows = [(f"p{i:03d}", "c", "m", [1.0, 2.0]) for i in range(200)] + [("a", "c", "m", [1.5, 2.0])]
    index = NeighborIndex(spark, stages.path("index"), rows_per_file=20)
    index.build(frame(spark, rows))
    assert index.manifest().agg(F.max("rows")).first()[0] < 100
    assert got(index.similar(frame(spark, rows), 3, 2, stages)) == brute(rows, rows, 3)
    index.build(frame(spark, rows).limit(0))
    assert got(index.similar(frame(spark, rows), 3, 2, stages)) == set()
    with pytest.raises(ValueError):
        NeighborIndex(spark, stages.path("none")).manifest()


def test_nearest_cells_use_all_five_dimensions(spark, stages, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(f"p{i:03d}", "c", "m", np.round(rng.uniform(-1, 1, 5), 6).tolist()) for i in range(300)]
    dims, home_cells = [], N.home_cells

    def seen(df, bands, *more):
        dims.append(max(len(r.bands) for r in bands.collect()))
        return home_cells(df, bands, *more)

    monkeypatch.setattr(N, "home_cells", seen)
    probes = rows[::3]
    assert got(N.nearest(frame(spark, probes), frame(spark, rows), 4, 5, stages)) == brute(probes, rows, 4)
    assert set(dims) == {5}

import glob
import os
from collections import Counter

import numpy as np
import pytest

from itemweld.llm import nndescent
from itemweld.llm.queries import QUERIES
from itemweld.sources.staging import Stages


def brute(rows):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) for _, v in rows]
    x = [np.array(v, float) / np.linalg.norm(v) if o else None for (_, v), o in zip(rows, ok)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= 0.95]
            for i in range(len(rows))]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp[i] = min(ids[j] for j in seen)
    return {ids[i]: (len(near[i]), comp[i]) for i in range(len(rows))}


def check(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, u int")
    got = nndescent.near_links(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_clusters_chains_and_invalid(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 1, 16).tolist()) for i in range(200)]
    for c in range(3):                                    # dense groups, one with borderline angles
        base = rng.normal(0, 1, 16)
        rows += [(1000 + 200 * c + i, (base + rng.normal(0, (0.05, 0.15, 0.22)[c], 16)).tolist()) for i in range(120)]
    base = rows[0][1]
    rows += [(3000 + i, [4.0 * x for x in base]) for i in range(5)]      # parallel copies
    turn = np.deg2rad(12)
    rows += [(4000 + i, [float(np.cos(i * turn)), float(np.sin(i * turn))]) for i in range(15)]      # a chain, other length
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (5004, []), (5005, [float("inf")] * 16)]
    check(spark, rows)


def test_saturated_lists_are_enlarged(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "HALF", 1e-9)          # no bundles: one full list hides the others
    monkeypatch.setattr(nndescent, "K", 3)
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, 12)
    check(spark, [(i, (base + rng.normal(0, 0.03, 12)).tolist()) for i in range(40)] + [(100 + i, rng.normal(0, 1, 12).tolist()) for i in range(60)])


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (9, [2.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in nndescent.near_links(df).collect())
    assert got == [(-1, 3, None, True), (2, 3, 2, True), (2, 3, 2, True), (9, 3, 2, False)]
    assert nndescent.near_links(df.limit(0)).collect() == []


def test_recall_over_planted_copies(spark):
    import duckdb
    rows = duckdb.sql("SELECT vec_id, embedding FROM '/root/testdata/sf0.01/embeddings.parquet'").fetchall()
    rng = np.random.default_rng(8)
    rows += [(10_000 + i, (np.array(v) + rng.normal(0, 0.02, 64)).tolist()) for i, (_, v) in enumerate(rows[:250])]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    got, want = {r.vec_id: r.n_links for r in nndescent.near_links(df).collect()}, brute(rows)
    true = sum(n for n, _ in want.values())
    assert true >= 400 and all(got[i] <= n for i, (n, _) in want.items())
    assert sum(got.values()) >= 0.95 * true


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query_whole_table(spark, folder):
    got = QUERIES["op2_nndescent_neardup"](spark, folder).collect()
    assert len(got) == 500 and all(r.n_links == 0 and r.kept for r in got)


def test_what_the_graph_search_misses_is_compared_whole(spark, monkeypatch):
    for name, value in {"PASSES": 1, "ROUNDS": 1, "TABLES": 1, "K": 1, "BLOCK": 32, "AUDIT": (8, 16)}.items():
        monkeypatch.setattr(nndescent, name, value)
    rng = np.random.default_rng(5)
    flat = rng.normal(0, 1, (40, 12))
    turned = [(100 + i, (v + rng.normal(0, 0.2, 12)).tolist()) for i, v in enumerate(flat)]      # few links, mostly outside bundles
    rows = [(i, v.tolist()) for i, v in enumerate(flat)] + turned
    assert sum(n for n, _ in brute(rows).values()) >= 40
    check(spark, rows)


def clusters(n=60, seed=6):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 1, 12).tolist()) for i in range(n)]
    for c in range(2):
        base = rng.normal(0, 1, 12)
        rows += [(100 + 50 * c + i, (base + rng.normal(0, (0.03, 0.12)[c], 12)).tolist()) for i in range(25)]
    return rows


def test_vectors_move_in_slices(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "SLICE", 1)
    made = []
    monkeypatch.setattr(nndescent, "slices_for", lambda *sizes, real=nndescent.slices_for: made.append(real(*sizes)) or made[-1])
    for name, value in {"PASSES": 1, "ROUNDS": 2, "K": 3}.items():
        monkeypatch.setattr(nndescent, name, value)
    check(spark, clusters())
    assert max(made) > 2


def test_tables_and_shuffle_files_go_once_nothing_reads_them(spark):
    def shuffled():
        return {str(b) for b in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
            spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()) if "shuffle_" in str(b)}

    made = []

    class Kept(Stages):
        def save(self, df, name, **options):
            before = shuffled()
            out = super().save(df, name, **options)
            made.append((name, len(shuffled() - before)))
            return out

    kept = Kept(spark, "lean", lean=True)
    df = spark.createDataFrame(clusters(), "vec_id long, embedding array<float>")
    assert nndescent.near_links(df, stages=kept).count() == 110
    left = Counter(os.path.basename(p).rsplit("-", 1)[0] for p in glob.glob(f"{kept.folder}/*"))
    assert {"graph", "joined", "seeds"} <= {n for n, _ in made} and sum(n for _, n in made) == 0
    assert not {"given", "points", "bundles", "heads", "placed", "packed", "graph", "joined", "seeds"} & set(left)


def test_whole_comparison_finds_every_pair(spark, stages):
    rng = np.random.default_rng(3)
    u = rng.normal(0, 1, (300, 8)).astype("<f4")
    rows = [(i, v.tobytes(), float(r), 1) for i, (v, r) in enumerate(zip(u, rng.choice([0.0, 0.1], 300)))]
    leaders = stages.save(spark.createDataFrame(rows, "node long, u binary, r double, weight long").repartition(5), "leaders")
    got = {(r.a, r.b) for r in nndescent.whole_edges(leaders, "<f4", stages).collect()}
    x = u.astype(float) / np.linalg.norm(u.astype(float), axis=1)[:, None]
    gap = np.arccos(np.clip(x @ x.T, -1, 1)) - np.add.outer([r[2] for r in rows], [r[2] for r in rows])
    np.fill_diagonal(gap, 9)
    want = set(zip(*(k.tolist() for k in np.nonzero(gap <= nndescent.THETA + nndescent.SLACK))))
    assert len(want) >= 10 and want <= got and all(gap[e] <= nndescent.THETA + 1e-5 for e in got)

import hashlib
import random

import pytest

from itemweld.operators import components as C


def comps(spark, stages, edges):
    df = spark.createDataFrame(edges, "a string, b string")
    out = C.connected_components(df, stages).collect()
    assert len(out) == len({r.id for r in out})
    return {r.id: r.comp for r in out}


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def digest(*members):
    """The group id's definition, by hand."""
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in members]
    sums = [sum(int(h[15 * i:15 * i + 15], 16) for h in hashes) for i in range(4)]
    return hashlib.sha256("|".join(map(str, [len(members), *sums])).encode()).hexdigest()


def test_long_path_is_one_component(spark, stages):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    random.Random(4).shuffle(edges)
    got = comps(spark, stages, edges)
    assert len(got) == 121 and set(got.values()) == {"n000"}


def test_star_cliques_and_loops(spark, stages):
    edges = [("hub", f"s{i}") for i in range(50)]
    edges += [(f"x{i}", f"x{j}") for i in range(6) for j in range(6) if i != j]
    edges += [("y1", "y2"), ("y2", "y3"), ("y3", "y1"), ("y1", "y2")]
    assert comps(spark, stages, edges) == brute(edges)


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, stages, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)]
    edges = [e for e in edges if e[0] != e[1]]
    assert comps(spark, stages, edges) == brute(edges)


def test_too_few_rounds_raise(spark, stages):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(200)], "a string, b string")
    with pytest.raises(RuntimeError):
        C.connected_components(edges, stages, max_rounds=1)


def test_group_id_depends_on_members_only(spark, stages):
    rows = [("b", "x"), ("a", "x"), ("d", "y"), ("c", "y"), ("e", "y"), ("lonely", "z")]
    one = C.group_ids(spark.createDataFrame(rows, "part_id string, comp string"), stages).collect()
    two = C.group_ids(spark.createDataFrame(rows[::-1], "part_id string, comp string").repartition(5), stages).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    assert {r.comp: r.group_id for r in one} == {"x": digest("a", "b"), "y": digest("c", "d", "e")}


def test_groups_of_every_size_have_one_formula(spark, stages):
    rows = [(f"p{i}", "big") for i in range(500)] + [("a", "small"), ("b", "small")]
    df = spark.createDataFrame(rows, "part_id string, comp string")
    one = {r.comp: (r.group_id, r.member_count) for r in C.group_ids(df, stages).collect()}
    two = {r.comp: (r.group_id, r.member_count) for r in C.group_ids(df.repartition(7), stages).collect()}
    less = {r.comp: r.group_id for r in C.group_ids(df.where("part_id <> 'p7'"), stages).collect()}
    assert one == two and one["big"] == (digest(*[f"p{i}" for i in range(500)]), 500)
    assert less["big"] != one["big"][0] and less["small"] == one["small"][0]

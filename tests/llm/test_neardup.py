import itertools
import random

import numpy as np

from itemweld.llm import neardup
from itemweld.llm.queries import QUERIES


def shingles(text):
    words = [] if text is None else text.encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """(doc_id, text) -> doc_id -> (set size, component): every pair compared."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    pairs = {p for docs in where.values() for p in itertools.combinations(docs, 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = QUERIES["op5_hyperminhash_neardup"](spark, "/root/testdata/sf0.01").collect()
    want = brute(docs)
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_group_of_near_copies_chain_and_edges(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(200):                                 # near copies of one text, many pairs below 0.75
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(130)]                # each is near the next only
    rows += [(1000 + i, " ".join(chain[8 * i:8 * i + 60])) for i in range(9)]
    small = ["a b c d e f g", "A\tb  c d e f g", "a b c d", "a b c d", "a b c", "a", "", None, "   ", "É a b c d", "é a b c d",
             "a b c d e f g h", "word " * 200_000]
    rows += [(2000 + i, t) for i, t in enumerate(small)]
    df = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id long, text string, key binary, rep long")
    got = neardup.near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_nulls_repeats_and_empty_table(spark):
    schema = "doc_id long, text string"
    got = neardup.near_duplicates(spark.createDataFrame(
        [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A B C D E F"), (None, None)], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [
        (-1, -1, True), (-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    assert neardup.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_estimate_is_near_the_true_similarity():
    rng, cache = random.Random(1), neardup.WordHash()
    errors = []
    for _ in range(60):
        words = [f"v{rng.randrange(10**7)}" for _ in range(900)]
        cut = rng.randrange(0, 800)
        a, b = (" ".join(w).encode() for w in (words[:850], words[cut:]))
        (u, v) = neardup.shingle_sets([a, b], cache)
        true = len(np.intersect1d(u, v)) / len(np.union1d(u, v))
        e = neardup.collision_rate(np.array([len(u)]), np.array([len(v)]))[0]
        same = (neardup.registers(u) == neardup.registers(v)).mean()
        errors.append((same - e) / (1 - e) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06

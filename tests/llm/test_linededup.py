import random
import time

import numpy as np
import xxhash

from itemweld.llm import linededup
from itemweld.llm.queries import QUERIES
from itemweld.sources.staging import Stages


def brute(docs, percent=85):
    """(id, text) -> id -> numbers of the lines that have an earlier similar one: every pair compared."""
    lines = []
    for d, t in sorted(docs, key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            words = frozenset(line.encode().lower().split())
            if words:
                lines.append((d, i, words))
    gone = {d: [] for d, _ in docs}
    seen, by_word = [], {}
    for d, i, w in lines:
        near = {j for x in w for j in by_word.get(x, ())}
        if any(100 * len(w & seen[j]) >= percent * len(w | seen[j]) for j in near):
            gone[d].append(i)
        for x in w:
            by_word.setdefault(x, []).append(len(seen))
        seen.append(w)
    return gone


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = QUERIES["op8_line_dedup"](spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.removed for r in got} == brute(docs)
    assert all(r.n_removed == len(r.removed) for r in got) and len(got) == len(docs)


def test_near_lines_hot_line_and_edges(spark):
    rng = random.Random(7)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(8, 40))] for _ in range(30)]
    docs = []
    for d in range(250):
        lines = ["one very common line that every document of this table holds once"]
        for _ in range(rng.randrange(4)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
            rng.shuffle(w)
            lines.append(" ".join(w))
        docs.append((d, "\n".join(lines)))
    docs += [(900, None), (901, ""), (902, "short line"), (903, "short line"), (904, "\n\n"), (905, "a b c d e f g h i j " * 30_000)]
    df = spark.createDataFrame([(d, t, 1, b"z", "k") for d, t in docs], "doc_id long, text string, row int, words binary, key string")
    want = brute(docs)
    got = {r.row: r.removed for r in linededup.removed_lines(df).collect()}
    names = {r.row: r.doc_id for r in linededup.named(df, "doc_id", "text").collect()}
    assert {names[k]: v for k, v in got.items()} == {k: v for k, v in want.items() if v}
    clean = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    for d, t in docs:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d])
        if want[d] and not left.strip():
            assert d not in clean
        else:
            assert clean[d] == left
    assert linededup.dedup_lines(df).columns == df.columns


def test_repeats_nulls_and_empty_table(spark):
    line = "the very same line of more than eight different words"
    df = spark.createDataFrame([(4, line), (4, line), (5, line + "\nother"), (None, "x\n" + line)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text) for r in linededup.dedup_lines(df).collect())
    assert got == [(-1, "x\n" + line), (5, "other")]        # the null id comes first, so every other copy goes
    assert linededup.dedup_lines(df.limit(0)).collect() == []


def test_short_lines_small_vocabularies_and_single_words(spark):
    rng = random.Random(3)
    script = "一行没有空格的文字"
    docs = [(1, "Yes.\n\nshort line\n" + script), (2, "short line\nline short\nyes."), (3, "a b c d e\n" + script),
            (4, "a b c d e\na b c d e f"), (5, "f e d c b a g"), (6, "a b c d e x"), (7, "no yes " * 640), (8, "yes no " * 640),
            (9, "\n \nyes.\n"), (10, "\n\n")]
    docs += [(20 + d, "\n".join(" ".join(rng.choice("pqrstuvwxy") for _ in range(rng.randrange(1, 12))) for _ in range(6))) for d in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert want[2] == [0, 1, 2] and want[3] == [1] and want[5] == [0] and want[6] == [] and want[8] == [0]
    names = {r.row: r.doc_id for r in linededup.named(df, "doc_id", "text").collect()}
    assert {names[r.row]: r.removed for r in linededup.removed_lines(df).collect()} == {k: v for k, v in want.items() if v}
    clean = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    left = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]) for d, t in docs}
    assert clean == {d: t for d, t in left.items() if t.strip() or not want[d]}


def test_query_covers_every_line_that_is_not_blank(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r.removed for r in QUERIES["op8_line_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(docs)


def test_texts_are_not_shuffled_and_full_marks_change_nothing(spark, monkeypatch):
    plans, save, broadcast = {}, Stages.save, "spark.sql.autoBroadcastJoinThreshold"

    def seen(self, df, name, **options):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name, **options)

    monkeypatch.setattr(Stages, "save", seen)
    monkeypatch.setattr(linededup, "MARKS", 64, raising=False)        # marks let nearly all lines through
    rng = random.Random(5)
    base = [[f"w{rng.randrange(90)}" for _ in range(12)] for _ in range(20)]
    docs = [(d, "\n".join(" ".join(rng.choice(base)[:11] + [f"y{rng.randrange(9)}"]) for _ in range(5))) for d in range(60)]
    old = spark.conf.get(broadcast)
    spark.conf.set(broadcast, "-1")
    try:
        df = spark.createDataFrame(docs + docs[:9], "doc_id long, text string")
        names = {r.row: r.doc_id for r in linededup.named(df, "doc_id", "text").collect()}
        got = {names[r.row]: r.removed for r in linededup.removed_lines(df).collect()}
    finally:
        spark.conf.set(broadcast, old)
    assert got == {k: v for k, v in brute(docs).items() if v}
    assert plans["sets"] and all("hashpartitioning(row" not in p and "hashpartitioning(key" in p for p in plans["sets"])


def plain_sets(texts):
    """(text number, line number, set of words) of lines that aren't blank, word by word."""
    lines = ((d, i, set(line.split())) for d, t in enumerate(texts) if t for i, line in enumerate(t.lower().split(b"\n")))
    return [(d, i, words) for d, i, words in lines if words]


def test_sets_of_words_equal_plain_python():
    rng = random.Random(11)
    odd = b"abAB \n\t\r\x0b\x0c\x00\x1c\x1f\x85\xa0\xc3"
    for _ in range(400):
        texts = [rng.choice([None, b"", b"\n", bytes(rng.choices(odd, k=rng.randrange(60))),
                             b" ".join(bytes(rng.choices(b"ab\x00", k=rng.randrange(1, 45))) for _ in range(rng.randrange(9)))])
                 for _ in range(rng.randrange(1, 7))]
        want = plain_sets(texts)
        owner, number, bounds, hashes = linededup.line_sets(texts)
        assert list(zip(owner.tolist(), number.tolist())) == [(d, i) for d, i, _ in want]
        words = sorted(set().union(*(w for _, _, w in want)))
        sizes = np.array([len(w) for w in words], np.int64)
        of = dict(zip(words, linededup.word_hashes(b" ".join(words), np.cumsum(sizes + 1) - sizes - 1, sizes).tolist()))
        assert len(set(of.values())) == len(words)       # other words, other hashes, wherever a word lies
        assert [hashes[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [sorted(of[x] for x in w) for _, _, w in want]
        some = linededup.line_sets(texts, lambda d, i: (d + i) % 2 == 0)
        held = [k for k, (d, i, _) in enumerate(want) if (d + i) % 2 == 0]
        assert list(zip(some[0].tolist(), some[1].tolist())) == [want[k][:2] for k in held]
        assert some[3].tolist() == [x for k in held for x in hashes[bounds[k]:bounds[k + 1]].tolist()]


def test_words_are_not_handled_one_by_one():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))).encode() for _ in range(20_000)]
    texts = [b"\n".join(b" ".join(rng.choices(words, k=40)) for _ in range(10)) for _ in range(700)]

    def plain():
        known = {}
        for _, _, line in plain_sets(texts):
            np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in line), np.uint64, len(line))

    def seconds(work):
        taken = []
        for _ in range(3):
            began = time.process_time()
            work()
            taken.append(time.process_time() - began)
        return min(taken)

    assert seconds(lambda: linededup.line_sets(texts)) < seconds(plain) / 2


def test_query_counts_lines(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "é\n\nb\r\nc"), (5, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_lines for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 4, 5: 1}

import itertools
import random
import re
from collections import Counter

from compare import compare

from itemweld.llm import automata, phrases
from itemweld.llm.automata import Automaton
from itemweld.llm.queries import QUERIES, SQL
from itemweld.sources.staging import Stages

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest=5, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII_LOWER)):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, words[i:i + m]) for i in range(len(words) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    inside = set()
    for (lang, words), a in f.items():
        for i, j in itertools.combinations(range(len(words) + 1), 2):
            if j - i < len(words) and f[lang, words[i:j]] <= a:
                inside.add((lang, words[i:j]))
    out = {}
    for (lang, words), a in f.items():
        if len(words) > 1 and (lang, words) not in inside:
            score, k = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words)))
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), k))
    return sorted((lang, r + 1, p.decode(), -a, f[lang, tuple(p.decode().split(" ")[:k])], f[lang, tuple(p.decode().split(" ")[k:])], n[lang], -s, k)
                  for lang, found in out.items() for r, (s, a, p, k) in enumerate(sorted(found)[:top]))


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_query_matches_sql(spark):
    name = "op11_phrase_collocations"
    problem, rows, _, _ = compare(spark, "/root/testdata/sf0.01", name, QUERIES[name], SQL[name])
    assert problem is None and rows > 10, problem


def corpus(n=400):
    draw, words = random.Random(2), ["the", "of", "a", "New", "york", "city", "état", "naïve", "x-1", "日本", "\x01b", "b c", "Ω"]
    out = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n", "\n"]) for _ in range(draw.randint(0, 60)))
        out.append((text + draw.choice(["", " New York City of the", " new YORK city"]), draw.choice(["en", "en", "en", "fr", None, ""])))
    return out


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD", 700)
    monkeypatch.setattr(phrases, "FAN", 3)
    monkeypatch.setattr(phrases, "PER_RANGE", 2_000)
    monkeypatch.setattr(phrases, "CUTS", 4)
    monkeypatch.setattr(phrases, "ASKED", 50)
    monkeypatch.setattr(phrases, "AT_ONCE", 64)
    rows = corpus() + [(None, "en"), ("", None), ("  \t . ", "de"), ("hot line of the day " * 300, "en")] + [("one hot line here", "fr")] * 60
    want = brute(rows, 12)
    assert len(want) > 50 and mined(spark, rows, least=12) == want
    assert mined(spark, rows, least=12, top=3) == brute(rows, 12, top=3)
    assert mined(spark, rows, least=30, longest=3) == brute(rows, 30, longest=3)


def test_empty_and_clashing_columns(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None), ("", "en")]) == []
    df = spark.createDataFrame([("a b. a b", "en")] * 3, "text string, lang string").selectExpr("*", "1 AS n", "'q' AS h", "2 AS shard", "3 AS phrase")
    assert [tuple(r) for r in phrases.collocations(df, least=6).collect()] == [("en", 1, "a b", 6, 6, 6, 12, 2000, 1)]


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, l, r = 10 ** 12 + 7, 10 ** 15 + 1, 10 ** 13 + 3, 10 ** 12 + 9
    got = spark.sql(f"SELECT (1000 * CAST({a}L AS DECIMAL(38, 0)) * {n}L) DIV (CAST({l}L AS DECIMAL(38, 0)) * {r}L) AS s").first().s
    assert got == 1000 * a * n // (l * r)


def test_automata():
    draw = random.Random(4)
    sets = [Counter({tuple(draw.choice([b"a", b"b", b"cc", b"d"]) for _ in range(draw.randint(1, 5))): draw.randint(1, 9) for _ in range(200)}) for _ in range(5)]
    made = [automata.Automaton.load(automata.from_items(sorted(s.items())).dump()) for s in sets]
    for s, a in zip(sets, made):
        assert list(a.items()) == sorted(s.items()) and len(a) == len(s)
    total = Counter()
    for s in sets:
        total.update(s)
    assert automata.union(made, 7) == sorted((k, v) for k, v in total.items() if v >= 7)
    for s, a in zip(sets, made):
        order = sorted(s)
        assert {order[m]: n for m, n in automata.composed(a, made[0])} == {k: sets[0][k] for k in s if k in sets[0]}
    bounds = sorted(draw.sample(sorted(total), 9))
    for place, items in automata.pieces(sorted(total.items()), bounds):
        assert all(automata.range_of(k, bounds) == place for k, _ in items)
    same = automata.from_items([((b"x", b"q", b"z"), 1), ((b"y", b"q", b"z"), 2)])
    assert len(same.final) == 4       # the way on after x and y is one


def test_unions_are_cut_into_pieces(spark, monkeypatch):
    for name, value in {"SHARD": 400, "FAN": 3, "PER_RANGE": 4_000, "CUTS": 4, "PIECE": 15}.items():
        monkeypatch.setattr(phrases, name, value)
    largest = Counter()

    class Seen(Stages):
        def save(self, df, name, **options):
            out = super().save(df, name, **options)
            if "automaton" in out.columns:
                largest[name] = max(n for (n,) in out.select("n").collect())
            return out

    rows = corpus() + [("a b c", "en and more")] * 12
    assert mined(spark, rows, least=12, stages=Seen(spark, "pieces")) == brute(rows, 12)
    assert {"built", "united1", "found"} <= set(largest) and max(largest.values()) == 15


def test_united_holds_one_piece_of_each_list_at_a_time(monkeypatch):
    lists = [[((b"%03d" % i, b"x"), 1) for i in range(a, 400, 3)] for a in (0, 0, 1)]
    dumps = [(held[0][0], automata.from_items(held).dump()) for items in lists for _, held in automata.pieces(items, [], 10)]
    assert len(dumps) > 30
    loaded, real = [], Automaton.load
    monkeypatch.setattr(Automaton, "load", classmethod(lambda cls, raw: loaded.append(raw) or real(raw)))
    want = automata.union([automata.from_items(items) for items in lists], 2)
    for k, item in enumerate(automata.united(dumps, 2)):
        assert item == want[k] and len(loaded) <= 6 + 3 * (int(item[0][0]) + 1) // 30
    assert k == len(want) - 1 and len(loaded) == len(dumps)

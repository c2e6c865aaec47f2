import hashlib
import math
import random
import re
from collections import Counter

from itemweld.llm import secrets
from itemweld.llm.common import table
from itemweld.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PLAIN = {"assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
         "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def plain(text):
    """The base spans as the patterns say, failing matches dropped afterwards."""
    out = []
    for n, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text or ""):
            if (len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)):
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [sum(s.startswith(k) for s in spans) for k in PLAIN] == [r.n_assign, r.n_access, r.n_hex]
        assert [s for s in r.spans.split(",") if s and not s.startswith("guess")] == spans


def test_query_equals_plain_patterns(spark):
    texts = {r.doc_id: r.text for r in table(spark, FOLDER, "documents").collect()}
    rows = QUERIES["op13_guess_cost_secrets"](spark, FOLDER).collect()
    check(rows, texts)
    assert sum(r.n_assign for r in rows) and sum(r.n_hex for r in rows)


def test_awkward_texts(spark):
    draw = random.Random(6)
    bits = ["token", "TOKEN", "ſecret", "toKen", "secret", "api_key", "ApiKey", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "AKIA" + "Z9" * 8, "0123456789abcdef" * 2,
            "deadbeef", "é", "😀", "\n", "password", "passwd", "is", "pwd", "hunter2!", "Zx9$kQ2#vB7&"]
    texts = {i: "".join(draw.choice(bits) for _ in range(draw.randint(0, 60))) for i in range(400)}
    texts |= {400: None, 401: "", 402: "secret=token:abcdefgh", 403: "a" * 300_000 + " token = " + "f0" * 30_000, 404: "AKIAAKIA" + "Q" * 12 + "AKIA"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(secrets.summary(secrets.find(df)).collect(), texts)


def test_contexts_and_costs(spark):
    rows = [(i, "the password of the house is welcome dragon monday required") for i in range(40)]
    rows += [(100, "pwd is Zx9$kQ2#vB7&w"), (101, "The password is required, always"), (102, "login: qwertyuiop"), (103, "login: 1111111111111111"),
             (104, "password = Zx9kQ2vB7w"), (105, "passphrase: dragonmonday"), (106, "api key => xkfqzjvwbpmhtg"), (None, "pwd is Zx9$kQ2#vB7&w"), (100, "pwd is Zx9$kQ2#vB7&w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS spans", "2 AS word", "3 AS key")
    got = [(r.doc_id, [(s.kind, s.start, s.end, s.value) for s in r.spans]) for r in secrets.find(df).collect()]
    assert len(got) == len(rows)
    found = {i: s for i, s in got if s}
    assert found == {100: [("guess", 7, 20, "Zx9$kQ2#vB7&w")], None: [("guess", 7, 20, "Zx9$kQ2#vB7&w")], 104: [("assign", 0, 21, "Zx9kQ2vB7w")],
                     106: [("guess", 11, 25, "xkfqzjvwbpmhtg")]}
    assert sum(1 for i, s in got if i == 100 and s) == 2
    assert secrets.find(df.where("false")).collect() == []


def slow_cost(value, known, total):
    """The same minimum over every cut, by recursion over whole segmentations of short values."""
    best = [0.0] + [math.inf] * len(value)
    for j in range(1, len(value) + 1):
        for i in range(j):
            best[j] = min(best[j], best[i] + segment(value[i:j], known, total))
    return best[-1]


def segment(s, known, total):
    options = [secrets.tried(s) if len(s) == 1 else math.inf]
    low = secrets.spelled(s)
    if secrets.WORD_LEAST <= len(s) <= secrets.WORD_MOST and low in known and low.isalpha():
        options.append(math.log10(total / known[low]) + secrets.written(s))
    if s[0].isdigit() and len(s) in (4, 6, 8, 10) and secrets.DATES.match(s):
        options.append(math.log10(200) if len(s) == 4 else math.log10(200 * 366 * 4))
    steps = [(secrets.PLACE[b][0] - secrets.PLACE[a][0], secrets.PLACE[b][1] - secrets.PLACE[a][1]) if b in secrets.NEAR.get(a, ()) else None
             for a, b in zip(s.lower(), s.lower()[1:])]
    if len(s) >= 3 and None not in steps:
        turns = sum(1 for n, d in enumerate(steps) if n == 0 or d != steps[n - 1])
        options.append(math.log10(len(secrets.NEAR)) + turns * math.log10(secrets.DEGREE) + math.log10(len(s)))
    return min(options)


def test_cost_is_the_least_over_all_cuts():
    known, draw = {"dragon": 50, "monday": 20, "pass": 400, "word": 300, "sword": 7}, random.Random(9)
    for _ in range(300):
        value = "".join(draw.choice(["dragon", "Monday", "p4ss", "word", "sw0rd", "1987", "2301", "qwe", "zx", "7", "!", "K"]) for _ in range(draw.randint(1, 5)))
        whole, plain_ = secrets.cost(value, known, 10_000), slow_cost(value, known, 10_000)
        repeats = any(value[i:i + p] == value[i + p:i + 2 * p] for p in range(1, 13) for i in range(len(value) - 2 * p + 1))
        assert whole <= plain_ + 1e-9 and (repeats or abs(whole - plain_) < 1e-9), value
    assert secrets.cost("a" * 16, {}, 1) < 3 and secrets.cost("abcabcabcabc", {}, 1) < 5
    assert secrets.cost("", {}, 0) == 0
    assert Counter(secrets.substrings("p4ss!")) == Counter({"pas", "ass", "pass", "assi", "passi", "ssi"})

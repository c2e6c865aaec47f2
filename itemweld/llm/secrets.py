"""Secrets in texts: fixed patterns, and values in credential contexts rated by the guesses they cost.

The guesses of a value are the least over all ways to cut it into words, dates, repeats, keyboard walks and
characters tried one by one, found by dynamic programming over positions (all in log10). How soon a word is
guessed follows from how often all documents use it, so words are counted over the whole corpus and joined to the
substrings of the values; no dictionary is held.
"""

import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from itemweld.llm.common import WORDS_KEPT, text_blocks
from itemweld.sources.staging import Stages

# The base patterns and their least lengths, in the order kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")       # the same runs as AKIA[A-Z0-9]+ of 20 characters and more
HEX = re.compile(r"[0-9a-f]{24,}")              # the same runs as [0-9a-f]+ of 24 characters and more
KINDS = ["assign", "access", "hex", "guess"]

# Where else a credential may stand: a naming word, then a sign or "is", then the value.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|authorization|login|"""
    r"""(?:api|access|private|secret|signing|encryption)[_\x20-]?key)["']?\x20*(?::=|=>|[:=]|\x20is|\x20was)\x20*["']?([^\s"'<>,;]+)""",
    re.I | re.A)
GUESSES = 12.0              # log10 of the guesses from which a value in a context is a secret

# Neighbours on the keyboard by row, letters written as other signs, character classes.
ROWS = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]
SIGNS = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}
WORD_LEAST, WORD_MOST = 3, 20
PERIOD, WALK = 12, 40       # longest repeated block; longest walk taken as one span

DATES = re.compile(r"(?:(?:19|20)\d\d)$|(?:\d{1,2})([-/._]?)(?:\d{1,2})\1(?:(?:19|20)?\d\d)$|(?:(?:19|20)\d\d)([-/._]?)(?:\d{1,2})\2(?:\d{1,2})$")


def _neighbours():
    near = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            near.setdefault(key, set()).update(row[max(x - 1, 0):x] + row[x + 1:x + 2])
            for other in (ROWS[y - 1] if y else "", ROWS[y + 1] if y + 1 < len(ROWS) else ""):
                near[key].update(other[max(x - 1, 0):x + 2])
    return near


NEAR = _neighbours()
DEGREE = sum(map(len, NEAR.values())) / len(NEAR)


def spelled(value: str) -> str:
    """Lower case, signs that stand for letters replaced."""
    return "".join(SIGNS.get(c, c) for c in value.lower()) if len(value.lower()) == len(value) else value


def substrings(value: str) -> set:
    """What of the value may be a word: letter runs of WORD_LEAST to WORD_MOST after ``spelled``."""
    out = set()
    for run in re.finditer("[a-z]{%d,}" % WORD_LEAST, spelled(value)):
        text = run[0]
        for i in range(len(text) - WORD_LEAST + 1):
            for j in range(i + WORD_LEAST, min(i + WORD_MOST, len(text)) + 1):
                out.add(text[i:j])
    return out


def tried(c: str) -> float:
    """log10 of the choices for a single character of its class."""
    if c.isdigit() and c.isascii():
        return 1.0
    if c.isalpha() and c.isascii():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def written(span: str) -> float:
    """log10 of the ways to write a word that had to be tried: capitals and replaced signs."""
    letters = [c for c in span if c.isalpha()]
    upper, signs = sum(c.isupper() for c in letters), len(span) - len(letters)
    ways = 0.0
    if upper:
        plain = span[0].isupper() and upper == 1 or upper == len(letters)
        ways = math.log10(2) if plain else upper * math.log10(2) + math.log10(2)
    return ways + signs * math.log10(2)


def cost(value: str, known: dict, total: int) -> float:
    """log10 of the guesses for a value. ``known``: word -> occurrences among ``total`` words of the corpus."""
    n, text = len(value), spelled(value)
    lower = value.lower() if len(value.lower()) == n else value
    single = [tried(c) for c in value]
    same = [None] + [[0] * (n + 1) for _ in range(PERIOD)]       # how many characters on equal those a period later
    for p in range(1, PERIOD + 1):
        for i in range(n - p - 1, -1, -1):
            same[p][i] = same[p][i + 1] + 1 if value[i] == value[i + p] else 0
    least = [0.0] + [math.inf] * n

    def word(i, j):
        f = known.get(text[i:j])
        return math.log10(max(total, 1) / f) + written(value[i:j]) if f else math.inf

    for i in range(n):
        base = least[i]

        def reach(j, guesses):
            if base + guesses < least[j]:
                least[j] = base + guesses

        reach(i + 1, single[i])
        for j in range(i + WORD_LEAST, min(i + WORD_MOST, n) + 1):
            if not ("a" <= text[j - 1] <= "z"):
                break
            reach(j, word(i, j))
        if lower[i].isdigit():
            for j in (i + 4, i + 6, i + 8, i + 10):
                if j <= n and DATES.match(value[i:j]):
                    reach(j, math.log10(200) if j == i + 4 else math.log10(200 * 366 * 4))
        for p in range(1, min(PERIOD, (n - i) // 2) + 1):
            k = same[p][i] // p + 1
            if k > 1:
                reach(i + k * p, min(sum(single[i:i + p]), word(i, i + p)) + math.log10(k))
        turns, way, j = 0, None, i + 1
        while j < min(n, i + WALK) and lower[j] in NEAR.get(lower[j - 1], ()):
            step = _way(lower[j - 1], lower[j])
            turns += step != way
            way, j = step, j + 1
            if j - i >= 3:
                reach(j, math.log10(len(NEAR)) + turns * math.log10(DEGREE) + math.log10(j - i))
    return least[n]


PLACE = {key: (x, y) for y, row in enumerate(ROWS) for x, key in enumerate(row)}


def _way(a, b):
    return PLACE[b][0] - PLACE[a][0], PLACE[b][1] - PLACE[a][1]


def base_spans(text: str) -> list:
    """(kind, start, end, value or None) of the fixed patterns, per kind leftmost and without overlap."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= ASSIGN_LEAST:
            out.append(("assign", m.start(), m.end(), m[2]))
    out += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    return out


def context_spans(text: str, base: list) -> list:
    """Values in the wider contexts that no assignment of the fixed patterns covers."""
    taken, out = sorted((s, e) for kind, s, e, _ in base if kind == "assign"), []
    at = 0
    for m in CONTEXT.finditer(text):
        start, end = m.span(1)
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            out.append(("guess", start, end, m[1]))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])


def scanned(docs: DataFrame) -> DataFrame:
    """(key, row, spans): every document's spans, those of kind guess not rated yet."""

    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in text_blocks([batch]):
                rows, names = [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    base = base_spans(text)
                    found = sorted(base + context_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))
                    rows.append([{"kind": k, "start": s, "end": e, "value": v} for k, s, e, v in found])
                    names.append(f"{task}/{n}")
                    n += 1
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(rows, pa.list_(SPAN))], names=["key", "row", "spans"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text").mapInArrow(run, f"key {kind}, row string, spans array<struct<kind: string, start: int, end: int, value: string>>")


# Lower case for A-Z, white space for all that is no letter.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(256))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): letter runs of WORD_LEAST to WORD_MOST in all texts, values in credential contexts
    left out, counted per task first."""

    def run(batches):
        counts = Counter()

        def out():
            keep = {w: n for w, n in counts.items() if WORD_LEAST <= len(w) <= WORD_MOST}
            counts.clear()
            words, n = pa.array(keep.keys(), pa.binary()).cast(pa.string()), pa.array(keep.values(), pa.int64())
            for a in range(0, len(keep), 50_000):
                yield pa.RecordBatch.from_arrays([words[a:a + 50_000], n[a:a + 50_000]], names=["word", "n"])

        for batch in batches:
            for part in text_blocks([batch]):
                for text in part.column(0):
                    open_text = CONTEXT.sub(" ", ASSIGN.sub(" ", text.as_py() or ""))
                    counts.update(open_text.encode().translate(LETTERS).split())
                    if len(counts) > WORDS_KEPT:
                        yield from out()
        yield from out()

    made = docs.select("text").mapInArrow(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def find(docs: DataFrame, *, key="doc_id", text="text", guesses=GUESSES, stages=None) -> DataFrame:
    """(key, spans): one row per document row, with spans (kind, start, end, value, log10_guesses) by start and kind; code points, end
    exclusive. Kinds: assign, access and hex by the fixed patterns (for assign the span is the whole assignment), guess for a value in
    a wider credential context that costs at least 10^guesses guesses. log10_guesses is given for assign and guess, and is a
    rating only: it never takes an assign span away.

    Null and empty texts have no spans; long texts are read whole; repeated rows and null keys give a row each; an empty table gives
    no rows; other columns, whatever their names, aren't read.
    """
    stages = stages or Stages(docs.sparkSession, "secrets")
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = stages.save(scanned(source), "scanned")
    used = found.select("row", F.posexplode("spans").alias("at", "s")).where("s.value IS NOT NULL").select("row", "at", F.col("s.value").alias("value"))
    used = stages.save(used.withColumn("v", F.sha2("value", 256)), "used")
    values = stages.save(used.groupBy("v").agg(F.first("value").alias("value")), "values")      # equal by their digest
    words = stages.save(word_counts(source), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def parts(frames):
        for frame in frames:
            for v, value in zip(frame["v"], frame["value"]):
                made = sorted(substrings(value))
                for a in range(0, len(made), 100_000):
                    yield pd.DataFrame({"v": v, "word": made[a:a + 100_000]})

    met = values.mapInPandas(parts, "v string, word string").join(words, "word")
    known = met.groupBy("v").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("counts"))

    def rate(frames):
        for frame in frames:
            rated = [cost(value, {} if w is None else dict(zip(w, n)), total) for value, w, n in zip(frame["value"], frame["words"], frame["counts"])]
            yield pd.DataFrame({"v": frame["v"], "cost": [round(c, 6) for c in rated]})

    rated = stages.save(values.join(known, "v", "left").select("v", "value", "words", "counts").mapInPandas(rate, "v string, cost double"), "rated")
    told = used.join(rated, "v").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "cost"))).alias("costs"))
    span = F.transform("spans", lambda s, i: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
                                                      F.try_element_at(F.col("costs"), i).alias("log10_guesses")))
    kept = F.filter(span, lambda s: (s["kind"] != "guess") | (s["log10_guesses"] >= guesses))
    return found.join(told, "row", "left").select(F.col("key").alias(key), kept.alias("spans"))


def summary(found: DataFrame, key="doc_id") -> DataFrame:
    """The spans of ``find`` as counts, the digest of the base ones and text."""

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    rated = F.array_join(F.transform(F.filter("spans", lambda s: s["log10_guesses"].isNotNull()), lambda s: F.format_number(s["log10_guesses"], 3)), ",")
    return found.select(key, *counts[:3], F.sha2(joined(of(*KINDS[:3])), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        counts[3], rated.alias("log10_guesses"))

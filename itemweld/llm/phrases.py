"""Phrase collocations per language from weighted acyclic automata.

1. Texts become shards: word numbers of about SHARD words of one language with their word list.
2. Every shard names its distinct words and word pairs by a 64-bit hash with their counts. Sums of
   counts per hash tell each shard which of its own words and pairs may occur often enough; a phrase
   can't be frequent unless all its pairs are. Equal hashes of different pairs only let more pass.
3. Every shard builds automata of its sorted phrases of one to five words that passed, cut at prefix ranges
   and into consecutive pieces of PIECE phrases. Those of a range are united as sorted streams, with counts
   summed, group by group; a task holds one piece of each shard or earlier union at a time. Ranges get
   finer as automata get larger. What is below the least count leaves after the last union.
4. Every candidate asks for the counts of its parts: the questions of a range are an automaton too and
   are composed with the range's counts.
"""

import pickle
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from itemweld.llm import automata
from itemweld.llm.automata import Automaton
from itemweld.llm.common import U64, WordHash, binary_runs, mix, rows_of
from itemweld.sources.staging import Stages

LONGEST, LEAST, TOP = 5, 100, 2000
SHARD = 1_000_000          # words of a shard, about
PIECE = 8_000              # phrases of an automaton
AT_ONCE = 1 << 20          # bytes tokenised at once
KEYS_PER_TASK = 2_000_000  # hashed words and pairs a task sums
PACKED = 1_000_000         # hashes a task holds before it hands them on
PER_RANGE = 10_000_000     # words of the corpus for each prefix range
FAN, CUTS = 64, 16         # automata united at once; a range is cut into so many finer ones
ASKED = 100_000            # questions composed in one task
PAIR = U64(0x9E3779B97F4A7C15)

# What ends a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"


def _table() -> bytes:
    out = bytearray(range(256))
    for c in range(65, 91):
        out[c] = c + 32
    for c in ENDS:
        out[c] = 46
    out[9] = 32
    return bytes(out)


CLEAN = _table()


def tokens(text: str):
    """Lists of words of a text; a piece's end is the word b".", which no word equals."""
    raw = text.encode().translate(CLEAN)
    at = 0
    while at < len(raw):
        to = raw.find(b".", at + AT_ONCE)
        to = len(raw) if to < 0 else to + 1
        yield raw[at:to].replace(b".", b" . ").split()      # the space is all the white space left
        at = to


class Shard:
    def __init__(self):
        self.ids, self.runs, self.n = {b".": 0}, [], 0

    def add(self, text):
        ids = self.ids
        for words in tokens(text):
            run = np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int32, len(words))
            self.runs += [run, np.zeros(1, np.int32)] if words else []
            self.n += int((run != 0).sum())
        return self

    def row(self):
        flat = np.concatenate(self.runs) if self.runs else np.zeros(0, np.int32)
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 0) | (flat[:-1] != 0)      # one mark between pieces is enough
        return flat[keep].astype("<i4").tobytes(), b" ".join(self.ids), self.n


SHARD_SCHEMA = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("words", pa.binary()), ("n", pa.int64())])


def shards(docs: DataFrame) -> DataFrame:
    """(shard, lang, ids, words, n): texts as word numbers, a few million words a row."""

    def run(batches):
        task, made, open_ = TaskContext.get().partitionId(), 0, {}

        def close(lang):
            nonlocal made
            ids, words, n = open_.pop(lang).row()
            made += 1
            return pa.RecordBatch.from_pylist([{"shard": (task << 32) + made, "lang": lang, "ids": ids, "words": words, "n": n}], SHARD_SCHEMA)

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                if lang not in open_:
                    open_[lang] = Shard()
                if open_[lang].add(text.as_py()).n >= SHARD:
                    yield close(lang)
        for lang in list(open_):
            yield close(lang)

    return (docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
            .mapInArrow(run, "shard long, lang string, ids binary, words binary, n long"))


def opened(row):
    """ids, list of words and their hashes (with the language in them) of a shard."""
    words = row["words"].split(b" ")
    seed = WordHash()[b"\x00" + row["lang"].encode()]
    return np.frombuffer(row["ids"], "<i4"), words, mix(WordHash().of(words) + U64(seed))


def pair_hashes(ids, hashed):
    """Hash of each neighbouring pair of words and whether both are words."""
    h = hashed[ids]
    return mix(h[:-1] * PAIR + h[1:]), (ids[:-1] != 0) & (ids[1:] != 0)


def hashed_counts(stored: DataFrame) -> DataFrame:
    """(h, n, shard) of the distinct words and pairs of each shard."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int32()), ("shard", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, words, hashed = opened(row)
                pairs, real = pair_hashes(ids, hashed)
                for keys in (hashed[ids[ids != 0]], pairs[real]):
                    h, n = np.unique(keys, return_counts=True)
                    for a in range(0, len(h), 200_000):
                        part = h[a:a + 200_000].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[a:a + 200_000].astype(np.int32)),
                                                          pa.array(np.full(len(part), row["shard"]))], schema=schema)

    return stored.select("shard", "lang", "ids", "words").mapInArrow(run, "h long, n int, shard long")


def frequent(sorted_counts: DataFrame, least: int) -> DataFrame:
    """(shard, h as binary) of the hashes whose counts reach ``least`` in all, packed by shard; the input is sorted by
    h within partitions that hold each h whole. Only rows of a hash that hasn't reached it yet are held."""

    def run(batches):
        left, kept, size = None, [], 0         # left: (h, sum, shards) of the last hash of the batch before

        def packed():
            shard, h = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(shard, kind="stable")
            shard, h = shard[order], h[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts]), binary_runs(h, np.r_[cuts, len(h)])], names=["shard", "h"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, n, shard = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy()
            starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            sums = np.add.reduceat(n, starts)
            held = []
            if left and left[0] == h[0]:
                sums[0] += left[1]
                held = left[2]
                if sums[0] >= least and held:
                    before = np.concatenate(held)
                    kept.append((before, np.full(len(before), h[0])))
                    held = []
            good = np.repeat(sums >= least, np.diff(np.r_[starts, len(h)]))
            kept.append((shard[good], h[good]))
            size += int(good.sum())
            tail = [] if sums[-1] >= least else [*(held if len(starts) == 1 else []), shard[starts[-1]:]]
            left = (h[-1], int(sums[-1]), tail)
            if size > PACKED:
                yield packed()
                kept, size = [], 0
        if size:
            yield packed()

    return sorted_counts.select("h", "n", "shard").mapInArrow(run, "shard long, h binary")


def shard_phrases(row, longest):
    """The words of a shard that passed, the phrases of which all words and pairs passed, as sorted rows
    of word numbers filled up with -1, and their counts."""
    ids, words, hashed = opened(row)
    passed = np.sort(np.frombuffer(b"".join(row["h"]), "<i8").view(U64))

    def known(h):
        at = np.minimum(np.searchsorted(passed, h), max(len(passed) - 1, 0))
        return passed[at] == h if len(passed) else np.zeros(len(h), bool)

    good = known(hashed)
    good[0] = False
    kept = sorted(np.flatnonzero(good).tolist(), key=words.__getitem__)
    rank = np.full(len(words), -1, np.int64)
    rank[kept] = np.arange(len(kept))
    r = rank[ids]
    pairs, real = pair_hashes(ids, hashed)
    linked = real & (r[:-1] >= 0) & (r[1:] >= 0)
    linked[linked] = known(pairs[linked])
    # The phrases of m words are numbered in sorted order, so those of m + 1 are sorted by (number, word).
    at, parts, counts = np.flatnonzero(r >= 0), [], []
    number = r[at]
    texts = np.arange(len(kept), dtype=np.int32)[:, None]
    for m in range(1, longest + 1):
        found, number, n = np.unique(number, return_inverse=True, return_counts=True)
        texts = texts[found] if m == 1 else np.concatenate([texts[found // width], (found % width).astype(np.int32)[:, None]], 1)
        parts.append(np.pad(texts, ((0, 0), (0, longest - m)), constant_values=-1))
        counts.append(n)
        width = max(len(kept), 1)
        on = at + m - 1 < len(linked)
        on[on] = linked[at[on] + m - 1]
        at, number = at[on], number[on] * width + r[at[on] + m]
    every, n = np.concatenate(parts), np.concatenate(counts)
    order = np.lexsort(every.T[::-1])
    return [words[k] for k in kept], every[order], n[order]


FRAGMENT = "run long, place long, n long, first binary, automaton binary"


def fragment(run, place, first, made):
    """A row of an automaton; ``run`` names the sorted list it was cut from, ``first`` is its first sequence."""
    return run, place, len(made), pickle.dumps(first), made.dump()


def batch_of(rows):
    run, place, n, first, raw = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array(place, pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.binary()), pa.array(raw, pa.binary())],
                                      names=["run", "place", "n", "first", "automaton"])


def uniting(bounds, least):
    """Unites the automata of a group into ranges cut at the bounds."""

    def unite(key, frame):
        items = automata.united([(pickle.loads(first), raw) for first, raw in zip(frame["first"], frame["automaton"])], least)
        made = [fragment(key[0], place, held[0][0], automata.from_items(held)) for place, held in automata.pieces(items, bounds, PIECE)]
        return pd.DataFrame(made, columns=["run", "place", "n", "first", "automaton"])

    return unite


def counted(docs: DataFrame, stages: Stages, least: int, longest: int):
    """The phrases of one to ``longest`` words that occur at least ``least`` times, as automata by
    prefix range: (place, automaton); the bounds; (lang, n)."""
    spark = docs.sparkSession
    stored = stages.save(shards(docs), "shards", compression="zstd")
    sizes = stages.save(stored.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    hashes = hashed_counts(stored)
    words = stored.agg(F.sum("n")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, words // KEYS_PER_TASK)
    passed = stages.save(frequent(hashes.repartition(tasks, "h").sortWithinPartitions("h"), least), "passed")
    lists = passed.groupBy("shard").agg(F.collect_list("h").alias("h"))      # at most the shard's own distinct words and pairs
    met = stored.join(lists.hint("merge"), "shard")

    depth = 1
    while CUTS ** depth * PER_RANGE < words:
        depth += 1
    bounds = sampled_bounds(stored, CUTS ** depth)

    def cut(level):      # nested: a coarser level keeps every CUTS-th bound
        step = CUTS ** (depth - level)
        return bounds[step - 1::step]

    first = cut(1)

    def build(batches):
        for batch in batches:
            for row in rows_of(batch):
                names, rows, n = shard_phrases(row, longest)
                lang = row["lang"].encode()
                label = names.index(lang) if lang in names else len(names)
                own = [b[1:] if b[0] == lang else () if b[0] > lang else None for b in first]      # () : the language lies before the bound
                edges = [len(n) if b == () else 0 if b is None else bisect_left(range(len(n)), b, key=lambda i: tuple([names[x] for x in rows[i] if x >= 0]))
                         for b in own]
                every = [*names, lang]
                for place, (low, high) in enumerate(zip([0, *edges], [*edges, len(n)])):
                    for a in range(low, high, PIECE):
                        b = min(a + PIECE, high)
                        part = np.pad(rows[a:b], ((0, 0), (1, 0)), constant_values=label)
                        made = automata.from_rows(part.tolist(), n[a:b].tolist(), every)
                        yield batch_of([fragment(row["shard"], place, tuple(every[x] for x in part[0].tolist() if x >= 0), made)])

    parts = stages.save(met.select("shard", "lang", "ids", "words", "h").mapInArrow(build, FRAGMENT), "built", compression="zstd")
    count = stored.count()
    level, slots = 1, -(-max(count, 1) // FAN)
    while True:
        last = slots == 1 and level >= depth
        finer = cut(min(level + 1, depth))
        parts = parts.withColumn("slot", F.pmod(F.xxhash64("run"), F.lit(slots)))

        unite = uniting(finer, least if slots == 1 else 1)
        parts = stages.save(parts.groupBy("slot", "place").applyInPandas(unite, FRAGMENT), f"united{level}", compression="zstd")
        if last:
            return parts.select("place", "n", "automaton"), bounds, sizes
        level, slots = level + 1, -(-slots // FAN)


def sampled_bounds(stored: DataFrame, ranges: int) -> list:
    """Bounds of the prefix ranges from a bounded sample of the shards' positions (results don't depend on them)."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                ids, words = np.frombuffer(row["ids"], "<i4"), row["words"].split(b" ")
                at = np.flatnonzero(ids != 0)
                at = at[len(at) // 512::max(1, len(at) // 256)]
                made = []
                for i in at.tolist():
                    window = ids[i:i + 3].tolist()
                    made.append(b" ".join(words[x] for x in (window[:window.index(0)] if 0 in window else window)))
                langs = pa.array([row["lang"]] * len(made), pa.string())
                yield pa.RecordBatch.from_arrays([langs, pa.array(made, pa.binary())], names=["lang", "phrase"])

    sample = stored.select("lang", "ids", "words").mapInArrow(run, "lang string, phrase binary").orderBy(F.xxhash64("lang", "phrase", F.lit(11))).limit(ranges * 32)
    keys = sorted({(r.lang.encode(), *bytes(r.phrase).split(b" ")) for r in sample.collect()})
    return [keys[i * len(keys) // ranges] for i in range(1, ranges)] if len(keys) >= ranges else keys


def collocations(docs: DataFrame, *, least=LEAST, longest=LONGEST, top=TOP, stages=None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): of each language the first ``top`` phrases of two
    to ``longest`` words that occur at least ``least`` times, by score, count and phrase.

    Words lie between spaces and tabs inside pieces between .,;:!? and line ends, A-Z in lower case. n counts a
    language's words. The score of a cut is floor(1000 * a * n / (l * r)) in exact arithmetic; the lowest of
    a phrase's cuts counts, the first of equal ones. A phrase that a longer one with the same count contains is dropped.
    A null language is ``und``, a null text has no words; repeated rows count as often as they stand there; long texts
    are read whole; an empty table, or one without frequent phrases, gives no rows. Other columns aren't read.
    """
    stages = stages or Stages(docs.sparkSession, "phrases")
    found, bounds, sizes = counted(docs, stages, least, longest)
    found = stages.save(found, "found", compression="zstd")

    schema = pa.schema([("place", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64()), ("k", pa.int32()),
                        ("left", pa.bool_()), ("part", pa.string())])

    def ask(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        rows = []
        for batch in batches:
            for row in rows_of(batch):
                for (lang, *words), a in Automaton.load(row["automaton"]).items():
                    text = b" ".join(words).decode()
                    for k in range(1, len(words)):
                        for left, part in ((True, words[:k]), (False, words[k:])):
                            rows.append((automata.range_of((lang, *part), bounds), lang.decode(), text, a, k, left, b" ".join(part).decode()))
                    if len(rows) > 20_000:
                        yield out(rows)
                        rows = []
        if rows:
            yield out(rows)

    asked = stages.save(found.select("automaton").mapInArrow(ask, "place long, lang string, phrase string, a long, k int, left boolean, part string"), "asked")
    # Hot ranges are met by several tasks, each with a copy of the range's automaton.
    loads = asked.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("slots"))
    loads = stages.save(loads, "loads")
    right = asked.join(loads, "place").withColumn("slot", F.pmod(F.xxhash64("phrase", "k"), F.col("slots")))
    left = (found.join(loads, "place").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
            .select("place", F.col("slot").cast("long").alias("slot"), "automaton"))

    def answer(key, held, questions):
        wanted = {}
        for i, (lang, part) in enumerate(zip(questions["lang"], questions["part"])):
            wanted.setdefault((lang.encode(), *part.encode().split(b" ")), []).append(i)
        order = sorted(wanted)
        asking, f = automata.from_items((w, 0) for w in order), np.zeros(len(questions), np.int64)
        for raw in held["automaton"]:
            for m, count in automata.composed(asking, Automaton.load(raw)):
                f[wanted[order[m]]] = count
        return questions[["lang", "phrase", "a", "k", "left", "part"]].assign(f=f)

    told = left.groupBy("place", "slot").cogroup(right.select("place", F.col("slot").cast("long").alias("slot"), "lang", "phrase", "a", "k", "left", "part").groupBy("place", "slot"))
    told = stages.save(told.applyInPandas(answer, "lang string, phrase string, a long, k int, left boolean, part string, f long"), "told")

    inside = told.where("f = a AND part LIKE '% %'").select("lang", F.col("part").alias("phrase")).distinct()
    cuts = told.groupBy("lang", "phrase", "k").agg(F.max("a").alias("a"), F.max(F.expr("CASE WHEN left THEN f END")).alias("l"),
                                                   F.max(F.expr("CASE WHEN NOT left THEN f END")).alias("r"))
    wide = "CAST({} AS DECIMAL(38, 0))"
    score = F.expr(f"(1000 * {wide.format('a')} * n) DIV ({wide.format('l')} * r)").cast("long")
    best = (cuts.join(sizes, "lang").withColumn("score", score).groupBy("lang", "phrase")
            .agg(F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("s"))
            .join(inside, ["lang", "phrase"], "left_anti"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), "phrase"))
    return (best.withColumn("rank", rank).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("s.l").alias("l"), F.col("s.r").alias("r"), "n", F.col("s.score").alias("score"), F.col("s.k").alias("cut")))

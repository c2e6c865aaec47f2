"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words; only blank lines, which have none, are left alone. Lines
with equal sets are one class. Sets of up to 5 words are similar to equal ones only, so their
classes settle them. The words of any other class are ordered by rarity over all lines; two sets of Jaccard similarity t share a word among the
first n - ceil(t n) + 1 of each, so only these are indexed. Index entries of one word must pass the
length filter, the positional bound and a parity filter (64 bits, each the parity of the words that
hash there: sets that differ in d words differ in d bits at most), then the whole sets are
compared. A line goes if any earlier line (by document, then position) is similar to it, whether
that line stays or not: the result doesn't depend on the order of work, and one match settles a
line. So the lines of a crowded word first meet only its first and its most repeated line;
the ones not settled by that meet the rest.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from itemweld.llm.common import U64, binary_runs, mix, starts_of, text_blocks
from itemweld.sources.staging import Stages

PERCENT = 85         # similarity from which a later line goes
COUNTERS = 1 << 22   # counters of hashed words: a fixed size, whatever the vocabulary
SLICE = 1 << 14
CROWDED = 2000       # entries of a word from which they first meet two centres only
SLOTS = 1 << 20      # size of the table that keeps most texts from being looked through again
MARKS = 1 << 26      # bits that mark wanted keys or lines: a fixed size, more wanted ones only let more others through
SPREAD = 2654435761  # spreads the lines of a document over the marks
BLOCK = 2_000_000    # bytes of text taken at once: arrays of their words stay in the processor's cache
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONG_WORD = 32       # longer words are hashed one by one
LINE_COLUMNS = ["row", "doc_id", "line", "key", "bits", "words", "slice", "counts"]


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, text binary); row names the document by id and text."""
    t = F.col(text).cast("string")
    return docs.select(F.xxhash64(F.col(doc_id).cast("long"), t).alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
                       t.cast("binary").alias("text"))


def word_hashes(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the words text[starts[i]:starts[i] + sizes[i]], eight bytes a step for all words at once."""
    eights = np.frombuffer(text + bytes(16 - len(text) % 8), U64)

    def read(at, left):
        i, shift = at >> 3, (at & 7).astype(U64) << U64(3)
        return (eights[i] >> shift | eights[i + 1] << U64(1) << U64(63) - shift) & LOW_BYTES[np.minimum(left, 8)]

    out = mix(read(starts, sizes) + sizes.astype(U64) * U64(0x9E3779B97F4A7C15))
    for done in range(8, LONG_WORD, 8):
        more = np.flatnonzero((sizes > done) & (sizes <= LONG_WORD))
        out[more] = mix(out[more] + read(starts[more] + done, sizes[more] - done))
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i]:starts[i] + sizes[i]])
    return out


def runs_by_size(sizes: np.ndarray):
    """(numbers of the runs of one size, their places in a flat array as a matrix, a row for each run) for each size."""
    starts, order = starts_of(sizes)[:-1], np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        runs = order[a:b]
        yield runs, starts[runs, None] + np.arange(sizes[runs[0]])


def line_sets(texts, wanted=None):
    """(text number, line number, bounds, hashes in ascending order) of the lines of one or more texts that aren't blank;
    with ``wanted``, only of those lines for which wanted(text numbers, line numbers) is true."""
    text = b"\n".join([t or b"" for t in texts]).lower()
    data = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(SPACE[data], prepend=True, append=True))
    begins, ends = edges[::2], edges[1::2]
    lines = np.append(0, np.flatnonzero(data == 10) + 1)
    of_text = np.searchsorted(lines, starts_of([len(t) + 1 if t else 1 for t in texts]))      # each text's first line
    of_text[-1] = len(lines)
    owner = np.repeat(np.arange(len(texts)), np.diff(of_text))
    number = np.arange(len(lines)) - of_text[owner]
    sizes = np.diff(np.append(np.searchsorted(begins, lines), len(begins)))
    keep = sizes > 0
    if wanted is not None:
        keep &= wanted(owner, number)
        held = np.repeat(keep, sizes)
        begins, ends = begins[held], ends[held]
    owner, number, sizes = owner[keep], number[keep].astype(np.int32), sizes[keep]
    hashes = word_hashes(text, begins, ends - begins)
    once = np.ones(len(hashes), bool)
    for _, at in runs_by_size(sizes):
        hashes[at] = same = np.sort(hashes[at], axis=1)
        once[at[:, 1:]] = same[:, 1:] != same[:, :-1]
    if len(sizes):
        sizes = np.add.reduceat(once, starts_of(sizes)[:-1], dtype=np.int64)
    return owner, number, starts_of(sizes), hashes[once]


def set_keys(hashes, bounds) -> np.ndarray:
    """One 64-bit key per set: the sum of its words' mixed hashes, whatever their order."""
    return np.add.reduceat(mix(hashes), bounds[:-1]).view(np.int64) if len(bounds) > 1 else np.zeros(0, np.int64)


def equal_only(sizes: np.ndarray, percent: int) -> np.ndarray:
    """True for sets so small that no other set is similar: not even one with a single word more."""
    return 100 * sizes < percent * (sizes + 1)


def lines_of(docs: DataFrame, doc_id: str, text: str, percent: int) -> DataFrame:
    """(row, doc_id, line, key, bits, words) of every line that isn't blank, words being the upper
    halves of the hashes, none where only equal sets are similar; and from each task (slice, counts): how often it met the words of each hash, one byte
    each, 255 for more."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for block in text_blocks(batches, limit=BLOCK):
            owner, numbers, bounds, hashes = line_sets(block.column(2).to_pylist())
            at, n, sizes = pa.array(owner), len(owner), np.diff(bounds)
            few = equal_only(sizes, percent)
            words = (hashes[np.repeat(~few, sizes)] >> U64(32)).astype(np.uint32)
            np.add.at(counts, (words & np.uint32(COUNTERS - 1)).astype(np.int64), 1)
            bits = np.bitwise_xor.reduceat(U64(1) << (mix(hashes) & U64(63)), bounds[:-1]) if n else np.zeros(0, U64)
            yield pa.RecordBatch.from_arrays(
                [block.column(0).take(at), block.column(1).take(at), pa.array(numbers), pa.array(set_keys(hashes, bounds)), pa.array(bits.view(np.int64)),
                 binary_runs(words, starts_of(np.where(few, 0, sizes))), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=LINE_COLUMNS)
        if counts.any():
            n = COUNTERS // SLICE
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*none, pa.array(np.arange(n, dtype=np.int32)), binary_runs(np.minimum(counts, 255).astype(np.uint8), np.arange(n + 1) * SLICE)], names=LINE_COLUMNS)

    return named(docs, doc_id, text).mapInArrow(
        run, "row long, doc_id long, line int, key long, bits long, words binary, slice int, counts binary")


def word_ranks(stored: DataFrame) -> np.ndarray:
    """Logarithmic counts of hashed words over all lines: ``COUNTERS`` bytes, rarest lowest."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint8).astype(np.int64) for c in frame["counts"])
        rank = np.minimum(np.ceil(8 * np.log2(1 + total)), 255).astype(np.uint8)
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "rank": [rank.tobytes()]})

    out = np.zeros(COUNTERS, np.uint8)
    for r in (stored.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice")
              .applyInPandas(add, "slice int, rank binary").collect()):
        out[r.slice * SLICE:(r.slice + 1) * SLICE] = np.frombuffer(r.rank, np.uint8)
    return out


def prefix_rows(stored: DataFrame, ranks, percent: int) -> DataFrame:
    """(word, key, bits, place, doc_id) of the rarest words of each line that has words stored; place = n << 32 | position from 1.
    Equal lines of one batch are indexed once."""

    def run(batches):
        rank = ranks.value.astype(U64) << U64(32)
        for batch in batches:
            keys, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            docs = pc.fill_null(batch.column(3), -(1 << 63)).to_numpy()      # null comes first
            if not len(keys):
                continue
            once = np.sort(np.unique(keys, return_index=True)[1])
            raw = batch.column(2).take(pa.array(once)).to_pylist()
            words = np.frombuffer(b"".join(raw), np.uint32)
            order = rank[words & np.uint32(COUNTERS - 1)] | words
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            take = sizes - (percent * sizes + 99) // 100 + 1
            into, first = starts_of(take), np.zeros(take.sum(), np.uint32)
            for sets, at in runs_by_size(sizes):
                n = take[sets[0]]
                first[into[sets, None] + np.arange(n)] = np.sort(order[at], axis=1)[:, :n]
            owner = np.repeat(np.arange(len(once)), take)
            pos = np.arange(len(owner)) - np.repeat(into[:-1], take) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(first.view(np.int32)), pa.array(keys[once][owner]), pa.array(bits[once][owner]),
                 pa.array(sizes[owner] << 32 | pos), pa.array(docs[once][owner])], names=["word", "key", "bits", "place", "doc_id"])

    return stored.where("slice IS NULL AND length(words) > 0").select("key", "bits", "words", "doc_id").mapInArrow(
        run, "word int, key long, bits long, place long, doc_id long")


def compatible(bits_a, place_a, bits_b, place_b, percent: int):
    """True where lengths, positions and parities of two entries leave room for the threshold."""
    na, nb, pa_, pb = place_a >> 32, place_b >> 32, place_a & 0xFFFFFFFF, place_b & 0xFFFFFFFF
    total = na + nb
    differ = np.bitwise_count((bits_a ^ bits_b).view(U64)).astype(np.int64)
    return ((100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            & ((100 + percent) * (1 + np.minimum(na - pa_, nb - pb)) >= percent * total)
            & ((100 + percent) * differ <= (100 - percent) * total))


def candidates(index: DataFrame, percent: int) -> DataFrame:
    """(a, b, word, bits, place): pairs of keys a < b to compare, word null; and the entries of
    crowded words, b null.

    One match settles a line, so under each word a line first meets only that one of the compatible
    lines of earlier documents whose parities are nearest to its own, and those of its own document. A
    word is crowded if that left any compatible pair out.
    """

    def run(batches):
        parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]     # one partition of the index
        if not parts:
            return
        word, key, bits, place, doc = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((key, word.astype(np.int64) << 32 | place >> 32))      # by length within a word; equal keys have one length
        word, key, bits, place, doc = (x[order] for x in (word, key, bits, place, doc))
        first = np.flatnonzero((np.diff(word, prepend=word[0] - 1) != 0) | (np.diff(key, prepend=key[0] - 1) != 0))
        times = np.diff([*first, len(word)])
        doc = np.minimum.reduceat(doc, first)      # the earliest document of each
        word, key, bits, place = (x[first] for x in (word, key, bits, place))
        start = np.flatnonzero(np.diff(word.astype(np.int64), prepend=-(1 << 40)))
        size = np.diff([*start, len(word)])
        left = np.repeat(start + size, size) - np.arange(len(word))      # entries from here to the word's end
        crowd = np.repeat(size > CROWDED, size)
        pairs = [np.zeros((0, 2), np.int64)]

        best, chances = np.full(len(word), 1 << 62), np.zeros(len(word), np.int64)

        def found_pairs(i, j):
            pairs.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], 1))

        def meet(i, j):
            ok = compatible(bits[i], place[i], bits[j], place[j], percent) & (key[i] != key[j])
            found_pairs(i[ok], j[ok])

        few, size_of = np.flatnonzero(~crowd), place >> 32
        for d in range(1, CROWDED):
            few = few[left[few] > d]
            few = few[100 * size_of[few] >= percent * size_of[few + d]]      # longer partners only follow
            if not len(few):
                break
            ok = compatible(bits[few], place[few], bits[few + d], place[few + d], percent)
            i, j = few[ok], few[ok] + d
            same = doc[i] == doc[j]
            found_pairs(i[same], j[same])
            i, j = i[~same], j[~same]
            late, early = np.where(doc[i] > doc[j], i, j), np.where(doc[i] > doc[j], j, i)
            apart = np.bitwise_count((bits[i] ^ bits[j]).view(U64)).astype(np.int64)
            np.minimum.at(best, late, apart << 40 | early)
            np.add.at(chances, late, 1)
        late = np.flatnonzero(chances)
        found_pairs(late, best[late] & ((1 << 40) - 1))
        full = np.zeros(len(start), bool)
        np.logical_or.at(full, np.repeat(np.arange(len(start)), size), chances > 1)
        crowd |= np.repeat(full, size)
        for s, n in zip(start[size > CROWDED], size[size > CROWDED]):
            rows = np.arange(s, s + n)
            for centre in {int(s), int(s + times[s:s + n].argmax())}:
                meet(rows, np.full(n, centre))
        found = np.unique(np.concatenate(pairs), axis=0)
        n = len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[:, 0]), pa.array(found[:, 1]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=["a", "b", "word", "bits", "place"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[crowd]), pa.nulls(int(crowd.sum()), pa.int64()), pa.array(word[crowd]), pa.array(bits[crowd]), pa.array(place[crowd])],
            names=["a", "b", "word", "bits", "place"])

    return index.repartition("word").mapInArrow(run, "a long, b long, word int, bits long, place long")


def marks(numbers: DataFrame, number: str) -> np.ndarray:
    """``MARKS`` bits, set where a number of the column ends in the bit's place."""
    place = F.col(number).bitwiseAND(MARKS - 1)
    set_bits = (numbers.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at"))
                .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")).toArrow())
    out = np.zeros(MARKS // 64, U64)
    out[set_bits.column("at").to_numpy()] = set_bits.column("bits").to_numpy().view(U64)
    return out


def marked(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """True for numbers that may be among the marked ones."""
    place = numbers.view(U64) & U64(64 * len(bits) - 1)
    return (bits[place >> U64(6)] >> (place & U64(63)) & U64(1)).astype(bool)


def settled_by(pairs: DataFrame, classes: DataFrame, docs: DataFrame, stages: Stages, doc_id: str, text: str, percent: int) -> DataFrame:
    """The later key of each pair (a, b) whose whole sets are similar. The sets are made anew from the
    texts that hold them, where these are read: only sets are shuffled, no texts."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    share = docs.sparkSession.sparkContext.broadcast
    key_marks = share(marks(ends, "key"))

    def among(batches):
        for batch in batches:
            yield batch.filter(pa.array(marked(key_marks.value, batch.column(0).to_numpy())))

    some = classes.select("key", "doc_id", "line", "row").mapInArrow(among, "key long, doc_id long, line int, row long")
    wanted = stages.save(some.join(ends.distinct(), "key"), "wanted")
    line_marks = share(marks(wanted.select(F.col("row").bitwiseXOR(F.col("line").cast("long") * SPREAD).alias("n")), "n"))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(wanted.select(slot("row").alias("slot")).distinct())     # at most SLOTS numbers
    texts = named(docs, doc_id, text).withColumn("slot", slot("row")).join(slots, "slot", "left_semi").select("row", "text")

    def sets(batches):
        for block in text_blocks(batches, limit=BLOCK):
            rows = block.column(0).to_numpy()
            _, _, bounds, hashes = line_sets(block.column(1).to_pylist(), lambda owner, number: marked(line_marks.value, rows[owner] ^ number * SPREAD))
            keys = set_keys(hashes, bounds)
            yield (pa.RecordBatch.from_arrays([pa.array(keys), binary_runs(hashes, bounds)], names=["key", "hashes"])
                   .filter(pa.array(marked(key_marks.value, keys))))

    # Rows that repeat both id and text give their sets repeatedly.
    stored = stages.save(texts.mapInArrow(sets, "key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"))
                         .join(wanted.select("key", "doc_id", "line"), "key"), "sets")

    def compare(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                both = np.sort(np.frombuffer(x + y, U64))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["key"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: stored.select(F.col("key").alias(x), F.col("hashes").alias(f"h_{x}"), F.struct("doc_id", "line", "key").alias(f"p_{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .select(F.greatest("p_a", "p_b").getField("key").alias("later"), "h_a", "h_b").mapInArrow(compare, "key long").distinct())


def removed_lines(docs: DataFrame, *, doc_id="doc_id", text="text", percent=PERCENT, stages=None) -> DataFrame:
    """(row, removed array<int>): the numbers, from 0, of the lines that go, for documents that lose any.

    Words are what white space separates, A-Z in lower case, told apart by 64-bit hashes. Lines
    without words stay. A line is later than another by doc_id (null
    first), then by position. Rows that repeat both id and text are one document: they lose the
    same lines.
    """
    spark = docs.sparkSession
    stages = stages or Stages(spark, "linededup")
    stored = stages.save(lines_of(docs, doc_id, text, percent), "lines", compression="zstd")
    lines = stored.where("slice IS NULL").select("row", "doc_id", "line", "key")
    classes = stages.save(
        lines.groupBy("key").agg(F.min(F.struct("doc_id", "line", "row")).alias("p"), F.count(F.lit(1)).alias("copies"))
             .select("key", "copies", "p.*"), "classes")
    ranks = spark.sparkContext.broadcast(word_ranks(stored))
    met = stages.save(candidates(prefix_rows(stored, ranks, percent), percent), "met")
    pairs = stages.save(met.where("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    done = lambda p: settled_by(p, classes, docs, stages, doc_id, text, percent)
    settled = stages.save(done(pairs), "settled")

    # Lines of crowded words that nothing settled yet meet every other entry of those words.
    crowded = met.where("b IS NULL").select(F.col("a").alias("key"), "word", "bits", "place")
    rest = crowded.join(settled, "key", "left_anti").select("word", *[F.col(c).alias(f"x_{c}") for c in ("key", "bits", "place")])
    n, xn, pos, xpos = (F.shiftright("place", 32), F.shiftright("x_place", 32), F.col("place").bitwiseAND(0xFFFFFFFF), F.col("x_place").bitwiseAND(0xFFFFFFFF))
    room = ((100 * F.least(n, xn) >= percent * F.greatest(n, xn))
            & ((100 + percent) * (1 + F.least(n - pos, xn - xpos)) >= percent * (n + xn))
            & ((100 + percent) * F.bit_count(F.col("bits").bitwiseXOR(F.col("x_bits"))) <= (100 - percent) * (n + xn)))
    more = (rest.join(crowded, "word").where((F.col("key") != F.col("x_key")) & room)
            .select(F.least("key", "x_key").alias("a"), F.greatest("key", "x_key").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    more = stages.save(more, "more")
    gone = stages.save(settled.unionByName(done(more)).distinct().withColumn("gone", F.lit(True)), "gone")

    # Of a class that goes all lines go, of the others all but the first. Classes of one line that stay are not asked for.
    first = classes.where("copies > 1").select("key", *[F.col(c).alias(f"f_{c}") for c in ("row", "line")], F.lit(None).cast("boolean").alias("gone"))
    lost = stages.save(first.unionByName(gone, allowMissingColumns=True).groupBy("key").agg(*[F.max(c).alias(c) for c in ("f_row", "f_line", "gone")]), "lost")
    return (lines.select("key", "row", "line").join(lost, "key").where("gone OR row <> f_row OR line <> f_line")
            .groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def dedup_lines(docs: DataFrame, *, doc_id="doc_id", text="text", drop_emptied=True, stages=None, **options) -> DataFrame:
    """``docs`` with later similar lines taken out of ``text``; all other columns as they were.

    A document that loses every line but blank ones is left out if ``drop_emptied``; one whose text is null or empty
    from the start stays. An empty table gives no rows.
    """
    stages = stages or Stages(docs.sparkSession, "linededup")
    gone = removed_lines(docs, doc_id=doc_id, text=text, stages=stages, **options)
    row, lost = f"__row_{stages.folder[-8:]}", f"__lost_{stages.folder[-8:]}"
    joined = docs.withColumn(row, F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))).join(
        gone.select(F.col("row").alias(row), F.col("removed").alias(lost)), row, "left")
    parts = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(F.col(lost), i))
    left = joined.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(parts, "\n")))
    if drop_emptied:
        left = left.where(F.col(lost).isNull() | F.col(text).rlike(r"\S"))
    return left.select(*docs.columns)

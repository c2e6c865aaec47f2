"""Near-duplicate documents by HyperMinHash.

The word shingles of a document fall into 128 buckets by the top bits of their hash; of each
bucket's smallest hash only the leading-zero count and ten mantissa bits are stored. Bands of
these registers propose pairs, a collision-corrected Jaccard estimate drops hopeless ones, and
the full shingle sets decide.

Copies (equal sets) become one class first. In each band bucket every class meets the bucket's
most central class; only classes that are then still in different components meet others, so a
large group of near copies costs about as many comparisons as it has members.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from itemweld.llm.common import U64, WordHash, ascii_words, binary_runs, mix, starts_of, text_blocks
from itemweld.operators.components import connected_components
from itemweld.sources.staging import Stages

SHINGLE, PERCENT = 5, 75
REGISTERS, MANTISSA = 128, 10
BAND = 4                                  # registers per band: 32 bands miss a pair at 0.75 once in 200,000
SLOTS = 1 << 20                           # size of the table that keeps most texts out of a shuffle
OUTER, INNER, TOGETHER = 1000, 2000, 256  # classes of a block from outside a group's main component, and of all; tasks of small groups
ODD = mix(np.arange(1, SHINGLE + 1, dtype=U64)) | U64(1)
ORDER = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=U64) + U64(77)).reshape(REGISTERS, REGISTERS), axis=1)
BAND_SALT = mix(np.arange(REGISTERS // BAND, dtype=U64) + U64(991))


def shingle_sets(texts, cache: WordHash) -> list:
    """Per text the sorted distinct 64-bit hashes of its shingles."""
    per = [cache.of(ascii_words(t)) if t else np.zeros(0, U64) for t in texts]
    bounds = starts_of([len(w) for w in per])
    words = np.concatenate(per) if per else np.zeros(0, U64)
    total = np.zeros(max(len(words) - SHINGLE + 1, 0), U64)
    for j in range(SHINGLE):
        total += words[j:j + len(total)] * ODD[j]
    total = mix(total)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(total[a:b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * ODD[:b - a]).sum() + U64(b - a)], U64)))
        else:
            out.append(np.zeros(0, U64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers (leading zeros << 10 | mantissa) of a sorted, non-empty set. An empty
    bucket borrows from the first filled one in an order fixed for it."""
    bucket = (hashes >> U64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = (hashes[first] << U64(7)) >> U64(11)                     # 53 bits
    zeros = 53 - np.frexp(low.astype(np.float64))[1]
    mantissa = ((low << zeros.astype(U64)) >> U64(52 - MANTISSA)) & U64((1 << MANTISSA) - 1)
    out, filled = np.zeros(REGISTERS, np.uint16), np.zeros(REGISTERS, bool)
    out[bucket[first]] = (zeros.astype(np.int64) << MANTISSA) | mantissa.astype(np.int64)
    filled[bucket[first]] = True
    if len(first) < REGISTERS:
        empty = np.flatnonzero(~filled)
        out[empty] = out[ORDER[empty, filled[ORDER[empty]].argmax(1)]]
    return out


def collision_rate(na, nb) -> np.ndarray:
    """Chance that a register of two unrelated sets of these sizes is equal: the two minima
    fall into the same cell of width 2^-(k+1-10) behind k zeros, summed over k."""
    a, b = np.maximum(na, 1) / REGISTERS, np.maximum(nb, 1) / REGISTERS
    s, k = a + b, np.arange(54)[:, None]
    high, half = np.exp(-s * 0.5 ** k), np.exp(-s * 0.5 ** (k + 1))
    return np.minimum((0.5 ** (k + 1 + MANTISSA) * (half - high)).sum(0) * a * b / s, 0.5)


def estimate(ra: np.ndarray, rb: np.ndarray, na, nb) -> np.ndarray:
    """Jaccard similarity by the share of equal registers, corrected for collisions."""
    e = collision_rate(na, nb)
    return ((ra == rb).mean(1) - e) / (1 - e)


def lowest(na, nb) -> np.ndarray:
    """Estimates below it, five standard deviations under the threshold, are hopeless."""
    t = PERCENT / 100
    return t - 5 * np.sqrt(t * (1 - t) / np.minimum(np.minimum(na, nb), REGISTERS))


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, key binary, regs binary); the last two null for an empty set."""

    def run(batches):
        cache = WordHash()
        for block in text_blocks(batches):
            sets = shingle_sets(block.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([
                block.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "key", "regs"])

    return (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
                .mapInArrow(run, "doc_id long, n_shingles long, key binary, regs binary"))


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, estimate) of the pairs whose registers allow the threshold."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
                na, nb = (batch.column(i).to_numpy() for i in (4, 5))
                guess = estimate(ra, rb, na, nb)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(guess)], names=["a", "b", "estimate"]).filter(
                    pa.array(guess >= lowest(na, nb)))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
        f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)")
    return sized.select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long, estimate double")


def sets_of(ends: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, hashes) of the documents in ``ends``, made anew from their texts. A table of at most
    SLOTS numbers keeps most of the other texts out of the join."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    slots = F.broadcast(ends.select(slot("doc").alias("slot")).distinct())
    wanted = (docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("string").cast("binary").alias("text"))
              .withColumn("slot", slot("doc")).join(slots, "slot", "left_semi").drop("slot").join(ends, "doc", "left_semi"))

    def sets(batches):
        cache = WordHash()
        for block in text_blocks(batches):
            made = shingle_sets(block.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), binary_runs(np.concatenate(made), starts_of([len(m) for m in made]))],
                names=["doc", "hashes"])

    return wanted.mapInArrow(sets, "doc long, hashes binary")


def several(placed: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    apart = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    return placed.join(apart.select("bucket"), "bucket", "left_semi")


def unconnected_links(placed: DataFrame, docs: DataFrame, stages: Stages, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) between components whose members share buckets.

    Buckets that have classes in common make up a group. The classes outside its largest component
    meet all classes of the group in blocks of bounded size; full sets are compared and only links come out, one
    for every two components that a block connects.
    """
    left = stages.save(placed, "open")
    lows = left.groupBy("bucket").agg(F.min("rep").alias("b"))
    groups = stages.save(connected_components(left.join(lows, "bucket").select(F.col("rep").alias("a"), "b").where("a <> b").distinct(), stages)
                         .select(F.col("id").alias("rep"), F.col("comp").alias("g"))
                         .join(left.select("rep", "comp").distinct(), "rep"), "groups")
    largest = (groups.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("g")
               .agg(F.max(F.struct("n", "comp")).getField("comp").alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
               .select("g", "main", F.ceil((F.col("all") - F.col("most")) / OUTER).cast("int").alias("s_n"),
                       F.ceil(F.col("all") / INNER).cast("int").alias("t_n")))
    facts = stages.save(groups.join(largest, "g"), "facts")
    sets = stages.save(sets_of(facts.select(F.col("rep").alias("doc")), docs, doc_id, text).distinct(), "sets")
    full = facts.join(sets.withColumnRenamed("doc", "rep"), "rep")
    # Small groups share tasks; the blocks of a large one get a task each.
    place = F.when((F.col("s_n") == 1) & (F.col("t_n") == 1), F.concat(F.lit("m"), F.pmod(F.xxhash64("g"), F.lit(TOGETHER)))).otherwise(
        F.concat_ws("/", "g", "s", "t"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    outer = (full.where("comp <> main").withColumn("s", F.pmod(F.xxhash64("rep"), F.col("s_n")))
             .withColumn("t", spread("t_n")).select(place.alias("x_block"), *[F.col(c).alias(f"x_{c}") for c in ("g", "rep", "comp", "hashes")]))
    inner = (full.withColumn("t", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("t_n")))
             .withColumn("s", spread("s_n")).select(place.alias("block"), "g", "rep", "comp", "hashes"))

    def meet(_, xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        out = []
        mine = dict(tuple(ys.groupby("g")))
        for g, x in xs.groupby("x_g"):
            y = mine.get(g)
            if y is None:
                continue
            known, y_sets = {}, [np.frombuffer(h, U64) for h in y["hashes"]]
            words, place_ = np.unique(np.concatenate(y_sets), return_inverse=True)
            bounds, sizes = starts_of([len(v) for v in y_sets]), np.array([len(v) for v in y_sets])
            y_rep, y_comp = y["rep"].to_numpy(), y["comp"].to_numpy()

            def root(c):
                while c in known:
                    c = known[c]
                return c

            for rep, comp, raw in zip(x["x_rep"], x["x_comp"], x["x_hashes"]):
                u = np.frombuffer(raw, U64)
                at = np.minimum(np.searchsorted(words, u), len(words) - 1)
                mark = np.zeros(len(words), np.int64)
                mark[at[words[at] == u]] = 1
                same = np.add.reduceat(mark[place_], bounds[:-1])
                hits = np.flatnonzero((100 * same >= PERCENT * (len(u) + sizes - same)) & (y_comp != comp))
                for i in hits:
                    p, q = root(comp), root(y_comp[i])
                    if p != q:
                        known[p] = q
                        out.append((rep, y_rep[i]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return outer.groupBy("x_block").cogroup(inner.groupBy("block")).applyInPandas(meet, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, stages: Stages, doc_id: str, text: str) -> DataFrame:
    """Pairs whose full sets satisfy the threshold."""
    ends = stages.save(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "ends")
    stored = stages.save(sets_of(ends, docs, doc_id, text), "sets")

    def meet(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                both = np.concatenate([u, v])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= PERCENT * (len(both) - same) and len(u) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    side = lambda x: stored.select(F.col("doc").alias(x), F.col("hashes").alias(f"h{x}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb")
                 .mapInArrow(meet, "a long, b long"))


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", stages=None) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Sets are distinct five-word shingles of the whole text, or the whole sequence of a shorter
    one; documents are linked with 100 * intersection >= 75 * union. A null or wordless text
    is linked with nothing (component_id = doc_id, kept). A null doc_id is linked with
    nothing either: component_id null, kept true. Rows that repeat a doc_id are grouped each by
    their own text. An empty table gives no rows.
    """
    stages = stages or Stages(docs.sparkSession, "neardup")
    signed = stages.save(signatures(docs, doc_id, text), "signatures")
    real = signed.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = stages.save(real.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")), "classes")

    bands = classes.select("rep", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)),
        lambda i: F.substring("regs", i * (2 * BAND) + 1, F.lit(2 * BAND)))).alias("band", "part"))
    keyed = stages.save(bands.select("rep", F.xxhash64("band", "part").alias("bucket")), "bands")
    shared = stages.save(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "shared")
    met = stages.save(keyed.join(shared, "bucket"), "buckets")

    # First every class meets its bucket's most central class, the one whose buckets hold most classes.
    weight = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    central = (met.join(weight, "rep").groupBy("bucket")
               .agg(F.max(F.struct("weight", F.negative("rep"), "rep")).getField("rep").alias("b")))
    star = met.join(central, "bucket").where("rep <> b").select(
        F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct()
    star = stages.save(promising(star, classes), "stars")
    links = stages.save(confirmed(star.select("a", "b"), docs, stages, doc_id, text), "links")
    parts = connected_components(links, stages)

    # Then classes that share buckets but aren't connected yet meet, block by block.
    placed = met.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(
        "bucket", "rep", F.coalesce("comp", "rep").alias("comp"))
    more = unconnected_links(several(placed), docs, stages, doc_id, text)
    links = links.unionByName(stages.save(more, "links"))
    final = connected_components(links, stages).withColumnRenamed("id", "rep")

    by_class = classes.join(final, "rep", "left").select("key", F.coalesce("comp", "rep").alias("comp"))
    return (signed.join(by_class, "key", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))

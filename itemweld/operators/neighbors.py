"""Near-neighbour joins inside (part_category, material) blocks.

A distance predicate alone would make Spark compare every pair of a block. The
band join turns it into an equi-join that loses nothing: ||x - y|| <= r implies
|x_i - y_i| <= r in every dimension, so with cells of width 2r a partner lies in
one of at most two or three cells per dimension. One side lists the cells its
ball touches, the other side has exactly one home cell, hence every pair meets
exactly once and needs no duplicate removal.

All functions take the compacted vectors of `features.compact` and their length
``size``. Three things keep a crowded block in check:
* exact copies are folded into one representative before any join (`fold_copies`),
* the cell dimensions are chosen per category from the data (`plan_bands`),
* cells that stay crowded are split over several tasks (`meet`).
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from itemweld.functions.vectors import grid_cells, l2, similarity, within
from itemweld.schema import GRID_CELL, GRID_COUNT, MATCH_DISTANCE
from itemweld.sources.staging import Stages

BLOCK = ["part_category", "material"]
MAX_BANDS = 4          # cell dimensions at most
NEAREST_BANDS = 5      # the same in a search for nearest parts
CROWDED = 4_000        # rows of one cell that one task compares with its partners
STRAGGLERS = 64        # probes that may be compared with their whole block
LSH_TABLES = 8
CELL_ROWS = 32         # rows per wanted neighbour from which a cell is searched at half its size first
LEVELS = 24            # halvings of the first radius at most
BAND_SLACK = 1e-9      # widens cells so float division cannot lose a pair at r


def vector_key() -> Column:
    """A first key for sorts by vector: arrays compare element by element, a number at once. The vector stays
    a key beside it, so equal hashes of different vectors change nothing."""
    return F.xxhash64(*BLOCK, "feature_vector")


def on_vector(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join of two tables on block and vector."""
    return (left.withColumn("vector_key", vector_key())
            .join(right.withColumn("vector_key", vector_key()), ["vector_key", *BLOCK, "feature_vector"]).drop("vector_key"))


def fold_copies(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector of a block: (rep, block, feature_vector, copies).

    Map-side combine makes a group of identical parts, however large, one row per
    map task before the shuffle.
    """
    return vectors.groupBy(vector_key().alias("vector_key"), *BLOCK, "feature_vector").agg(
        F.min("part_id").alias("rep"),
        F.count(F.lit(1)).alias("copies")).drop("vector_key")


def spread(folded: DataFrame, radius: float) -> DataFrame:
    """(part_category, dim, rows, same): the share of row pairs that fall into one
    cell of width 2 * radius, per dimension; constant dimensions are left out."""
    width = F.lit(2 * radius * (1 + BAND_SLACK))
    cells = (folded.select("part_category", F.posexplode("feature_vector").alias("dim", "z"))
             .groupBy("part_category", "dim", F.floor(F.col("z") / width).alias("cell"))
             .agg(F.count(F.lit(1)).cast("double").alias("n")))
    return (cells.groupBy("part_category", "dim")
            .agg(F.sum("n").alias("rows"),
                 (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("same"))
            .where("same < 1"))


def plan_bands(folded: DataFrame, radius: float, max_bands=MAX_BANDS, partners=4.0, measured=None) -> DataFrame:
    """(part_category, bands): the dimensions to build cells on, most selective first.

    Dimensions are added until about ``partners`` per part are expected in the
    neighbouring cells, or ``max_bands`` is reached.
    """
    share = spread(folded, radius) if measured is None else measured
    # At most one row per feature in each window group.
    order = W.partitionBy("part_category").orderBy("same", "dim")
    hit = F.log(F.least(F.lit(1.0), 2 * F.col("same")))
    before = F.sum(hit).over(order.rowsBetween(W.unboundedPreceding, -1))
    picked = (share.withColumn("place", F.row_number().over(order))
              .withColumn("expected", F.log("rows") + before)
              .where((F.col("place") <= max_bands)
                     & ((F.col("place") == 1) | (F.col("expected") > math.log(max(partners, 1e-9))))))
    return (picked.groupBy("part_category")
            .agg(F.sort_array(F.collect_list(F.struct("place", "dim"))).alias("ranked"))
            .select("part_category", F.col("ranked.dim").alias("bands")))


def likely_radius(measured: DataFrame, unit: float, k: int, blocks: float) -> float:
    """A radius at which a ball holds about k of a block's parts: the share of a
    block in a box is the product over its dimensions, and the ball in the box has
    the usual volume ratio. Only the speed depends on it."""
    per = (measured.groupBy("part_category")
           .agg(F.max("rows").alias("rows"), F.sum(F.log("same")).alias("box"), F.count(F.lit(1)).alias("d"))
           .agg(F.avg((math.log((k + 1) * blocks) - F.log("rows") - F.col("box")) / F.col("d")).alias("need"),
                F.avg("d").alias("d")).first())
    if per.need is None:
        return unit
    ball = (per.d / 2) * math.log(math.pi) - math.lgamma(per.d / 2 + 1) - per.d * math.log(2)
    return unit * math.exp(per.need - ball / per.d)


def _banded(df: DataFrame, bands: DataFrame, max_bands: int) -> DataFrame:
    out = df.join(bands.select("part_category", "bands"), "part_category", "left")
    for i in range(max_bands):
        dim = F.get("bands", F.lit(i))
        out = out.withColumn(f"_x{i}", F.when(dim.isNotNull(), F.get("feature_vector", dim)))
    return out.drop("bands")


def home_cells(df: DataFrame, bands: DataFrame, radius: float, max_bands=MAX_BANDS) -> DataFrame:
    width = F.lit(2 * radius * (1 + BAND_SLACK))
    out = _banded(df, bands, max_bands)
    for i in range(max_bands):
        out = out.withColumn(f"c{i}", F.coalesce(F.floor(F.col(f"_x{i}") / width), F.lit(0)))
    return out.drop(*[f"_x{i}" for i in range(max_bands)])


def touched_cells(df: DataFrame, bands: DataFrame, radius: float, max_bands=MAX_BANDS) -> DataFrame:
    width = F.lit(2 * radius * (1 + BAND_SLACK))
    reach = F.lit(radius * (1 + BAND_SLACK))
    out = _banded(df, bands, max_bands)
    for i in range(max_bands):
        x = F.col(f"_x{i}")
        low, high = F.floor((x - reach) / width), F.floor((x + reach) / width)
        cells = F.when(x.isNotNull(), F.sequence(low, high)).otherwise(F.array(F.lit(0).cast("bigint")))
        out = out.withColumn(f"c{i}", F.explode(cells)).drop(f"_x{i}")
    return out


def meet(left: DataFrame, right: DataFrame, keys, right_id: str, condition: Column,
         stages: Stages, crowded=CROWDED) -> DataFrame:
    """Inner equi-join for a many-to-many key, split where a key is crowded.

    Comparisons grow with the product of both sides, so a key can be far too much
    for one task while still small in bytes, where AQE sees no skew. The right rows
    of each key are counted (map-side combined); those of a crowded key are dealt
    over several parts and its left rows repeated in each, so each pair still meets
    exactly once.
    """
    heavy = (right.groupBy(*keys).count().where(F.col("count") > crowded)
             .select(*keys, F.ceil(F.col("count") / F.lit(crowded)).cast("int").alias("parts")))
    if not heavy.isEmpty():
        heavy = stages.save(heavy, "crowded")
        parts = F.coalesce(F.col("parts"), F.lit(1))
        right = (right.join(heavy, keys, "left")
                 .withColumn("part_no", F.pmod(F.xxhash64(right_id), parts).cast("int")).drop("parts"))
        left = (left.join(heavy, keys, "left")
                .withColumn("part_no", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts"))
        keys = list(keys) + ["part_no"]
    return left.join(right, list(keys)).where(condition)


def band_pairs(left: DataFrame, right: DataFrame, bands: DataFrame, radius: float, size: int,
               stages: Stages, condition: Column, max_bands=MAX_BANDS,
               crowded=CROWDED, differ=None) -> DataFrame:
    """All (a, b, block, dist <= radius); ``left`` has (a, va), ``right`` (b, vb).

    ``differ`` names a column of ``left`` that must differ in a wanted pair, for a
    join of rows with themselves: cells where it has one value are left out before
    any rows meet. (A row touches its own home cell, so the left rows of a cell
    include its right rows.)
    """
    keys = BLOCK + [f"c{i}" for i in range(max_bands)]
    l = (touched_cells(left.withColumnRenamed("va", "feature_vector"), bands, radius, max_bands)
         .withColumnRenamed("feature_vector", "va"))
    r = (home_cells(right.withColumnRenamed("vb", "feature_vector"), bands, radius, max_bands)
         .withColumnRenamed("feature_vector", "vb"))
    if differ is not None:
        mixed = stages.save(
            l.groupBy(*keys).agg(F.min(differ).alias("low"), F.max(differ).alias("high"))
             .where("low <> high").select(*keys), "mixed")
        l, r = (side.join(mixed, keys, "left_semi") for side in (l, r))
    dist = l2(F.col("va"), F.col("vb"), size)
    near = within(F.col("va"), F.col("vb"), size, radius)
    met = meet(l, r, keys, "b", condition & near, stages, crowded)
    extra = [c for c in left.columns + right.columns if c not in BLOCK + ["a", "va", "b", "vb"]]
    return met.select("a", "b", *BLOCK, *extra, dist.alias("dist"))


def _sides(folded: DataFrame):
    left = folded.select(F.col("rep").alias("a"), *BLOCK, F.col("feature_vector").alias("va"))
    right = folded.select(F.col("rep").alias("b"), *BLOCK, F.col("feature_vector").alias("vb"))
    return left, right


def folded_pairs_exact(folded: DataFrame, size: int, stages: Stages, radius=MATCH_DISTANCE,
                       bands=None, crowded=CROWDED) -> DataFrame:
    """Every pair of distinct vectors within ``radius``; nothing is missed."""
    if bands is None:
        bands = stages.save(plan_bands(folded, radius), "bands")
    left, right = _sides(folded)
    return band_pairs(left, right, bands, radius, size, stages, F.col("a") < F.col("b"), crowded=crowded)


def grid_members(folded: DataFrame, size: int, cell=GRID_CELL, count=GRID_COUNT) -> DataFrame:
    """Each vector with its cell in every one of ``count`` shifted grids."""
    shifts = F.array(*[
        F.struct(F.lit(i).alias("grid"), F.lit(cell * i / count).alias("shift")) for i in range(count)])
    return (folded.withColumn("g", F.explode(shifts))
            .select("rep", *BLOCK, "feature_vector", "copies", F.col("g.grid").alias("grid"),
                    grid_cells(F.col("feature_vector"), size, cell, F.col("g.shift")).alias("cells")))


def folded_pairs_grid(folded: DataFrame, size: int, stages: Stages, radius=MATCH_DISTANCE,
                      cell=GRID_CELL, count=GRID_COUNT, crowded=CROWDED) -> DataFrame:
    """Pairs within ``radius`` that share a cell in all dimensions on one of
    ``count`` shifted grids. Misses pairs split by every grid; kept because its
    results are the published ones.
    """
    celled = grid_members(folded, size, cell, count)
    left = celled.select(F.col("rep").alias("a"), *BLOCK, "grid", "cells", F.col("feature_vector").alias("va"))
    right = celled.select(F.col("rep").alias("b"), *BLOCK, "grid", "cells", F.col("feature_vector").alias("vb"))
    dist = l2(F.col("va"), F.col("vb"), size)
    near = within(F.col("va"), F.col("vb"), size, radius)
    met = meet(left, right, BLOCK + ["grid", "cells"], "b",
               (F.col("a") < F.col("b")) & near, stages, crowded)
    # Distances are checked first, so only true pairs reach this shuffle.
    return met.select("a", "b", *BLOCK, dist.alias("dist")).dropDuplicates(["a", "b"])


def lsh_coefficient(table: int, dim: int) -> int:
    """Fixed rule of the projections: whole numbers between -1000 and 1000."""
    return ((table + 1) * (dim + 3) * 7919 + (dim + 1) ** 2 * 104_729 + table * table * 1_299_709) % 2001 - 1000


def lsh_width(radius: float, size: int) -> int:
    """Bucket width on the scale of the projections: four radii times the usual length of a
    coefficient vector (1000 / sqrt 3 per dimension), in millionths."""
    return math.ceil(4 * radius * 1e6 * 1000 * math.sqrt(size / 3))


def lsh_signature(size: int, radius: float, tables=LSH_TABLES) -> Column:
    """The bucket of a vector in each table, as an array."""
    width = F.lit(lsh_width(radius, size))
    return F.array(*[F.floor(reduce(lambda x, y: x + y, [
        F.lit(lsh_coefficient(t, i)) * F.round(F.get("feature_vector", F.lit(i)) * 1e6).cast("bigint")
        for i in range(size)]) / width) for t in range(tables)])


def folded_pairs_lsh(folded: DataFrame, size: int, stages: Stages, radius=MATCH_DISTANCE,
                     tables=LSH_TABLES, crowded=CROWDED) -> DataFrame:
    """Pairs that share a bucket of a random projection (approximate: a subset of the exact
    ones). The projections are whole-number arithmetic on millionths with fixed
    coefficients, so the buckets are the same on every engine.

    A bucket is a slab several radii wide through its whole block, so its rows meet by cells and
    not all with all: a pair meets once, whatever the number of tables, and its signatures
    say whether it has a bucket in common.
    """
    bands = stages.save(plan_bands(folded, radius), "bands")
    hashed = stages.save(folded.select("rep", *BLOCK, "feature_vector", lsh_signature(size, radius, tables).alias("h")), "lsh")
    left = hashed.select(F.col("rep").alias("a"), *BLOCK, F.col("feature_vector").alias("va"), F.col("h").alias("ha"))
    right = hashed.select(F.col("rep").alias("b"), *BLOCK, F.col("feature_vector").alias("vb"), F.col("h").alias("hb"))
    shared = reduce(lambda x, y: x | y, [F.get("ha", F.lit(t)) == F.get("hb", F.lit(t)) for t in range(tables)])
    return (band_pairs(left, right, bands, radius, size, stages, (F.col("a") < F.col("b")) & shared, crowded=crowded)
            .select("a", "b", *BLOCK, "dist"))


def copies_of(vectors: DataFrame, folded: DataFrame) -> DataFrame:
    """(part_id, block, rep, copies): which representative stands for each part."""
    return on_vector(vectors, folded).select("part_id", *BLOCK, "rep", "copies")


def unfold_pairs(pairs: DataFrame, copies: DataFrame, stages: Stages, crowded=CROWDED) -> DataFrame:
    """The listing (a, b, part_category, material, dist, sim) over all parts.

    Its size is that of the answer, which is quadratic in the number of copies;
    grouping and counting do not use it (`rep_similarity`, `counted_pairs`).
    """
    left = copies.select(F.col("rep").alias("a"), F.col("part_id").alias("pa"))
    right = copies.select(F.col("rep").alias("b"), F.col("part_id").alias("pb"))
    across = meet(pairs.join(left, "a"), right, ["b"], "pb", F.lit(True), stages, crowded)
    many = copies.where(F.col("copies") > 1)
    within = meet(many.select(F.col("part_id").alias("pa"), "rep", *BLOCK),
                  many.select(F.col("part_id").alias("pb"), "rep"), ["rep"], "pb",
                  F.col("pa") < F.col("pb"), stages, crowded)
    columns = ["pa", "pb", *BLOCK, "dist"]
    return (across.select(*columns).unionByName(within.withColumn("dist", F.lit(0.0)).select(*columns))
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), *BLOCK,
                    "dist", similarity(F.col("dist")).alias("sim")))


def counted_pairs(pairs: DataFrame, folded: DataFrame) -> DataFrame:
    """(a, b, block, dist, pairs): each pair of distinct vectors, and each set of copies (a = b), with the
    number of pairs of parts it stands for. Counts the listing without making it."""
    n = folded.select("rep", "copies")
    across = (pairs.join(n.select(F.col("rep").alias("a"), F.col("copies").alias("na")), "a")
              .join(n.select(F.col("rep").alias("b"), F.col("copies").alias("nb")), "b")
              .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *BLOCK, "dist",
                      (F.col("na") * F.col("nb")).alias("pairs")))
    within = folded.where(F.col("copies") > 1).select(
        F.col("rep").alias("a"), F.col("rep").alias("b"), *BLOCK, F.lit(0.0).alias("dist"),
        F.expr("copies * (copies - 1) DIV 2").alias("pairs"))
    return across.unionByName(within)


def binned_pairs(folded: DataFrame, bands: DataFrame, size: int, stages: Stages, radius: float, bin_of, crowded=CROWDED) -> DataFrame:
    """(block, bin, pairs): how many pairs of parts within ``radius`` fall into each bin, copies at distance 0 included.

    As `dual_cells.count_pairs`, for blocks whose cells hold few rows: vectors move once per touched cell, and a
    pair is counted where it is met, so what is shuffled grows with the vectors and not with the pairs.
    """
    side = lambda rep, vector, copies: folded.select(
        F.col("rep").alias(rep), *BLOCK, F.col("feature_vector").alias(vector), F.col("copies").alias(copies))
    met = band_pairs(side("a", "va", "na"), side("b", "vb", "nb"), bands, radius, size, stages, F.col("a") < F.col("b"), crowded=crowded)
    across = met.groupBy(*BLOCK, bin_of(F.col("dist")).alias("bin")).agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))
    within = (folded.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in BLOCK])).where(F.col("copies") > 1)
              .groupBy(*BLOCK, bin_of(F.lit(0.0)).alias("bin")).agg(F.sum(F.expr("copies * (copies - 1) DIV 2")).alias("pairs")))
    return across.unionByName(within).groupBy(*BLOCK, "bin").agg(F.sum("pairs").alias("pairs"))


def unfold_counted(counted: DataFrame, copies: DataFrame, stages: Stages, crowded=CROWDED) -> DataFrame:
    """Every pair of parts (a, b) that the rows of `counted_pairs` stand for, with their other columns."""
    others = [c for c in counted.columns if c not in ("a", "b")]
    left = copies.select(F.col("rep").alias("a"), F.col("part_id").alias("pa"))
    right = copies.select(F.col("rep").alias("b"), F.col("part_id").alias("pb"))
    return (meet(counted.join(left, "a"), right, ["b"], "pb", (F.col("a") != F.col("b")) | (F.col("pa") < F.col("pb")), stages, crowded)
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"), *others))


def faster_partners(folded: DataFrame, wanted: DataFrame, given: DataFrame, size: int, stages: Stages, radius: float,
                    crowded=CROWDED) -> DataFrame:
    """(x, y, x_rank, y_rank, dist): every ``given`` part x with every ``wanted`` part y within ``radius`` whose rank is lower.

    ``given`` and ``wanted`` are (part_id, rep, rank), the parts of each kind. A vector meets another
    only if its lowest wanted rank is below the other's highest given rank, and parts come in
    last, by (vector, rank), so that each row of the last joins is a row of the answer.
    Parts without a rank take no part.
    """
    given, wanted = given.where("rank IS NOT NULL"), wanted.where("rank IS NOT NULL")
    best = wanted.groupBy("rep").agg(F.min("rank").alias("least"))
    worst = given.groupBy("rep").agg(F.max("rank").alias("most"))
    left = folded.join(worst, "rep").select(F.col("rep").alias("a"), *BLOCK, F.col("feature_vector").alias("va"), "most")
    right = folded.join(best, "rep").select(F.col("rep").alias("b"), *BLOCK, F.col("feature_vector").alias("vb"), "least")
    left, right = stages.save(left, "given"), stages.save(right, "wanted")
    bands = stages.save(plan_bands(right.withColumnRenamed("vb", "feature_vector"), radius), "bands")
    near = stages.save(band_pairs(left, right, bands, radius, size, stages, F.col("least") < F.col("most"), crowded=crowded)
                       .select("a", "b", "dist"), "faster")
    ranks = lambda parts, rep, name: parts.select(F.col("rep").alias(rep), F.col("rank").alias(name)).distinct()
    pairs = (near.join(ranks(given, "a", "x_rank"), "a").join(ranks(wanted, "b", "y_rank"), "b").where("y_rank < x_rank"))
    named = lambda parts, rep, name, rank: parts.select(F.col("rep").alias(rep), F.col("part_id").alias(name), F.col("rank").alias(rank))
    some = stages.save(pairs.join(named(given, "a", "x", "x_rank"), ["a", "x_rank"]), "faster")
    return (meet(some, named(wanted, "b", "y", "y_rank"), ["b", "y_rank"], "y", F.lit(True), stages, crowded)
            .select("x", "y", "x_rank", "y_rank", "dist"))


def rep_similarity(pairs: DataFrame, folded: DataFrame) -> DataFrame:
    """(rep, similarity): best similarity of a representative to any partner;
    1 where it has exact copies."""
    near = (pairs.select(F.explode(F.array("a", "b")).alias("rep"), "dist")
            .groupBy("rep").agg(similarity(F.min("dist")).alias("similarity")))
    same = folded.where(F.col("copies") > 1).select("rep", F.lit(1.0).alias("similarity"))
    return near.unionByName(same).groupBy("rep").agg(F.max("similarity").alias("similarity"))


def _first_levels(owners: DataFrame, candidates: DataFrame, bands: DataFrame, radius: float, k: int,
                  growth: float, stages: Stages, max_bands: int):
    """Probes (a, block, va, level) and the first rounds [(radius, condition of the probes that
    take part)], narrowest first. Level 0 is ``radius``; radii below it exist only as long as some
    cell holds very many rows."""
    keys = BLOCK + [f"c{i}" for i in range(max_bands)]
    counts = lambda r: home_cells(candidates, bands, r, max_bands).groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    radii = [radius]
    while len(radii) <= LEVELS and (counts(radii[-1]).agg(F.max("held")).first()[0] or 0) > CELL_ROWS * (k + 1):
        radii.append(radii[-1] / growth)
    probes = owners.select(F.col("rep").alias("a"), *BLOCK, "feature_vector")
    found = []
    for level in range(len(radii) - 1, 0, -1):
        full = counts(radii[level]).where(F.col("held") > k).select(*keys)
        here = stages.save(home_cells(probes, bands, radii[level], max_bands).join(full, keys, "left_semi").drop(*keys[len(BLOCK):]), "level")
        found.append(here.withColumn("level", F.lit(level)))
        probes = stages.save(probes.join(here.select("a"), "a", "left_anti"), "later")
    found.append(probes.withColumn("level", F.lit(0)))
    every = reduce(DataFrame.unionByName, found).withColumnRenamed("feature_vector", "va")
    rounds = [(radii[level], F.col("level") >= level) for level in range(len(radii) - 1, -1, -1)]
    return (stages.save(every, "open") if len(radii) > 1 else every), rounds


def nearest(probes: DataFrame, vectors: DataFrame, k: int, size: int, stages: Stages,
            growth=2.0, crowded=CROWDED, max_bands=NEAREST_BANDS) -> DataFrame:
    """The k nearest parts of each probe in its block: (part_id, neighbor_id, dist, rank).

    Exact, ordered by (dist, neighbor_id). The search radius grows round by round;
    a probe with k partners inside the radius is finished, so a wide radius, whose
    cells hold many parts, is only searched for the few that lie apart. Each probe starts
    at the smallest radius at which its own cell holds more than k rows, so that a dense
    cluster isn't compared with itself. Distinct
    vectors stand for all their copies: of a group of copies only the k + 1
    smallest ids can be among anyone's k nearest, and probes with the same vector
    share one search.
    """
    by_copy = W.partitionBy(vector_key(), *BLOCK, "feature_vector").orderBy("part_id")
    candidates = stages.save(
        vectors.select("part_id", *BLOCK, "feature_vector")
               .withColumn("copy_no", F.row_number().over(by_copy))
               .where(F.col("copy_no") <= k + 1).drop("copy_no"), "candidates")
    probe_vectors = probes.select("part_id", *BLOCK, "feature_vector")
    owners = stages.save(fold_copies(probe_vectors), "probes")
    right = candidates.select(F.col("part_id").alias("b"), *BLOCK, F.col("feature_vector").alias("vb"))

    # Beyond this radius a ball covers every block: root of the summed squared ranges, probes included.
    spans = candidates.select("feature_vector").unionByName(owners.select("feature_vector")).agg(*[
        (F.max(F.get("feature_vector", F.lit(i))) - F.min(F.get("feature_vector", F.lit(i)))).alias(f"s{i}")
        for i in range(size)]).first()
    widest = sum((s or 0.0) ** 2 for s in spans) ** 0.5 + 1.0
    # Any cell dimensions give the same result, so they are chosen once.
    unit = 0.25
    measured = stages.save(spread(candidates, unit), "spread")
    bands = stages.save(plan_bands(candidates, unit, max_bands, partners=0.0, measured=measured), "bands")
    blocks, categories = candidates.agg(F.count_distinct(*BLOCK), F.count_distinct("part_category")).first()
    radius = min(widest, max(unit / 8, likely_radius(measured, unit, k, blocks / max(categories, 1))))

    order = W.partitionBy("a").orderBy("dist", "b")
    rounds = []
    open_probes, early = _first_levels(owners, candidates, bands, radius, k, growth, stages, max_bands)
    while True:
        if early:
            radius, ready = early.pop(0)
        else:
            ready = F.lit(True)
        ranked = stages.save(
            band_pairs(open_probes.where(ready).drop("level"), right, bands, radius, size, stages, F.lit(True), max_bands, crowded)
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
            .select("a", "b", "dist", "place"), "ranked")
        if radius >= widest:
            rounds.append(ranked)
            break
        full = ranked.where(F.col("place") == k + 1).select("a")
        rounds.append(ranked.join(full, "a", "left_semi"))
        open_probes = stages.save(open_probes.join(full, "a", "left_anti"), "open")
        left = open_probes.count()
        if left == 0:
            break
        if early:
            continue
        # The last stragglers: go to the end when all of them together are few rows.
        radius = radius * growth if left > STRAGGLERS else widest
    found = reduce(DataFrame.unionByName, rounds)
    per_probe = copies_of(probe_vectors, owners).select("part_id", F.col("rep").alias("a"))
    final = W.partitionBy("part_id").orderBy("dist", "neighbor_id")
    return (per_probe.join(found, "a").where(F.col("part_id") != F.col("b"))
            .select("part_id", F.col("b").alias("neighbor_id"), "dist")
            .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k))

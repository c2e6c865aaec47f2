"""Cells meet cells: counting pairs by distance, and asking whether any pair is near, without forming the pairs.

Rows are gathered in cells, each with the tight box of its vectors. For two cells
the boxes give a least and a greatest distance of any two members. A pair of cells
is dropped when the least is beyond the radius and settled at once when both lead
to the same answer; only the rest is opened, level by level: a cell is halved along
its widest dimensions, a small one falls apart into its distinct vectors. Every
level is one join of stored tables, and a cell has a bounded number of parts, so
no row is repeated more than a fixed number of times.

Both bounds add up the same terms in the same order as `vectors.l2`, and rounding
keeps order, so results equal those from the single distances to the last bit.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from itemweld.functions.vectors import UNROLL, l2
from itemweld.sources.staging import Stages

HALVED = 3      # dimensions halved at a level: at most 8 parts
SMALL = 4       # distinct vectors up to which a cell falls apart into them
PER_TASK = 10_000    # pairs one task opens, each into at most 64


class Outcome(NamedTuple):
    rows: DataFrame
    compared: int       # pairs of cells (single vectors at the last level) whose boxes were compared


def _root(gaps: Column, terms, size: int) -> Column:
    """Root of the summed squares, added as in `l2`."""
    if size <= UNROLL:
        total = F.lit(0.0)
        for i, gap in enumerate(terms):
            total = gap * gap if i == 0 else total + gap * gap
        return F.sqrt(total)
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g * g))


def _bounds(size: int):
    """(least, greatest) distance between members of the boxes (lo_a, hi_a) and (lo_b, hi_b)."""
    def one(name, i):
        return F.get(name, F.lit(i))

    def gaps(*ends):
        over = F.zip_with("lo_a", "hi_b", lambda x, y: x - y)
        under = F.zip_with("lo_b", "hi_a", lambda x, y: x - y)
        return F.zip_with(over, under, lambda x, y: F.greatest(*[F.lit(e) for e in ends], x, y))

    def extents():
        over = F.zip_with("hi_a", "lo_b", lambda x, y: x - y)
        under = F.zip_with("hi_b", "lo_a", lambda x, y: x - y)
        return F.zip_with(over, under, lambda x, y: F.greatest(x, y))

    apart = [F.greatest(F.lit(0.0), one("lo_a", i) - one("hi_b", i), one("lo_b", i) - one("hi_a", i)) for i in range(min(size, UNROLL))]
    across = [F.greatest(one("hi_a", i) - one("lo_b", i), one("hi_b", i) - one("lo_a", i)) for i in range(min(size, UNROLL))]
    return _root(gaps(0.0), apart, size), _root(extents(), across, size)


def _cells(points: DataFrame, size: int, witness: bool) -> DataFrame:
    """(node, parent, n, held, lo, hi): rows with copies, distinct vectors and box of each cell;
    ``at`` is the vector of its smallest representative."""
    ends = [f(F.get("feature_vector", F.lit(i))).alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(size)]
    at = [F.min_by("feature_vector", "rep").alias("at")] if witness else []
    return (points.groupBy("node", "parent")
            .agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("held"), *ends, *at)
            .select("node", "parent", "n", "held", F.array(*[f"min{i}" for i in range(size)]).alias("lo"),
                    F.array(*[f"max{i}" for i in range(size)]).alias("hi"), *(["at"] if witness else [])))


def _parts(points: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """The points of ``cells``, each in a part of its cell."""
    dims = F.sequence(F.lit(0), F.lit(size - 1))
    widest = F.slice(F.reverse(F.array_sort(F.transform(dims, lambda i: F.struct((F.get("hi", i) - F.get("lo", i)).alias("gap"), i.alias("i"))))),
                     1, HALVED)

    def upper(cut):
        x, lo, hi = (F.get(c, cut["i"]) for c in ("feature_vector", "lo", "hi"))
        return F.when((x > (lo + hi) / 2) | (x >= hi), F.lit("1")).otherwise(F.lit("0"))

    cut = cells.select("node", "held", "lo", "hi", widest.alias("widest"))
    place = F.when(F.col("held") <= SMALL, F.concat(F.lit("/"), "rep")).otherwise(F.array_join(F.transform("widest", upper), ""))
    # A single vector keeps its name, so that names stay short.
    name = F.when(F.col("held") == 1, F.col("node")).otherwise(F.concat("node", F.lit("."), place))
    return points.drop("parent").join(cut, "node").select(
        "rep", "feature_vector", "copies", F.col("node").alias("parent"), name.alias("node"))


def _sides(cells: DataFrame, side: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(f"{c}_{side}") for c in cells.columns])


def _open(pairs: DataFrame, number: int, cells: DataFrame) -> DataFrame:
    """Pairs (a, b) replaced by the pairs of their parts; a cell with itself by each unordered pair of parts.

    The work is in the parts and not visible in bytes, so tasks are made by the number of pairs.
    """
    met = (pairs.repartition(-(-number // PER_TASK), "a", "b").join(_sides(cells, "a").withColumnRenamed("parent_a", "a"), "a")
           .join(_sides(cells, "b").withColumnRenamed("parent_b", "b"), "b"))
    return met.where((F.col("a") != F.col("b")) | (F.col("node_a") <= F.col("node_b")))


def _next(points, cells, pairs, size, stages, witness):
    """Points and cells one level below those that ``pairs`` still name."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    points = stages.save(_parts(points, cells.join(wanted, "node", "left_semi"), size), "parts")
    return points, stages.save(_cells(points, size, witness), "cells")


def count_pairs(folded: DataFrame, block, size: int, stages: Stages, radius: float, bin_of) -> Outcome:
    """(block..., bin, pairs): how many pairs of rows within ``radius`` fall into each bin.

    ``bin_of`` maps a column of distances to a bin and must not rise and fall. Rows
    stand for ``copies`` rows each, which are pairs at distance 0 among themselves.
    Rows with a null in the block take part in no pair. Without rows there is no bin.
    """
    root = F.concat_ws("\x01", *block)
    named = [F.col(c).isNotNull() for c in block]
    points = folded
    for there in named:
        points = points.where(there)
    points = points.select("rep", "feature_vector", "copies", root.alias("node"), F.lit(None).cast("string").alias("parent"), *block)
    blocks = stages.save(points.select(F.col("node").alias("root"), *block).distinct(), "blocks")
    points = stages.save(points.drop(*block), "parts")
    cells = stages.save(_cells(points, size, False), "cells")
    measured = (_sides(cells, "a").join(_sides(cells, "b"), F.col("node_a") == F.col("node_b")).withColumn("root", F.col("node_a")))
    counted, compared = [], 0
    while True:
        low, high = _bounds(size)
        same = F.col("node_a") == F.col("node_b")
        here = measured.withColumn("low", low).withColumn("high", high)
        settled = (F.col("high") <= radius) & (bin_of(F.col("low")) == bin_of(F.col("high")))
        number = F.when(same, F.expr("n_a * (n_a - 1) DIV 2")).otherwise(F.col("n_a") * F.col("n_b"))
        here = here.withColumn("kept", F.col("low") <= radius).withColumn("settled", settled)
        still = F.col("kept") & ~F.col("settled")
        # One pass: settled pairs are summed per bin before the shuffle, open ones pass through by name.
        level = stages.save(here.groupBy(
            "root", F.when(F.col("kept") & F.col("settled"), bin_of(F.col("low"))).alias("bin"),
            F.when(still, F.col("node_a")).alias("a"), F.when(still, F.col("node_b")).alias("b"))
            .agg(F.sum(F.when(F.col("kept") & F.col("settled"), number)).alias("pairs"), F.count(F.lit(1)).alias("compared")), "level")
        counted.append(level.where("bin IS NOT NULL AND pairs > 0").select("root", "bin", "pairs"))
        seen = level.agg(F.sum("compared").alias("compared"), F.count("a").alias("open")).first()
        compared += seen["compared"] or 0
        if not seen["open"]:
            break
        pairs = level.where("a IS NOT NULL").select("root", "a", "b")
        points, cells = _next(points, cells, pairs, size, stages, False)
        measured = _open(pairs, seen["open"], cells)
    every = counted[0]
    for more in counted[1:]:
        every = every.unionByName(more)
    return Outcome(every.join(blocks, "root").groupBy(*block, "bin").agg(F.sum("pairs").alias("pairs")), compared)


def linked(points: DataFrame, asked: DataFrame, size: int, stages: Stages, radius: float) -> Outcome:
    """The pairs (a, b) of ``asked`` that have members within ``radius`` of each other.

    ``points`` has (node, rep, feature_vector); ``asked`` names two different nodes a row. A
    pair leaves as soon as one witness is known: two representatives within the radius,
    or two parts that lie within it as a whole. Nodes without points are linked with nothing.
    """
    asked = asked.select("a", "b").distinct()
    points = points.select("rep", "feature_vector", F.lit(1).cast("bigint").alias("copies"), "node", F.lit(None).cast("string").alias("parent"))
    pairs = stages.save(asked.select(F.col("a").alias("ask_a"), F.col("b").alias("ask_b"), "a", "b"), "asked")
    cells = stages.save(_cells(points, size, True), "cells")
    measured = (pairs.join(_sides(cells, "a"), F.col("a") == F.col("node_a")).join(_sides(cells, "b"), F.col("b") == F.col("node_b")))
    witnessed, compared = [], 0
    while True:
        low, high = _bounds(size)
        near = (high <= radius) | (l2(F.col("at_a"), F.col("at_b"), size) <= radius)
        here = measured.withColumn("kept", low <= radius).withColumn("near", near)
        still = F.col("kept") & ~F.col("near")
        # Dropped and witnessed pairs shrink to one row per asked pair before the shuffle.
        level = stages.save(here.groupBy(
            "ask_a", "ask_b", "near", F.when(still, F.col("node_a")).alias("a"), F.when(still, F.col("node_b")).alias("b"))
            .agg(F.count(F.lit(1)).alias("compared")), "level")
        found = level.where("near").select("ask_a", "ask_b")
        witnessed.append(found)
        pairs = stages.save(level.where("a IS NOT NULL").select("ask_a", "ask_b", "a", "b")
                            .join(found, ["ask_a", "ask_b"], "left_anti"), "open")
        compared += level.agg(F.sum("compared")).first()[0] or 0
        number = pairs.count()
        if not number:
            break
        points, cells = _next(points, cells, pairs, size, stages, True)
        measured = _open(pairs, number, cells)
    every = witnessed[0]
    for more in witnessed[1:]:
        every = every.unionByName(more)
    return Outcome(every.select(F.col("ask_a").alias("a"), F.col("ask_b").alias("b")), compared)

"""Groups and best similarities without listing pairs, for crowded catalogues.

Where very many distinct vectors lie within the match distance of each other, the
list of near pairs is quadratic although the groups are not. This module gives the
same groups and the same best similarities, exactly, from a number of links that
grows with the rows:

* Micro-cells with a diagonal below the match distance: all vectors of one are
  mutual matches, so one representative stands for them.
* Micro-cells whose representatives match are linked. Other micro-cells are linked
  only by a pair of members; that is asked only for micro-cells that are near
  enough and not in one component yet, and answered by halving both cells until
  one witness is found or none can exist (`dual_cells.linked`).
  Regions that already are one component are left out before any rows meet.
* The nearest partner is searched with a radius that starts where cells are small
  and doubles: vectors that found one are done, and those that did not are, by
  that fact, few in any cell of the next size.
"""

from pyspark.sql import DataFrame, functions as F

from itemweld.functions.vectors import similarity
from itemweld.operators.components import connected_components
from itemweld.operators.dual_cells import linked
from itemweld.operators.neighbors import (
    BLOCK, CROWDED, MAX_BANDS, _sides, band_pairs, grid_members, home_cells, plan_bands)
from itemweld.schema import GRID_CELL, GRID_COUNT, MATCH_DISTANCE
from itemweld.sources.staging import Stages

CROWD_CELL = 20_000     # rows of one cell from which pairs are not listed
CROWD_WORK = 100        # cell mates per row, on average, from which they are not
COUNT_WORK = 2_000      # cell mates per row of a block from which its pairs are counted by boxes of cells
HALVINGS = 24           # below 1e-7 of the match distance, rounded vectors differ


def cell_load(folded: DataFrame, bands: DataFrame, radius: float, max_bands=MAX_BANDS):
    """(rows of the fullest cell, average number of rows in the cell of a row)."""
    keys = BLOCK + [f"c{i}" for i in range(max_bands)]
    n = F.col("count").cast("double")
    fullest, rows, mates = (home_cells(folded, bands, radius, max_bands).groupBy(*keys).count()
                            .agg(F.max("count"), F.sum(n), F.sum(n * n)).first())
    return fullest or 0, (mates / rows if rows else 0.0)


def is_crowded(folded: DataFrame, bands: DataFrame, radius: float, cell=CROWD_CELL, work=CROWD_WORK) -> bool:
    fullest, mates = cell_load(folded, bands, radius)
    return fullest > cell or mates > work


def crowded_blocks(folded: DataFrame, bands: DataFrame, radius: float, work=COUNT_WORK, max_bands=MAX_BANDS) -> DataFrame:
    """The blocks in which a row has more than ``work`` cell mates on average. In the others a join by cells makes at most
    2 ** max_bands times ``work`` comparisons a row, since those of two cells are at most the mean of both squares."""
    n = F.col("count").cast("double")
    return (home_cells(folded, bands, radius, max_bands).groupBy(*BLOCK, *[f"c{i}" for i in range(max_bands)]).count()
            .groupBy(*BLOCK).agg((F.sum(n * n) / F.sum(n)).alias("mates")).where(F.col("mates") > work).select(*BLOCK))


def grid_is_crowded(folded: DataFrame, size: int, shape=(GRID_CELL, GRID_COUNT), cell=CROWD_CELL, work=CROWD_WORK) -> bool:
    """The same question for the cells of the shifted grids."""
    n = F.col("count").cast("double")
    fullest, rows, mates = (grid_members(folded, size, *shape).groupBy(*BLOCK, "grid", "cells").count()
                            .agg(F.max("count"), F.sum(n), F.sum(n * n)).first())
    return (fullest or 0) > cell or (mates / rows if rows else 0.0) > work


def grid_blocks(folded: DataFrame, size: int, shape=(GRID_CELL, GRID_COUNT)) -> DataFrame:
    """Each cell of each shifted grid as a block of its own: every vector once per grid, named by vector and
    grid. A match by the grid method is a match inside one of these blocks."""
    place = F.concat_ws("\x01", "material", "grid", F.array_join(F.transform("cells", lambda c: c.cast("string")), ","))
    return grid_members(folded, size, *shape).select(
        F.concat_ws("\x01", "rep", "grid").alias("rep"), "part_category",
        F.when(F.col("material").isNotNull(), place).alias("material"), "feature_vector", "copies",
        F.col("rep").alias("vector"))


def grid_components(folded: DataFrame, size: int, stages: Stages, radius=MATCH_DISTANCE, shape=(GRID_CELL, GRID_COUNT),
                    crowded=CROWDED):
    """Components (id, comp) and best similarities (rep, similarity) of the grid method without its pairs: the
    components inside each grid cell, joined wherever they share a vector."""
    blocks = stages.save(grid_blocks(folded, size, shape), "grid_blocks")
    names = blocks.select("rep", "vector")
    inside = stages.save(crowd_components(blocks.drop("vector"), size, stages, radius, crowded), "inside")
    vectors = inside.join(names.withColumnRenamed("rep", "id"), "id").select("vector", "comp")
    # A component inside a cell is linked by its smallest vector, as a star.
    centre = vectors.groupBy("comp").agg(F.min("vector").alias("a"))
    links = stages.save(vectors.join(centre, "comp").select("a", F.col("vector").alias("b")).where("a <> b").distinct(), "star_links")
    comps = connected_components(links, stages)
    every = (folded.select(F.col("rep").alias("id")).join(comps, "id", "left")
             .select("id", F.coalesce("comp", "id").alias("comp")))
    best = (crowd_similarity(blocks.drop("vector"), size, stages, radius, crowded).join(names, "rep")
            .groupBy(F.col("vector").alias("rep")).agg(F.max("similarity").alias("similarity")))
    return every, best


def micro_cells(folded: DataFrame, size: int, radius: float) -> DataFrame:
    """Adds ``hub``: the smallest representative of the micro-cell."""
    side = F.lit(radius * (1 - 1e-9) / size ** 0.5)
    celled = folded.withColumn("micro", F.array(*[
        F.floor(F.get("feature_vector", F.lit(i)) / side) for i in range(size)]))
    hubs = celled.groupBy(*BLOCK, "micro").agg(F.min("rep").alias("hub"))
    return celled.join(hubs, BLOCK + ["micro"]).drop("micro")


def crowd_components(folded: DataFrame, size: int, stages: Stages, radius=MATCH_DISTANCE,
                     crowded=CROWDED) -> DataFrame:
    """(id, comp) for every distinct vector, alone or not."""
    points = stages.save(micro_cells(folded, size, radius), "micro")
    hubs = stages.save(points.where(F.col("rep") == F.col("hub")).select("rep", *BLOCK, "feature_vector"), "hubs")
    bands = stages.save(plan_bands(hubs, radius), "bands")
    left, right = _sides(hubs)
    ordered = F.col("a") < F.col("b")
    links = stages.save(
        band_pairs(left, right, bands, radius, size, stages, ordered, crowded=crowded).select("a", "b"), "links")
    comps = connected_components(links, stages)
    known = stages.save(
        hubs.select(F.col("rep").alias("id")).join(comps, "id", "left")
            .withColumn("comp", F.coalesce("comp", "id")), "comps")

    # Members of two cells can only match if the hubs are within three radii.
    far = 3 * radius
    wide = stages.save(plan_bands(hubs, far), "bands")
    tagged = hubs.join(known.withColumnRenamed("id", "rep"), "rep")
    left = tagged.select(F.col("rep").alias("a"), *BLOCK, F.col("feature_vector").alias("va"), F.col("comp").alias("ca"))
    right = tagged.select(F.col("rep").alias("b"), *BLOCK, F.col("feature_vector").alias("vb"), F.col("comp").alias("cb"))
    open_cells = stages.save(
        band_pairs(left, right, wide, far, size, stages, ordered & (F.col("ca") != F.col("cb")),
                   crowded=crowded, differ="ca").select("a", "b"), "open_cells")
    more = linked(points.withColumnRenamed("hub", "node"), open_cells, size, stages, radius).rows
    final = connected_components(links.unionByName(more), stages)
    hub_comp = (hubs.select(F.col("rep").alias("id")).join(final, "id", "left")
                .select(F.col("id").alias("hub"), F.coalesce("comp", "id").alias("comp")))
    return points.select(F.col("rep").alias("id"), "hub").join(hub_comp, "hub").select("id", "comp")


def crowd_similarity(folded: DataFrame, size: int, stages: Stages, radius=MATCH_DISTANCE,
                     crowded=CROWDED) -> DataFrame:
    """(rep, similarity) of every vector with a copy or a partner within the radius."""
    bands = stages.save(plan_bands(folded, radius, partners=0.0), "bands")
    reach = radius
    for _ in range(HALVINGS):
        if not is_crowded(folded, bands, reach, crowded):
            break
        reach /= 2
    left, right = _sides(folded.where(F.col("copies") == 1))
    _, right = _sides(folded)
    found = folded.where(F.col("copies") > 1).select("rep", F.lit(1.0).alias("similarity"))
    while True:
        near = stages.save(
            band_pairs(left, right, bands, reach, size, stages, F.col("a") != F.col("b"), crowded=crowded)
            .groupBy("a").agg(F.min("dist").alias("dist")), "near")
        found = found.unionByName(near.select(F.col("a").alias("rep"), similarity(F.col("dist")).alias("similarity")))
        if reach >= radius:
            return found
        left = stages.save(left.join(near.select("a"), "a", "left_anti"), "open")
        reach = min(radius, reach * 2)

"""Connected components and content-derived group ids."""

from pyspark.sql import DataFrame, functions as F

from itemweld.sources.staging import Stages


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u > v): link each node's larger (large star)
    or smaller (small star) neighbours to the smallest node it knows.

    The minimum is pre-aggregated map-side; the join back is many-to-one, so a hub
    is split by AQE.
    """
    if large:
        near = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(
            F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    else:
        near = edges
    low = (near.groupBy("u").agg(F.min("v").alias("m"))
           .select("u", F.least("u", "m").alias("m")))
    joined = near.join(low, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
               .unionByName(low.select("u", F.col("m").alias("v"))))
    return out.distinct()


def _settled(edges: DataFrame) -> bool:
    """True if the edges form stars around centres: each node points to one other
    at most, and no node that is pointed to points on. One combined shuffle."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("out")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    roles = ends.groupBy("node").agg(F.sum("out").alias("points"), F.min("out").alias("low"))
    return roles.where("points > 1 OR (points = 1 AND low = 0)").isEmpty()


def connected_components(edges: DataFrame, stages: Stages, a="a", b="b", max_rounds=64) -> DataFrame:
    """(id, comp) for every node with an edge; comp is the smallest id it can reach.

    Alternating large-star / small-star (Kiveris et al., SoCC 2014): O(log^2 n)
    rounds in theory, independent of the diameter in practice, and the edge list
    never grows. Each round ends in a stage table. Runs until nothing changes;
    ``max_rounds`` raises instead of returning unfinished labels.
    """
    current = stages.save(
        edges.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    for _ in range(max_rounds):
        current = stages.save(_star(_star(current, large=True), large=False), "edges")
        if _settled(current):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Settled: every edge runs from a node to the smallest node of its component.
    return (current.select(F.col("u").alias("id"), F.col("v").alias("comp"))
            .unionByName(current.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()))


def group_ids(labels: DataFrame, stages: Stages, min_size=2) -> DataFrame:
    """(comp, group_id, member_count) from (part_id, comp).

    group_id is the sha256 of "n|s0|s1|s2|s3": the member count and the sums of four
    60-bit pieces of each member id's sha256. Equal member sets get equal ids whatever the
    run or the order, for groups of every size, and the sums combine map-side.
    """
    digest = F.sha2(F.col("part_id"), 256)
    pieces = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = (labels.groupBy("comp").agg(F.count(F.lit(1)).alias("member_count"),
                                       *[F.sum(p).alias(f"s{i}") for i, p in enumerate(pieces)])
            .where(F.col("member_count") >= min_size))
    return stages.save(sums.select(
        "comp", F.sha2(F.concat_ws("|", "member_count", "s0", "s1", "s2", "s3"), 256).alias("group_id"), "member_count"), "group_ids")

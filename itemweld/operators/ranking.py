"""Ranks and exact quantiles inside very large groups.

``percent_rank() over (partition by g order by v)`` sorts a whole group in one
task. Here the distinct (g, v) values are counted with map-side combine, spread
by range over all tasks and stored; the rank of a value is then the running
count inside its range plus the total of the ranges before it.
"""

from pyspark.sql import DataFrame, Window as W, functions as F

from itemweld.sources.staging import Stages


def running_sums(df: DataFrame, group, value: str, weights: dict, stages: Stages) -> DataFrame:
    """(group..., value, and per weight w: w, w_before, w_total), one row per distinct value: the sum of each
    weight over the rows with the value, over those that sort ahead of it in the group (NULLs
    first) and over the whole group. ``weights`` maps names to columns of whole numbers."""
    group = [group] if isinstance(group, str) else list(group)
    sums = df.groupBy(*group, value).agg(*[F.sum(w).alias(name) for name, w in weights.items()])
    spread = stages.save(
        sums.repartitionByRange(*[F.col(c) for c in group + [value]])
            .withColumn("range_no", F.spark_partition_id()), "ranges")
    # One row per (group, range): bounded by the number of shuffle partitions
    # plus the number of groups, whatever the number of rows.
    ahead, every = W.partitionBy(*group).orderBy("range_no"), W.partitionBy(*group)
    ranges = spread.groupBy(*group, "range_no").agg(*[F.sum(n).alias(n) for n in weights])
    offsets = ranges.select(*group, "range_no", *[c for n in weights for c in (
        (F.sum(n).over(ahead) - F.col(n)).alias(f"{n}_offset"), F.sum(n).over(every).alias(f"{n}_total"))])
    inside = W.partitionBy(*group, "range_no").orderBy(F.col(value).asc_nulls_first())
    on = F.col("s.range_no") == F.col("o.range_no")
    for c in group:
        on = on & F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}"))
    running = spread.select("*", *[F.sum(n).over(inside.rowsBetween(W.unboundedPreceding, 0)).alias(f"{n}_upto") for n in weights])
    return running.alias("s").join(offsets.alias("o"), on).select(
        *[F.col(f"s.{c}").alias(c) for c in group + [value]], *[c for n in weights for c in (
            F.col(f"s.{n}").alias(n), (F.col(f"{n}_offset") + F.col(f"{n}_upto") - F.col(f"s.{n}")).alias(f"{n}_before"),
            F.col(f"{n}_total"))])


def value_positions(df: DataFrame, group, value: str, stages: Stages, weight=None) -> DataFrame:
    """(group..., value, n, before, total): rows with the value, rows that sort
    ahead of it in the group (NULLs first), rows of the group. ``weight`` names a column that
    says how many rows each row stands for."""
    counted = running_sums(df, group, value, {"n": F.lit(1) if weight is None else F.col(weight)}, stages)
    return counted.withColumnRenamed("n_before", "before").withColumnRenamed("n_total", "total")


def with_percent_rank(df: DataFrame, group: str, value: str, out: str,
                      stages: Stages, descending=False, weight=None) -> DataFrame:
    """Adds what ``percent_rank() over (partition by group order by value)`` gives; with a
    ``weight``, what it gives for each of the rows that a row stands for."""
    pos = value_positions(df, group, value, stages, weight)
    rank = (F.col("total") - F.col("before") - F.col("n")) if descending else F.col("before")
    ranks = pos.select(
        F.col(group).alias("_g"), F.col(value).alias("_v"),
        F.when(F.col("total") > 1, rank.cast("double") / (F.col("total") - 1))
         .otherwise(F.lit(0.0)).alias(out))
    return (df.join(ranks, F.col(group).eqNullSafe(F.col("_g"))
                    & F.col(value).eqNullSafe(F.col("_v"))).drop("_g", "_v"))


def quantiles(df: DataFrame, group: str, value: str, wanted: dict, stages: Stages) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per ``wanted`` item
    (name -> fraction), over the non-NULL values of each group."""
    pos = value_positions(df.where(F.col(value).isNotNull()), group, value, stages)
    aggs = []
    for name, fraction in wanted.items():
        at = F.lit(fraction) * (F.col("total") - 1)
        for side, point in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("before") <= point) & (point < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"{name}__{side}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"{name}__part"))
    out = pos.groupBy(group).agg(*aggs)
    return out.select(group, *[
        (F.col(f"{n}__lo") + F.col(f"{n}__part") * (F.col(f"{n}__hi") - F.col(f"{n}__lo"))).alias(n)
        for n in wanted
    ])

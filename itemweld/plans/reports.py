"""Dashboard data sets and the curated questions."""

from pyspark.sql import DataFrame, Window as W, functions as F

from itemweld.functions.vectors import distance_at, similarity as alike
from itemweld.operators.crowds import COUNT_WORK, crowded_blocks
from itemweld.operators.dual_cells import count_pairs
from itemweld.operators.neighbors import BLOCK, binned_pairs, faster_partners, plan_bands
from itemweld.sources.staging import Stages


def money(total):
    return F.round(F.coalesce(total, F.lit(0.0)), 2)


def kpi(groups: DataFrame, members: DataFrame, normalized: DataFrame) -> DataFrame:
    """One row of totals: two one-row aggregates, put side by side."""
    g = groups.agg(F.round(F.coalesce(F.sum("savings_potential"), F.lit(0.0)), 0).alias("total_savings"),
                   F.count(F.lit(1)).alias("total_groups"),
                   F.coalesce(F.sum("member_count"), F.lit(0)).alias("total_parts"))
    n = normalized.agg(F.count(F.lit(1)).alias("normalized_groups"))
    both = g.unionByName(n, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def engine_overall(metrics: DataFrame) -> DataFrame:
    tp = F.sum("dup_tp").cast("double")
    return metrics.agg(
        F.round(F.try_divide(100 * tp, F.sum("dup_total")), 1).alias("recall_pct"),
        F.round(F.try_divide(100 * tp, F.sum(F.col("dup_tp") + F.col("hn_fp") + F.col("nm_fp"))), 1)
         .alias("precision_pct"))


def by_category(groups: DataFrame) -> DataFrame:
    return (groups.groupBy("part_category")
            .agg(money(F.sum("savings_potential")).alias("savings"), F.count(F.lit(1)).alias("groups"))
            .orderBy(F.desc("savings")))


# --- Fixed values: span levels, the widest first -----------------------------
SPAN_LEVELS = [
    ("Cross-plant", "plants_spanned"),
    ("Cross-type", "machine_types_spanned"),
    ("Cross-model", "models_spanned"),
]
SPAN_REST = "Intra-model"
# ----------------------------------------------------------------------------


def by_span(groups: DataFrame) -> DataFrame:
    level = F.coalesce(*[F.when(F.col(c) > 1, name) for name, c in SPAN_LEVELS], F.lit(SPAN_REST))
    return (groups.groupBy(level.alias("span_level"))
            .agg(money(F.sum("savings_potential")).alias("savings"), F.count(F.lit(1)).alias("groups"))
            .orderBy(F.desc("savings")))


def by_status(groups: DataFrame, reviews: DataFrame) -> DataFrame:
    return (groups.select("group_id").join(reviews.select("group_id", "status"), "group_id", "left")
            .groupBy(F.coalesce("status", F.lit("new")).alias("status"))
            .agg(F.count(F.lit(1)).alias("groups")))


def eval_table(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "part_category", F.round("recall", 3).alias("recall"), F.round("precision", 3).alias("precision"),
        F.round("f1", 3).alias("f1"), "dup_tp", "dup_total", "hn_fp", "nm_fp", "coincidental_parts"
    ).orderBy("part_category")


def similarity_histogram(folded: DataFrame, size: int, stages: Stages, radius: float, work=COUNT_WORK) -> DataFrame:
    """Pairs within ``radius`` per category and percent of similarity: in crowded blocks counted by boxes of cells
    (`dual_cells.count_pairs`), in all others where vectors meet (`neighbors.binned_pairs`)."""
    percent = lambda dist: F.floor(alike(dist) * 100).cast("int")
    bands = stages.save(plan_bands(folded, radius), "bands")
    crowded = stages.save(crowded_blocks(folded, bands, radius, work), "crowded_blocks")
    counts = binned_pairs(folded.join(crowded, BLOCK, "left_anti"), bands, size, stages, radius, percent)
    if not crowded.isEmpty():
        counts = counts.unionByName(count_pairs(folded.join(crowded, BLOCK, "left_semi"), BLOCK, size, stages, radius, percent).rows)
    return (counts.groupBy("part_category", F.col("bin").alias("percent"))
            .agg(F.sum("pairs").alias("pairs")).orderBy("part_category", "percent"))


def concentration_by_machine_type(members: DataFrame) -> DataFrame:
    """Grouped parts, groups touched and share of grouped parts per machine type."""
    per = members.groupBy("machine_type").agg(
        F.count(F.lit(1)).alias("grouped_parts"), F.count_distinct("group_id").alias("groups"))
    everything = W.partitionBy()    # over one row per machine type
    return per.withColumn("share_pct", F.round(
        100.0 * F.col("grouped_parts") / F.sum("grouped_parts").over(everything), 2))


def cross_type_groups(groups: DataFrame) -> DataFrame:
    return groups.where("machine_types_spanned > 1")


def parts_dup_other_plant(members: DataFrame) -> DataFrame:
    """Parts whose group holds a part of another plant.

    A group spans two plants or it does not: no pair of members is formed.
    """
    many = (members.groupBy("group_id")
            .agg(F.min("plant_id").alias("first"), F.max("plant_id").alias("last"))
            .where("first <> last").select("group_id"))
    return members.join(many, "group_id", "left_semi").select("part_id", "group_id", "plant_id")


def similar_cross_type_faster(folded: DataFrame, copies: DataFrame, size: int, stages: Stages, parts: DataFrame,
                              models: DataFrame, offers: DataFrame, similarity=0.95,
                              wanted="Harvester", given="Tractor") -> DataFrame:
    """For every ``given`` part: ``wanted`` parts at least ``similarity`` alike
    (pair by pair) whose shortest lead time is below its own."""
    kind = parts.select("part_id", "model_id").join(models.select("model_id", "machine_type"), "model_id")
    fast = offers.groupBy("part_id").agg(F.min("lead_time_days").alias("rank"))
    known = stages.save(copies.select("part_id", "rep").join(kind, "part_id").join(fast, "part_id")
                        .where(F.col("machine_type").isin(wanted, given)), "lead_times")
    one = lambda name: known.where(F.col("machine_type") == name).select("part_id", "rep", "rank")
    # A hair wider than the similarity, which then decides.
    found = faster_partners(folded, one(wanted), one(given), size, stages, distance_at(similarity) * (1 + 1e-9))
    return (found.withColumn("sim", alike(F.col("dist"))).where(F.col("sim") >= similarity)
            .select(F.col("x").alias("part_id"), F.col("y").alias("similar_part_id"), "sim",
                    F.col("x_rank").alias("lead_time_days"), F.col("y_rank").alias("similar_lead_time_days")))

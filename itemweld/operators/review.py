"""Review state: latest action per group, reconciliation with match groups."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from itemweld.schema import HANDLED_STATUSES, REVIEW_STATUSES
from itemweld.streaming.kept_state import KeptState


def valid_reviews(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isin(REVIEW_STATUSES))


def rejected_reviews(log: DataFrame) -> DataFrame:
    return log.where(F.col("status").isNull() | ~F.col("status").isin(REVIEW_STATUSES))


REVIEW_COLUMNS = ["group_id", "updated_at", "seq", "status", "reviewer", "notes"]
ASSIGNMENT_COLUMNS = ["group_id", "assigned_at", "seq", "enterprise_part_number", "assigned_by", "notes"]


def review_state(spark: SparkSession, folder: str, schema: StructType, buckets=64) -> KeptState:
    """The latest valid action per group, and the rejected ones, of a review log."""
    return KeptState(spark, folder, schema, "group_id", ["updated_at", "seq"], REVIEW_COLUMNS,
                     accept=valid_reviews, rejected=rejected_reviews, buckets=buckets)


def valid_assignments(log: DataFrame) -> DataFrame:
    trimmed = log.withColumn("enterprise_part_number", F.trim("enterprise_part_number"))
    return trimmed.where(F.col("enterprise_part_number") != "")


def blank_assignments(log: DataFrame) -> DataFrame:
    return log.where(F.coalesce(F.trim("enterprise_part_number"), F.lit("")) == "")


def assignment_state(spark: SparkSession, folder: str, schema: StructType, buckets=64) -> KeptState:
    """The latest number per group, and the blank ones, of an assignment log."""
    return KeptState(spark, folder, schema, "group_id", ["assigned_at", "seq"], ASSIGNMENT_COLUMNS,
                     accept=valid_assignments, rejected=blank_assignments, buckets=buckets)


def normalized_parts(assignments: DataFrame, groups: DataFrame) -> DataFrame:
    """Assignments whose group still exists; its id becomes the normalised id."""
    return assignments.join(groups.select("group_id", "part_category"), "group_id").select(
        F.col("group_id").alias("normalized_part_id"), "enterprise_part_number", "part_category",
        "assigned_by", "assigned_at", "notes")


def apply_normalized_ids(parts: DataFrame, members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Parts with normalized_part_id recomputed from current state, so a withdrawn
    assignment also clears it."""
    ids = (members.select("part_id", "group_id")
           .join(assignments.select("group_id"), "group_id", "left_semi")
           .select("part_id", F.col("group_id").alias("_id")))
    return (parts.join(ids, "part_id", "left")
            .withColumn("normalized_part_id", F.col("_id")).drop("_id").select(*parts.columns))


def suppress_reviewed(groups: DataFrame, state: DataFrame) -> DataFrame:
    """Groups not handled yet."""
    handled = state.where(F.col("status").isin(HANDLED_STATUSES)).select("group_id")
    return groups.join(handled, "group_id", "left_anti")


def orphaned_reviews(state: DataFrame, groups: DataFrame) -> DataFrame:
    """Reviews of groups that are no longer produced."""
    return state.join(groups.select("group_id"), "group_id", "left_anti")

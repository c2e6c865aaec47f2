"""Keep a serving copy of the feature vectors in step with a change feed.

The feed holds inserts, updates and deletes of vectors with a version. Each run reads the new files only; a row of a
higher version replaces a lower one, whatever the order of arrival, and a delete removes the part.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from itemweld.schema import TABLES
from itemweld.streaming.kept_state import KeptState

COLUMNS = ["part_id", "version", "op", "part_category", "material", "feature_vector"]
SCHEMA = StructType([StructField("version", LongType()), StructField("op", StringType()),
                     *[StructField(f.name, f.dataType) for f in TABLES["part_features"].fields]])


def served(spark: SparkSession, folder: str, buckets=64) -> KeptState:
    """The served copy in a folder."""
    return KeptState(spark, folder, SCHEMA, "part_id", "version", COLUMNS, buckets=buckets)


def live(state: KeptState) -> DataFrame:
    return state.read().where("op <> 'delete'").drop("op")


def changes(vectors: DataFrame, old: DataFrame, version: int) -> DataFrame:
    """The feed rows that turn the served ``old`` rows into ``vectors``: new, changed and vanished parts."""
    compared = ["part_category", "material", "feature_vector"]
    now = vectors.select("part_id", F.struct(*compared).alias("now"))
    was = old.select("part_id", F.struct(*compared).alias("was"))
    op = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").otherwise("update")
    row = F.coalesce("now", "was")
    return (now.join(was, "part_id", "full").where(~F.col("now").eqNullSafe(F.col("was")))
            .select("part_id", F.lit(version).cast("bigint").alias("version"), op.alias("op"), *[row[c].alias(c) for c in compared]))


def publish(vectors: DataFrame, feed: str, state: KeptState) -> int:
    """Append to the feed what differs from the served copy; returns the version of the rows. What the feed still
    holds is worked off first, so a run that was cut off in between is made good."""
    state.sync(feed)
    old = state.read()
    version = (old.agg(F.max("version")).first()[0] or 0) + 1
    changes(vectors, old.where("op <> 'delete'"), version).write.mode("append").parquet(feed)
    return version

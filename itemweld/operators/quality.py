"""Data-quality checks: each reports, none fails the job."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from itemweld.operators.features import is_base_part
from itemweld.schema import ATTRIBUTES, FOREIGN_KEYS, PRIMARY_KEYS, TABLES


def row_counts(tables: dict) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()])


def attribute_collisions(parts: DataFrame, attributes=ATTRIBUTES) -> DataFrame:
    """Sets of base parts that agree in every attribute, as one summary row."""
    sets = (parts.where(is_base_part()).groupBy("part_category", "material", *attributes)
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return sets.agg(F.count(F.lit(1)).alias("colliding_sets"),
                    F.coalesce(F.sum("n"), F.lit(0)).alias("colliding_parts"))


def fk_integrity(tables: dict, keys=FOREIGN_KEYS) -> DataFrame:
    """Orphan rows per foreign key; distinct child values are compared, so a
    value shared by very many rows crosses the shuffle once per map task."""
    checks = []
    for child, column, parent, key in keys:
        values = (tables[child].where(F.col(column).isNotNull())
                  .groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("n")))
        known = tables[parent].select(F.col(key).alias("_k"))
        checks.append(values.join(known, "_k", "left_anti").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
            .select(F.lit(f"{child}.{column}").alias("foreign_key"), "orphan_rows"))
    return reduce(DataFrame.unionByName, checks)


def part_number_within_model(parts: DataFrame) -> DataFrame:
    """Part numbers used more than once inside one model (never a join key)."""
    return (parts.groupBy("model_id", "part_number").agg(F.count(F.lit(1)).alias("uses"))
            .where("uses > 1"))


def blocking_keys(parts: DataFrame) -> DataFrame:
    return parts.agg(
        F.count(F.lit(1)).alias("parts"),
        F.count_if(F.col("part_category").isNull()).alias("null_category"),
        F.count_if(F.col("material").isNull()).alias("null_material"))


def labels_complete(parts: DataFrame, truth: DataFrame) -> DataFrame:
    """Per category: variants, labels, variants without a label, labels without a part."""
    variants = parts.where(~is_base_part()).select("part_id", "part_category")
    marks = truth.select(F.col("variant_part_id").alias("part_id"), F.col("part_category").alias("label_category"))
    both = variants.join(marks, "part_id", "full")
    return both.groupBy(F.coalesce("part_category", "label_category").alias("part_category")).agg(
        F.count("part_category").alias("variants"), F.count("label_category").alias("labels"),
        F.count_if(F.col("label_category").isNull()).alias("unlabelled"),
        F.count_if(F.col("part_category").isNull()).alias("labels_without_part"))


def block_purity(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups that mix categories or materials (none, if blocking holds)."""
    per = (members.select("group_id", "part_id")
           .join(parts.select("part_id", "part_category", "material"), "part_id")
           .groupBy("group_id").agg(
               F.count_distinct("part_category").alias("categories"),
               F.count_distinct("material").alias("materials")))
    return per.agg(F.count(F.lit(1)).alias("groups"),
                   F.count_if((F.col("categories") > 1) | (F.col("materials") > 1)).alias("mixed_groups"))


def currencies(offers: DataFrame) -> DataFrame:
    """Offers per currency: prices are only comparable inside one."""
    return offers.groupBy("currency").agg(F.count(F.lit(1)).alias("offers"))


def review_roundtrip(valid_log: DataFrame, state: DataFrame) -> DataFrame:
    """Groups with a review on one side only, whose stored time is not the latest of
    the log, or whose other columns no log row of that time has (all zero, if the round
    trip keeps every review)."""
    facts = ["status", "reviewer", "notes"]
    want = valid_log.groupBy("group_id").agg(F.max("updated_at").alias("want"))
    logged = valid_log.select("group_id", F.col("updated_at").alias("have"), F.xxhash64(*facts).alias("said")).distinct()
    kept = (state.select("group_id", F.col("updated_at").alias("have"), F.xxhash64(*facts).alias("said"))
            .join(logged.withColumn("known", F.lit(True)), ["group_id", "have", "said"], "left"))
    both = want.join(kept, "group_id", "full")
    return both.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("have").isNull()).alias("lost"),
        F.count_if(F.col("want").isNull()).alias("invented"),
        F.count_if(F.col("want") != F.col("have")).alias("stale"),
        F.count_if(F.col("have").isNotNull() & F.col("known").isNull()).alias("altered"))


def primary_keys(tables: dict, keys=PRIMARY_KEYS) -> DataFrame:
    """Per table: declared keys that occur more than once, and their rows."""
    checks = []
    for name, df in tables.items():
        repeated = df.groupBy(*keys[name]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        checks.append(repeated.agg(F.count(F.lit(1)).alias("repeated_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_rows"))
                      .select(F.lit(name).alias("table_name"), "repeated_keys", "repeated_rows"))
    return reduce(DataFrame.unionByName, checks)


def not_null(tables: dict) -> DataFrame:
    """Null rows of every column that the schema declares as never null."""
    checks = []
    for name, df in tables.items():
        columns = [f.name for f in TABLES[name].fields if not f.nullable]
        counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        checks.append(counts.select(F.explode(F.array(*[
            F.struct(F.lit(f"{name}.{c}").alias("column_name"), F.col(c).alias("null_rows")) for c in columns])).alias("r")).select("r.*"))
    return reduce(DataFrame.unionByName, checks)

"""Per-category normalisation statistics and the normalised vector of each part."""

from pyspark.sql import Column, DataFrame, functions as F

from itemweld.schema import FEATURES


def is_base_part(part_id="part_id") -> Column:
    """Seeded variants carry a dash and a suffix; base parts have no dash."""
    return ~F.col(part_id).contains("-")


def feature_stats(parts: DataFrame, features=FEATURES, only=None) -> DataFrame:
    """(part_category, feature, mean, std) over the base parts.

    One wide aggregate with map-side combine; only its few rows, one per
    category, are turned to long form. A feature that is NULL throughout a
    category has no row.
    """
    keep = is_base_part() if only is None else only
    wide = (parts.where(keep).groupBy("part_category").agg(*[
        agg for f in features for agg in (
            F.avg(F.col(f).cast("double")).alias(f"{f}__mean"),
            F.stddev_pop(F.col(f).cast("double")).alias(f"{f}__std"))
    ]))
    long = wide.select("part_category", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"{f}__mean").alias("mean"),
                 F.coalesce(F.col(f"{f}__std"), F.lit(0.0)).alias("std"))
        for f in features
    ])))
    return long.where(F.col("mean").isNotNull())


def feature_vectors(parts: DataFrame, stats: DataFrame, features=FEATURES,
                    digits=6, keep=()) -> DataFrame:
    """(part_id, part_category, material, feature_vector).

    z = (x - mean) / std; 0 where x is NULL, std is 0 or the category has no
    statistics for the feature. ``digits`` rounds z so that the summation order
    of the statistics cannot move a part across a cell or threshold; None turns
    it off.
    """
    wide = (stats.groupBy("part_category").pivot("feature", list(features))
            .agg(F.max("mean").alias("mean"), F.max("std").alias("std")))
    joined = parts.join(wide, "part_category", "left")

    def z(f):
        mean, std = F.col(f"{f}_mean"), F.col(f"{f}_std")
        value = (F.coalesce(F.col(f).cast("double"), mean) - mean) / std
        if digits is not None:
            value = F.round(value, digits)
        return F.when(std > 0, value).otherwise(F.lit(0.0))

    return joined.select("part_id", "part_category", "material", *keep,
                         F.array(*[z(f) for f in features]).alias("feature_vector"))


def compact(vectors: DataFrame, stats: DataFrame, features=FEATURES):
    """The vectors without the dimensions that are constant in their category, and
    the common length they are padded to.

    A dimension without spread is 0 for every part of the category, so distances
    stay the same, to the last bit, while the vector that joins shuffle and compare
    shrinks from all features to the few a category has.
    """
    position = {f: i for i, f in enumerate(features)}
    number = F.create_map(*[F.lit(x) for pair in position.items() for x in pair])
    active = (stats.where(F.col("std") > 0).groupBy("part_category")
              .agg(F.sort_array(F.collect_list(number[F.col("feature")])).alias("_dims")))
    size = max(1, active.agg(F.max(F.size("_dims"))).first()[0] or 1)
    packed = F.array(*[
        F.coalesce(F.get("feature_vector", F.get("_dims", F.lit(i))), F.lit(0.0)) for i in range(size)])
    points = vectors.join(active, "part_category", "left")
    return points.select("part_id", "part_category", "material", packed.alias("feature_vector")), size

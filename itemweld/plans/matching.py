"""The match build: features -> pairs -> components -> members -> groups."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from itemweld.operators import components as C, crowds as K, economics as E, features as FT, neighbors as N
from itemweld.schema import FEATURES, MATCH_DISTANCE
from itemweld.sources.staging import Stages


@dataclass
class Match:
    """Stage tables of one build."""
    stats: DataFrame
    vectors: DataFrame
    points: DataFrame
    folded: DataFrame
    labels: DataFrame
    members: DataFrame
    groups: DataFrame


def build_features(parts: DataFrame, stages: Stages, features=FEATURES, digits=6):
    stats = stages.save(FT.feature_stats(parts, features), "feature_stats")
    vectors = stages.save(FT.feature_vectors(parts, stats, features, digits), "part_features")
    return stats, vectors


def build_points(vectors: DataFrame, stats: DataFrame, stages: Stages, features=FEATURES):
    points, size = FT.compact(vectors, stats, features)
    return stages.save(points, "points"), size


def fold(points: DataFrame, stages: Stages) -> DataFrame:
    return stages.save(N.fold_copies(points), "folded")


def find_pairs(folded: DataFrame, size: int, stages: Stages, radius=MATCH_DISTANCE, method="exact",
               bands=None) -> DataFrame:
    """Near pairs of distinct vectors."""
    if method == "grid":
        found = N.folded_pairs_grid(folded, size, stages, radius)
    else:
        found = N.folded_pairs_exact(folded, size, stages, radius, bands)
    return stages.save(found, "pairs")


def label_parts(points: DataFrame, folded: DataFrame, pairs, size: int, stages: Stages,
                radius=MATCH_DISTANCE, method="exact") -> DataFrame:
    """(part_id, comp, similarity) for every part that has a partner.

    From the near pairs, or without them (``pairs`` None) where the catalogue is too
    crowded to list them. Components run on representatives only; copies join in by
    their vector, so a group of copies adds no edges at all.
    """
    if pairs is None and method == "grid":
        comps, best = K.grid_components(folded, size, stages, radius)
    elif pairs is None:
        comps = K.crowd_components(folded, size, stages, radius)
        best = K.crowd_similarity(folded, size, stages, radius)
    else:
        comps = C.connected_components(pairs, stages)
        lone = (folded.where(F.col("copies") > 1).select(F.col("rep").alias("id"))
                .join(comps.select("id"), "id", "left_anti")
                .select("id", F.col("id").alias("comp")))
        comps = comps.unionByName(lone)
        best = N.rep_similarity(pairs, folded)
    labels = comps.withColumnRenamed("id", "rep").join(best, "rep")
    named = folded.join(labels, "rep").select(*N.BLOCK, "feature_vector", "comp", "similarity")
    return stages.save(N.on_vector(points, named).select("part_id", "comp", "similarity"), "labels")


def build_members(labels: DataFrame, parts: DataFrame, models: DataFrame, stages: Stages) -> DataFrame:
    ids = stages.save(C.group_ids(labels.select("part_id", "comp"), stages), "group_ids")
    return stages.save(
        labels.join(ids, "comp")
              .join(parts.select("part_id", "model_id"), "part_id")
              .join(models.select("model_id", "machine_type", "plant_id"), "model_id")
              .select("group_id", "part_id", "similarity", "model_id", "machine_type", "plant_id"),
        "members")


def build_groups(members: DataFrame, parts: DataFrame, offers: DataFrame, stages: Stages) -> DataFrame:
    priced = E.priced_members(members, parts, offers)
    return stages.save(
        E.match_groups(E.group_spans(members, parts), E.group_savings(priced)), "groups")


def build(parts: DataFrame, models: DataFrame, offers: DataFrame, stages: Stages,
          radius=MATCH_DISTANCE, method="exact", digits=6, features=FEATURES,
          crowd_work=K.CROWD_WORK) -> Match:
    stats, vectors = build_features(parts, stages, features, digits)
    points, size = build_points(vectors, stats, stages, features)
    folded = fold(points, stages)
    pairs = None
    if method == "grid":
        if not K.grid_is_crowded(folded, size, work=crowd_work):
            pairs = find_pairs(folded, size, stages, radius, method)
    else:
        bands = stages.save(N.plan_bands(folded, radius), "bands")
        if not K.is_crowded(folded, bands, radius, work=crowd_work):
            pairs = find_pairs(folded, size, stages, radius, bands=bands)
    labels = label_parts(points, folded, pairs, size, stages, radius, method)
    members = build_members(labels, parts, models, stages)
    groups = build_groups(members, parts, offers, stages)
    return Match(stats, vectors, points, folded, labels, members, groups)

"""Evaluation of match groups against labelled pairs."""

from pyspark.sql import DataFrame, functions as F

from itemweld.functions.vectors import l2, similarity
from itemweld.operators.ranking import quantiles, running_sums
from itemweld.sources.staging import Stages

AUTO_PRECISION, REVIEW_RECALL, LEAST_LABELS = 0.95, 0.99, 20    # of the learned cut-offs


def ground_truth(parts: DataFrame, label_of_suffix: dict) -> DataFrame:
    """Labels from the id convention <base>-<suffix letter>."""
    letters = "".join(label_of_suffix)
    tail = F.col("part_id").substr(F.length("part_id"), F.lit(1))
    label = F.create_map(*[F.lit(x) for pair in label_of_suffix.items() for x in pair])
    return parts.where(F.col("part_id").rlike(f"-[{letters}]$")).select(
        F.col("part_id").substr(F.lit(1), F.length("part_id") - 2).alias("base_part_id"),
        F.col("part_id").alias("variant_part_id"),
        label[tail].alias("relationship"), "part_category")


def pair_verdicts(truth: DataFrame, members: DataFrame) -> DataFrame:
    """Each labelled pair with ``same``: 1 if both parts are in one group."""
    base = members.select(F.col("part_id").alias("base_part_id"), F.col("group_id").alias("gb"))
    variant = members.select(F.col("part_id").alias("variant_part_id"), F.col("group_id").alias("gv"))
    return (truth.join(base, "base_part_id", "left").join(variant, "variant_part_id", "left")
            .select("base_part_id", "variant_part_id", "relationship", "part_category",
                    F.coalesce((F.col("gb") == F.col("gv")).cast("int"), F.lit(0)).alias("same")))


def coincidental(truth: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
    """Per category: grouped parts, those of a seeded duplicate pair, and the rest."""
    seeded = (truth.where("relationship = 'duplicate'")
              .select(F.explode(F.array("base_part_id", "variant_part_id")).alias("part_id")).distinct()
              .withColumn("seed", F.lit(1)))
    rows = (members.select("part_id").join(parts.select("part_id", "part_category"), "part_id")
            .join(seeded, "part_id", "left"))
    return rows.groupBy("part_category").agg(
        F.count(F.lit(1)).alias("grouped"), F.count("seed").alias("seeded"),
        (F.count(F.lit(1)) - F.count("seed")).alias("coincidental_parts"))


def metrics(truth: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
    """Recall, precision and F1 per category of ``parts``; one without labels has null
    metrics, one without groups zero recall."""
    same = F.col("same") == 1

    def hits(kind, both=True):
        cond = F.col("relationship") == kind
        return F.count_if(cond & same if both else cond)

    found = pair_verdicts(truth, members).groupBy("part_category").agg(
        hits("duplicate", False).alias("dup_total"), hits("duplicate").alias("dup_tp"),
        hits("hard_negative").alias("hn_fp"), hits("near_miss").alias("nm_fp"))
    counts = (parts.select("part_category").distinct().join(found, "part_category", "left")
              .na.fill(0, ["dup_total", "dup_tp", "hn_fp", "nm_fp"]))
    recall = F.try_divide(F.col("dup_tp").cast("double"), F.col("dup_total"))
    precision = F.try_divide(F.col("dup_tp").cast("double"),
                             F.col("dup_tp") + F.col("hn_fp") + F.col("nm_fp"))
    extra = coincidental(truth, members, parts).select("part_category", "coincidental_parts")
    return (counts.join(extra, "part_category", "left")
            .withColumn("recall", recall).withColumn("precision", precision)
            .withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"),
                                           F.col("precision") + F.col("recall")))
            .select("part_category", "recall", "precision", "f1", "dup_total", "dup_tp", "hn_fp",
                    "nm_fp", F.coalesce("coincidental_parts", F.lit(0)).alias("coincidental_parts")))


def violations(truth: DataFrame, members: DataFrame) -> DataFrame:
    """Per relationship: labelled pairs and those found in one group."""
    return pair_verdicts(truth, members).groupBy("relationship").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("same").alias("same_group"))


def gate(measured: DataFrame, recall=0.95, precision=0.95, f1=0.95) -> DataFrame:
    """Promotion gate: a category passes if all its metrics reach the targets."""
    ok = ((F.col("recall") >= recall) & (F.col("precision") >= precision) & (F.col("f1") >= f1))
    return measured.select("part_category", "recall", "precision", "f1",
                           F.coalesce(ok, F.lit(False)).alias("passed"))


def labelled_distances(truth: DataFrame, vectors: DataFrame, size: int) -> DataFrame:
    """(relationship, part_category, base, variant, dist, same_block) whatever the block."""
    block = F.struct("part_category", "material").alias
    base = vectors.select(F.col("part_id").alias("base_part_id"), F.col("feature_vector").alias("va"), block("ba"))
    variant = vectors.select(F.col("part_id").alias("variant_part_id"), F.col("feature_vector").alias("vb"), block("bb"))
    return (truth.join(base, "base_part_id").join(variant, "variant_part_id")
            .select("relationship", "part_category", "base_part_id", "variant_part_id",
                    l2(F.col("va"), F.col("vb"), size).alias("dist"), (F.col("ba") == F.col("bb")).alias("same_block")))


def threshold_calibration(truth: DataFrame, vectors: DataFrame, size: int, stages: Stages) -> DataFrame:
    """Spread of labelled distances: where a threshold can separate the kinds."""
    dist = stages.save(labelled_distances(truth, vectors, size), "labelled")
    plain = dist.groupBy("relationship").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"))
    q = quantiles(dist, "relationship", "dist", {"p50_dist": 0.5, "p99_dist": 0.99}, stages)
    return plain.join(q, "relationship")


def category_cutoffs(truth: DataFrame, vectors: DataFrame, size: int, stages: Stages,
                     precision=AUTO_PRECISION, recall=REVIEW_RECALL, labels=LEAST_LABELS) -> DataFrame:
    """(part_category, high, low, labels): similarity from which a pair is automatic and from which it goes to review.

    One sweep over the labelled distances of a category, as running sums over ranges. Labelled pairs of two
    blocks can't be candidates and are left out. ``high`` is at the
    widest distance up to which at least ``precision`` of the labelled pairs are duplicates, null if
    there is none; ``low`` at the narrowest that holds ``recall`` of the duplicates, or at ``high``
    where that reaches farther. A category with fewer than ``labels`` labelled duplicates has no row.
    """
    dist = stages.save(labelled_distances(truth, vectors, size).where("same_block"), "labelled")
    dup = (F.col("relationship") == "duplicate").cast("int")
    sums = running_sums(dist, "part_category", "dist", {"dup": dup, "every": F.lit(1)}, stages)
    hits, seen = F.col("dup_before") + F.col("dup"), F.col("every_before") + F.col("every")
    swept = sums.where(F.col("dup_total") >= labels).groupBy("part_category").agg(
        F.max(F.when(hits >= F.lit(precision) * seen, F.col("dist"))).alias("auto"),
        F.min(F.when(hits >= F.lit(recall) * F.col("dup_total"), F.col("dist"))).alias("review"),
        F.max("dup_total").alias("labels"))
    return swept.select("part_category", similarity(F.col("auto")).alias("high"),
                        similarity(F.greatest("auto", "review")).alias("low"), "labels")


def candidates(pairs: DataFrame, neighbours: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b, part_category, sim, floor): near pairs and every part's nearest neighbours, so that
    each part that has any has a candidate. ``floor`` marks the pairs that are among the
    nearest of one of their parts."""
    near = (neighbours.join(points.select("part_id", "part_category"), "part_id")
            .select(F.least("part_id", "neighbor_id").alias("a"), F.greatest("part_id", "neighbor_id").alias("b"),
                    "part_category", similarity(F.col("dist")).alias("sim"), F.lit(True).alias("floor")))
    return (pairs.select("a", "b", "part_category", "sim", F.lit(False).alias("floor")).unionByName(near)
            .groupBy("a", "b", "part_category").agg(F.max("sim").alias("sim"), F.max("floor").alias("floor")))


def flag_bands(pairs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """auto / review / drop per candidate. A category with too few labels has no cut-offs: all of it
    goes to review and ``learned`` is false."""
    sim = F.col("sim")
    band = (F.when(F.col("low").isNull(), "review").when(sim >= F.col("high"), "auto")
             .when(sim >= F.col("low"), "review").otherwise("drop"))
    return pairs.join(cutoffs, "part_category", "left").select(
        "a", "b", "part_category", "sim", "floor", band.alias("band"), F.col("low").isNotNull().alias("learned"))

"""A parts catalogue in the declared schema, derived from the sales tables.

Items are the rows of ``part``; their numeric attributes come from the item and
its order lines; machine models are the nations, plants the regions. Near copies
of some items are added by rule (`VARIANTS`), with labels, so that matching can
be evaluated. All rules are arithmetic on the item key.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from itemweld.schema import conform
from itemweld.sources.tables import read_table

# --- Fixed values -----------------------------------------------------------
LABEL_OF_SUFFIX = {
    "D": "duplicate", "E": "duplicate", "H": "hard_negative", "N": "near_miss",
}
JITTERED = ["length", "weight", "width", "thickness"]
JITTER_ADD = [3, 5, 7, 11]
JITTER_MULTIPLY = {"D": [7, 11, 13, 17], "E": [19, 23, 29, 31]}
STATUS_OF_EVENT = {
    "view": "reviewed", "purchase": "consolidated", "error": "dismissed",
    "click": "new", "signup": "archived",
}
KEY_PER_USER = 8
# ----------------------------------------------------------------------------


class SalesTables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def scan(self, name, *columns):
        return read_table(self.spark, f"{self.folder}/{name}.parquet", columns=columns)


def plants(src: SalesTables) -> DataFrame:
    return conform(src.scan("region", "r_regionkey", "r_name").select(
        F.col("r_regionkey").cast("string").alias("plant_id"),
        F.col("r_name").alias("plant_name"), F.col("r_name").alias("location"),
        F.lit("both").alias("machine_focus")), "plants")


def models(src: SalesTables) -> DataFrame:
    return conform(src.scan("nation", "n_nationkey", "n_regionkey", "n_name").select(
        F.col("n_nationkey").cast("string").alias("model_id"),
        F.col("n_regionkey").cast("string").alias("plant_id"),
        F.when(F.col("n_nationkey") % 2 == 0, "Harvester").otherwise("Tractor").alias("machine_type"),
        F.col("n_name").alias("model_name")), "models")


def suppliers(src: SalesTables) -> DataFrame:
    return conform(
        src.scan("supplier", "s_suppkey", "s_name", "s_nationkey")
           .join(src.scan("nation", "n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(src.scan("region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.col("s_suppkey").cast("string").alias("supplier_id"),
                   F.col("s_name").alias("supplier_name"), F.col("r_name").alias("region")), "suppliers")


def base_parts(src: SalesTables) -> DataFrame:
    """Base items with integer helper columns k (item key) and m (model number)."""
    lines = src.scan("lineitem", "l_partkey", "l_quantity", "l_extendedprice").groupBy("l_partkey").agg(
        F.avg("l_quantity").alias("q"),
        (F.round(F.sum("l_extendedprice"), 2) / F.count(F.lit(1))).alias("e"),
        F.count(F.lit(1)).alias("c"), F.sum("l_quantity").alias("vol"))
    k = F.col("p_partkey")
    return (src.scan("part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
            .join(lines, k == F.col("l_partkey"), "left")
            .select(
                k.alias("k"), F.pmod(k, F.lit(25)).alias("m"), k.cast("string").alias("part_id"),
                F.concat("p_brand", F.lit("-"), F.pmod(k, F.lit(200)).cast("string")).alias("part_number"),
                F.col("p_type").alias("part_category"),
                F.concat(F.lit("M"), F.pmod(k, F.lit(3)).cast("string")).alias("material"),
                F.col("p_size").cast("double").alias("length"),
                F.col("p_retailprice").alias("weight"),
                F.when(F.col("p_type") != "SMALL", F.col("q")).alias("width"),
                F.when(F.pmod(k, F.lit(37)) != 0, F.col("e")).alias("thickness"),
                F.col("c").cast("int").alias("hole_count"),
                F.when(F.col("p_type") == "ECONOMY", 1).alias("conductor_count"),
                F.col("vol").cast("int").alias("annual_volume")))


def with_variants(base: DataFrame) -> DataFrame:
    """Base items and their variants, in one pass: -D and -E near duplicates, -H
    functional hard negatives, -N other material."""
    k = F.col("k")

    def mod(n, at):
        return F.pmod(k, F.lit(n)) == at

    rule = F.array_compact(F.array(
        F.lit(""), F.when(mod(20, 0), "D"), F.when(mod(60, 0), "E"),
        F.when(mod(50, 7), "H"), F.when(mod(100, 11), "N")))
    v = base.withColumn("suffix", F.explode(rule))
    kind = F.col("suffix")

    def jitter(column, i):
        def factor(s):
            return 1 + (F.pmod(k * JITTER_MULTIPLY[s][i] + JITTER_ADD[i], F.lit(41)) - 20) / 20000
        out = (F.when(kind == "D", F.col(column) * factor("D"))
                .when(kind == "E", F.col(column) * factor("E")).otherwise(F.col(column)))
        small = F.col("part_category") == "SMALL"
        if column == "width":
            out = F.when((kind == "H") & ~small, F.col(column) * 1.5).otherwise(out)
        if column == "thickness":
            out = F.when((kind == "H") & small, F.col(column) * 1.5).otherwise(out)
        return out

    return v.select(
        "k",
        F.when(kind == "D", F.pmod(F.col("m") + 1 + F.pmod(k * 7, F.lit(24)), F.lit(25)))
         .when(kind == "E", F.pmod(F.col("m") + 5, F.lit(25))).otherwise(F.col("m")).alias("m"),
        F.when(kind == "", F.col("part_id")).otherwise(F.concat("part_id", F.lit("-"), "suffix")).alias("part_id"),
        "part_number", "part_category",
        F.when(kind == "N", F.concat("material", F.lit("x"))).otherwise(F.col("material")).alias("material"),
        *[jitter(c, i).alias(c) for i, c in enumerate(JITTERED)],
        "hole_count", "conductor_count",
        F.when(kind == "D", 5 + F.pmod(k * 31, F.lit(395)))
         .when(kind == "E", 5 + F.pmod(k * 37, F.lit(395)))
         .otherwise(F.col("annual_volume")).cast("int").alias("annual_volume"))


def parts(src: SalesTables) -> DataFrame:
    both = with_variants(base_parts(src)).withColumn("model_id", F.col("m").cast("string"))
    both = both.withColumn("description", F.concat_ws(
        ", ", F.concat_ws(" ", "material", "part_category"), F.concat(F.lit("PN "), "part_number")))
    return conform(both, "parts")


def base_offers(src: SalesTables) -> DataFrame:
    return (src.scan("lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
            .groupBy("l_partkey", "l_suppkey").agg(
                F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_per_unit"),
                F.max("l_discount").alias("unit_discount"))
            .select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"),
                    "price_per_unit", "unit_discount",
                    (7 * (1 + F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(6)))).cast("int").alias("lead_time_days"),
                    F.element_at(F.array(*[F.lit(g) for g in "ABC"]),
                                 (F.pmod(F.col("l_partkey") + 2 * F.col("l_suppkey"), F.lit(3)) + 1).cast("int"))
                     .alias("material_quality_grade")))


def offers(src: SalesTables, catalogue: DataFrame) -> DataFrame:
    """Offers of base items from their order lines; a variant is offered, at its
    own price, by those of the item's suppliers that sit in the region of the
    variant's plant and have a balance above 5000 (so some variants have none)."""
    base = base_offers(src)
    own = base.withColumn("part_id", F.col("k").cast("string"))
    local = (src.scan("supplier", "s_suppkey", "s_nationkey", "s_acctbal").where("s_acctbal > 5000")
             .join(src.scan("nation", "n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
             .select(F.col("s_suppkey").alias("s"), F.col("n_regionkey").alias("region_no")))
    plant = src.scan("nation", "n_nationkey", "n_regionkey").select(
        F.col("n_nationkey").cast("string").alias("model_id"), F.col("n_regionkey").alias("region_no"))
    copies = (catalogue.where(F.col("part_id").contains("-")).select("part_id", "model_id")
              .withColumn("k", F.split("part_id", "-")[0].cast("bigint"))
              .join(plant, "model_id").drop("model_id"))
    factor = 0.8 + F.pmod(F.col("k") * 19 + F.col("s") * 7, F.lit(41)) / 100
    theirs = (base.join(copies, "k").join(local, ["s", "region_no"])
              .withColumn("price_per_unit", F.col("price_per_unit") * factor).drop("region_no"))
    both = own.unionByName(theirs)
    return conform(both.withColumn("supplier_id", F.col("s").cast("string"))
                       .withColumn("currency", F.lit("USD")), "supplier_catalogs")


def review_log(src: SalesTables, members: DataFrame) -> DataFrame:
    """Review actions, one per event: (group_id, status, reviewer, notes, updated_at, seq).

    Event user u acts on the group that holds item 8u; an item in no group gives
    the id its single-member list would have, i.e. a group no longer produced.
    """
    status = F.create_map(*[F.lit(x) for pair in STATUS_OF_EVENT.items() for x in pair])
    acts = src.scan("events", "event_id", "ts", "user_id", "event_type", "value").select(
        (F.col("user_id") * KEY_PER_USER).cast("string").alias("part_id"),
        status[F.col("event_type")].alias("status"),
        F.concat(F.lit("reviewer-"), F.col("user_id").cast("string")).alias("reviewer"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("notes"),
        F.col("ts").cast("timestamp").alias("updated_at"), F.col("event_id").alias("seq"),
        "event_type", "value")
    return (acts.join(members.select("part_id", "group_id"), "part_id", "left")
            .withColumn("group_id", F.coalesce("group_id", F.sha2("part_id", 256))))


def assignment_log(log: DataFrame) -> DataFrame:
    """Number assignments, from purchases; amounts under 10 leave the number blank."""
    number = F.when(F.col("value") < 10, F.lit("   ")).otherwise(
        F.concat(F.lit("  EPN-"), "part_id", F.lit("-"), F.col("seq").cast("string"), F.lit(" ")))
    return log.where("event_type = 'purchase'").select(
        "group_id", number.alias("enterprise_part_number"), F.col("reviewer").alias("assigned_by"),
        F.col("updated_at").alias("assigned_at"), "notes", "seq")

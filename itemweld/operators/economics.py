"""Prices, spend, savings and span of match groups."""

from pyspark.sql import DataFrame, functions as F

from itemweld.functions.money import net_price


def one_currency(offers: DataFrame, currency=None) -> DataFrame:
    """Offers whose prices are comparable: those in ``currency``, or all of them if there is
    only one. Several currencies without a choice raise."""
    if currency is not None:
        return offers.where(F.col("currency") == currency)
    if offers.agg(F.count_distinct("currency").alias("n")).first()[0] > 1:
        raise ValueError("offers in several currencies: name the one to compare")
    return offers


def member_best_price(offers: DataFrame) -> DataFrame:
    return offers.groupBy("part_id").agg(F.min(net_price()).alias("member_best"))


def priced_members(members: DataFrame, parts: DataFrame, offers: DataFrame) -> DataFrame:
    """Members with their best price and volume. The offers are cut down to
    grouped parts before they are aggregated."""
    ids = members.select("part_id")
    best = member_best_price(
        offers.select("part_id", "price_per_unit", "unit_discount").join(ids, "part_id", "left_semi"))
    return (members
            .join(parts.select("part_id", "annual_volume"), "part_id", "left")
            .join(best, "part_id", "left"))


def group_savings(priced: DataFrame) -> DataFrame:
    """Spend and what buying everything at the group's best price would save.

    Only priced members count: a member without an offer has no spend to save.
    """
    volume = F.col("annual_volume").cast("double")
    bought = F.when(F.col("member_best").isNotNull(), volume)
    return (priced.groupBy("group_id").agg(
                F.min("member_best").alias("group_best_price"),
                F.sum(F.col("member_best") * volume).alias("total_current_spend"),
                F.sum(bought).alias("group_volume"))
            .withColumn("savings_potential",
                        F.col("total_current_spend") - F.col("group_volume") * F.col("group_best_price")))


def group_spans(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Span of each group. Category and material are constant in a group (blocking),
    so they are grouping keys: with a minimum of strings among the aggregates Spark
    would have to sort instead of hash."""
    # First one row per place of a group, so that the distinct counts expand few rows.
    places = (members.join(parts.select("part_id", "part_category", "material"), "part_id")
              .groupBy("group_id", "part_category", "material", "model_id", "machine_type", "plant_id")
              .agg(F.count(F.lit(1)).alias("n"), F.sum("similarity").alias("s"), F.count("similarity").alias("c")))
    return places.groupBy("group_id", "part_category", "material").agg(
        F.sum("n").alias("member_count"),
        F.count_distinct("model_id").alias("models_spanned"),
        F.count_distinct("machine_type").alias("machine_types_spanned"),
        F.count_distinct("plant_id").alias("plants_spanned"),
        F.try_divide(F.sum("s"), F.sum("c")).alias("avg_similarity"))


def match_groups(spans: DataFrame, savings: DataFrame) -> DataFrame:
    return spans.join(savings, "group_id").select(
        "group_id", "part_category", "material", "member_count", "models_spanned",
        "machine_types_spanned", "plants_spanned", "avg_similarity",
        "group_best_price", "total_current_spend", "savings_potential")


def best_offers(offers: DataFrame) -> DataFrame:
    """One row per (supplier_id, part_id): the cheapest of repeated offers. A least struct is found by
    sorting, and a part has fewer offers than a supplier, so it comes first."""
    return (offers.withColumn("net_price", net_price())
            .groupBy("part_id", "supplier_id")
            .agg(F.min(F.struct("net_price", "price_per_unit", "unit_discount", "lead_time_days",
                                "currency", "material_quality_grade")).alias("o"))
            .select("supplier_id", "part_id", "o.*"))


def offer_price_gap(members: DataFrame, offers: DataFrame) -> DataFrame:
    """Each offer of a grouped part with its distance to the best of the group.

    The group minimum is an aggregate joined back, not a window, so a very large
    group is not gathered in one task.
    """
    rows = (members.select("group_id", "part_id").join(best_offers(offers), "part_id")
            .select("group_id", "part_id", "supplier_id", "net_price", "lead_time_days"))
    best = rows.groupBy("group_id").agg(F.min("net_price").alias("best_price"))
    return rows.join(best, "group_id").withColumn("price_gap", F.col("net_price") - F.col("best_price"))


def group_price_leadtime_gap(members: DataFrame, offers: DataFrame) -> DataFrame:
    rows = members.select("group_id", "part_id").join(
        offers.select("part_id", "lead_time_days", net_price().alias("net_price")), "part_id")
    return rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("offer_count"),
        (F.max("net_price") - F.min("net_price")).alias("price_gap"),
        (F.max("lead_time_days") - F.min("lead_time_days")).alias("lead_time_gap"))


def savings_by_plant(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """Savings attributed to the plant that buys each member."""
    best = groups.select("group_id", "group_best_price")
    saved = (F.col("member_best") - F.col("group_best_price")) * F.col("annual_volume").cast("double")
    return (priced.join(best, "group_id").groupBy("plant_id").agg(
        F.count(F.lit(1)).alias("grouped_parts"),
        F.coalesce(F.sum(saved), F.lit(0.0)).alias("savings_potential")))


def rationalization_progress(parts: DataFrame, members: DataFrame, normalized: DataFrame) -> DataFrame:
    """Share of the catalogue that is grouped and that has an enterprise number."""
    flags = (parts.select("part_id")
             .join(members.select("part_id", F.lit(1).alias("grouped")), "part_id", "left")
             .join(normalized.where(F.col("normalized_part_id").isNotNull())
                   .select("part_id", F.lit(1).alias("done")), "part_id", "left"))
    total, grouped, done = F.count(F.lit(1)), F.count("grouped"), F.count("done")
    return flags.agg(
        total.alias("parts"), grouped.alias("grouped_parts"), done.alias("normalized_parts"),
        (100.0 * grouped / total).alias("grouped_pct"), (100.0 * done / total).alias("normalized_pct"))


def sku_supplier_reduction(members: DataFrame, offers: DataFrame) -> DataFrame:
    """Per group: items and suppliers today against one item from one supplier."""
    suppliers = (members.select("group_id", "part_id")
                 .join(offers.select("part_id", "supplier_id"), "part_id")
                 .groupBy("group_id").agg(F.count_distinct("supplier_id").alias("suppliers")))
    items = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("items"))
    both = items.join(suppliers, "group_id", "left").withColumn(
        "suppliers", F.coalesce("suppliers", F.lit(0)))
    return both.agg(
        F.sum("items").alias("items_before"), F.count(F.lit(1)).alias("items_after"),
        (F.sum("items") - F.count(F.lit(1))).alias("items_saved"),
        F.sum("suppliers").alias("supplier_links_before"),
        F.sum(F.greatest(F.col("suppliers") - 1, F.lit(0))).alias("supplier_links_saved"))

"""Read models, the filtered review queue and the group detail."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from itemweld.functions.money import net_price
from itemweld.operators.economics import best_offers, priced_members
from itemweld.schema import QUEUE_PAGE, QUEUE_PAGE_MAX, QUEUE_SORTS

GROUP_COLUMNS = [
    "group_id", "part_category", "material", "member_count", "models_spanned",
    "machine_types_spanned", "plants_spanned", "avg_similarity", "group_best_price",
    "total_current_spend", "savings_potential",
]


def serve_match_groups(groups: DataFrame) -> DataFrame:
    return groups.select(*GROUP_COLUMNS)


def serve_members(members: DataFrame, parts: DataFrame, offers: DataFrame) -> DataFrame:
    info = parts.select("part_id", "part_number", "description")
    return (priced_members(members, parts, offers).join(info, "part_id")
            .select("group_id", "part_id", "part_number", "description", "model_id", "machine_type",
                    "plant_id", "similarity", F.col("member_best").alias("member_best_price"),
                    "annual_volume"))


def serve_supplier_offers(offers: DataFrame, suppliers: DataFrame, members: DataFrame) -> DataFrame:
    """Offers of grouped parts; of repeated ones of a supplier the cheapest."""
    return (best_offers(offers.join(members.select("part_id"), "part_id", "left_semi"))
            .join(suppliers.select("supplier_id", "supplier_name"), "supplier_id")
            .select("part_id", "supplier_name", "price_per_unit", "unit_discount",
                    "lead_time_days", "currency"))


def queue(groups: DataFrame, members: DataFrame, offers: DataFrame, reviews: DataFrame,
          assignments: DataFrame, *, part_category=None, material=None, machine_type=None,
          spans_models=False, spans_machine_types=False, spans_plants=False, model=None,
          plant=None, supplier=None, min_savings=None, min_similarity=None,
          min_group_size=None, status=None, normalized=None) -> DataFrame:
    """The review queue: all given filters are AND-combined, none is required.

    ``members`` and ``offers`` are the serving models. Filters on the group's own
    columns come first, so the semi joins see fewer groups.
    """
    own = {
        "part_category": lambda v: F.col("part_category") == v,
        "material": lambda v: F.col("material") == v,
        "min_savings": lambda v: F.col("savings_potential") >= v,
        "min_similarity": lambda v: F.col("avg_similarity") >= v,
        "min_group_size": lambda v: F.col("member_count") >= v,
    }
    given = {"part_category": part_category or None, "material": material or None,
             "min_savings": min_savings, "min_similarity": min_similarity,
             "min_group_size": min_group_size}
    tests = [test(given[name]) for name, test in own.items() if given[name] is not None]
    for flag, column in ((spans_models, "models_spanned"),
                         (spans_machine_types, "machine_types_spanned"),
                         (spans_plants, "plants_spanned")):
        if flag:
            tests.append(F.col(column) > 1)
    out = groups.select(*GROUP_COLUMNS)
    if tests:
        out = out.where(reduce(lambda x, y: x & y, tests))
    for value, column in ((machine_type, "machine_type"), (model, "model_id"), (plant, "plant_id")):
        if value:
            out = out.join(members.where(F.col(column) == value).select("group_id"), "group_id", "left_semi")
    if supplier:
        sold = offers.where(F.col("supplier_name") == supplier).select("part_id")
        out = out.join(members.join(sold, "part_id", "left_semi").select("group_id"), "group_id", "left_semi")
    out = (out.join(reviews.select("group_id", F.col("status").alias("review_status")), "group_id", "left")
              .join(assignments.select("group_id", "enterprise_part_number",
                                       F.lit(True).alias("assigned")), "group_id", "left"))
    if status == "new":
        out = out.where(F.coalesce("review_status", F.lit("new")) == "new")
    elif status:
        out = out.where(F.col("review_status") == status)
    if normalized == "yes":
        out = out.where(F.col("assigned").isNotNull())
    elif normalized == "no":
        out = out.where(F.col("assigned").isNull())
    return out.select(
        *GROUP_COLUMNS, F.coalesce("review_status", F.lit("new")).alias("status"),
        F.col("assigned").isNotNull().alias("normalized"), "enterprise_part_number")


def queue_page(rows: DataFrame, sort="savings_potential", direction="desc",
               limit=QUEUE_PAGE, offset=0) -> DataFrame:
    """One page: an unknown sort falls back to savings, the size is kept in 1..500."""
    column = F.col(sort if sort in QUEUE_SORTS else QUEUE_SORTS[0])
    order = column.asc_nulls_last() if str(direction).lower() == "asc" else column.desc_nulls_last()
    size = max(1, min(int(limit), QUEUE_PAGE_MAX))
    return rows.orderBy(order, "group_id").offset(int(offset)).limit(size)


def queue_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"))


def default_queue(groups, members, offers, reviews, assignments) -> DataFrame:
    """The opening view: new groups that span more than one model."""
    return queue(groups, members, offers, reviews, assignments, status="new", spans_models=True)


def group_header(groups, reviews, assignments, group_id=None) -> DataFrame:
    out = groups if group_id is None else groups.where(F.col("group_id") == group_id)
    rv = reviews.select("group_id", F.col("status").alias("s"), "reviewer", "notes", "updated_at")
    na = assignments.select("group_id", "enterprise_part_number", "assigned_by", "assigned_at",
                            F.col("notes").alias("normalize_notes"))
    return (out.join(rv, "group_id", "left").join(na, "group_id", "left")
            .withColumn("status", F.coalesce("s", F.lit("new"))).drop("s"))


def group_members_view(members: DataFrame, group_id=None) -> DataFrame:
    """Members of one group, or of all of them group by group, best match first."""
    out = members if group_id is None else members.where(F.col("group_id") == group_id)
    return out.orderBy("group_id", F.col("similarity").desc_nulls_last(), "part_number", "part_id")


def group_offers_view(members: DataFrame, offers: DataFrame, group_id=None) -> DataFrame:
    out = members if group_id is None else members.where(F.col("group_id") == group_id)
    return (out.select("group_id", "part_id", "part_number").join(offers, "part_id")
            .withColumn("net_price", net_price())
            .orderBy("group_id", F.col("net_price").asc_nulls_last(), "part_id", "supplier_name"))


def filter_options(groups: DataFrame, members: DataFrame, offers: DataFrame) -> DataFrame:
    """Distinct values behind the filter controls, as (filter, value)."""
    lists = (("part_category", groups, "part_category"), ("material", groups, "material"),
             ("model", members, "model_id"), ("plant", members, "plant_id"),
             ("supplier", offers, "supplier_name"))
    rows = [df.select(F.lit(name).alias("filter"), F.col(column).alias("value")).distinct()
            for name, df, column in lists]
    return reduce(DataFrame.unionByName, rows).orderBy("filter", "value")

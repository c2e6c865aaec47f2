"""Declared table schemas and the parameters that define the results."""

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Order of the numeric features inside a vector.
FEATURES = [
    "weight", "material_density", "length", "width", "thickness", "diameter",
    "inner_diameter", "outer_diameter", "nominal_diameter",
    "cross_section_diameter", "head_width", "gauge", "thread_pitch",
    "tensile_strength", "hardness", "pressure_rating", "load_rating",
    "temperature_rating", "hole_count", "voltage_rating", "conductor_count",
]

# Nullable attribute columns of the parts table, in table order.
ATTRIBUTES = [
    "length", "width", "thickness", "diameter", "inner_diameter",
    "outer_diameter", "nominal_diameter", "cross_section_diameter",
    "head_width", "gauge", "thread_pitch", "tensile_strength", "hardness",
    "pressure_rating", "load_rating", "temperature_rating", "hole_count",
    "voltage_rating", "conductor_count",
]
INTEGER_ATTRIBUTES = ["hole_count", "conductor_count"]

MATCH_DISTANCE = 0.12
GRID_CELL = 0.3
GRID_COUNT = 3

REVIEW_STATUSES = ["new", "reviewed", "consolidated", "dismissed"]
HANDLED_STATUSES = ["reviewed", "consolidated", "dismissed"]
QUEUE_SORTS = [
    "savings_potential", "avg_similarity", "member_count", "models_spanned",
    "total_current_spend",
]
QUEUE_PAGE = 100
QUEUE_PAGE_MAX = 500
# ----------------------------------------------------------------------------


def _struct(*fields):
    kinds = {
        "s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(),
        "t": T.TimestampType(), "v": T.ArrayType(T.DoubleType()),
    }
    out = []
    for field in fields:
        name, kind = field.rsplit(":", 1)
        out.append(T.StructField(name.rstrip("*"), kinds[kind], not name.endswith("*")))
    return T.StructType(out)


def _attribute_fields():
    return [f"{a}:{'i' if a in INTEGER_ATTRIBUTES else 'd'}" for a in ATTRIBUTES]


# A trailing * marks a column that must not be NULL.
TABLES = {
    "plants": _struct("plant_id*:s", "plant_name:s", "location:s", "machine_focus:s"),
    "models": _struct("model_id*:s", "plant_id*:s", "machine_type*:s", "model_name:s"),
    "parts": _struct(
        "part_id*:s", "model_id*:s", "part_number*:s", "part_category*:s",
        "material*:s", "material_density:d", "weight:d", "description:s",
        *_attribute_fields(), "normalized_part_id:s", "annual_volume:i",
    ),
    "suppliers": _struct("supplier_id*:s", "supplier_name:s", "region:s"),
    "supplier_catalogs": _struct(
        "supplier_id*:s", "part_id*:s", "price_per_unit:d", "unit_discount:d",
        "lead_time_days:i", "currency:s", "material_quality_grade:s",
    ),
    "ground_truth": _struct(
        "base_part_id*:s", "variant_part_id*:s", "relationship*:s", "part_category:s",
    ),
    "normalized_parts": _struct(
        "normalized_part_id*:s", "enterprise_part_number:s", "part_category:s",
        "assigned_by:s", "assigned_at:t", "notes:s",
    ),
    "feature_stats": _struct("part_category:s", "feature:s", "mean:d", "std:d"),
    "part_features": _struct("part_id*:s", "part_category:s", "material:s", "feature_vector:v"),
    "match_groups": _struct(
        "group_id*:s", "part_category:s", "material:s", "member_count:i",
        "models_spanned:i", "machine_types_spanned:i", "plants_spanned:i",
        "avg_similarity:d", "group_best_price:d", "total_current_spend:d",
        "savings_potential:d", "generated_at:t",
    ),
    "match_group_members": _struct(
        "group_id*:s", "part_id*:s", "similarity:d", "model_id:s",
        "machine_type:s", "plant_id:s",
    ),
    "eval_metrics": _struct(
        "part_category:s", "recall:d", "precision:d", "f1:d", "dup_total:i",
        "dup_tp:i", "hn_fp:i", "nm_fp:i", "coincidental_parts:i", "evaluated_at:t",
    ),
    "review_dispositions": _struct(
        "group_id*:s", "status*:s", "reviewer:s", "notes:s", "updated_at*:t",
    ),
    "normalized_assignments": _struct(
        "group_id*:s", "enterprise_part_number*:s", "assigned_by:s",
        "assigned_at*:t", "notes:s",
    ),
}

PRIMARY_KEYS = {
    "plants": ["plant_id"],
    "models": ["model_id"],
    "parts": ["part_id"],
    "suppliers": ["supplier_id"],
    "supplier_catalogs": ["supplier_id", "part_id"],
    "ground_truth": ["variant_part_id"],
    "match_groups": ["group_id"],
    "match_group_members": ["group_id", "part_id"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("models", "plant_id", "plants", "plant_id"),
    ("parts", "model_id", "models", "model_id"),
    ("supplier_catalogs", "supplier_id", "suppliers", "supplier_id"),
    ("supplier_catalogs", "part_id", "parts", "part_id"),
    ("ground_truth", "base_part_id", "parts", "part_id"),
    ("ground_truth", "variant_part_id", "parts", "part_id"),
    ("parts", "normalized_part_id", "normalized_parts", "normalized_part_id"),
]


def conform(df, table):
    """Select and cast by name to a declared schema; missing columns are NULL.

    Writes go through here, so a column order or type slip in the producer
    cannot end up in the wrong column of the table.
    """
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in TABLES[table].fields
    ])

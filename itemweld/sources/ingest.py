"""Raw supplier or plant catalogues brought to the parts schema."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from itemweld.schema import conform


def ingest(feeds) -> DataFrame:
    """Union of raw feeds in the parts schema.

    ``feeds`` is a list of (DataFrame, {column of parts: SQL expression over the
    feed}). A feed maps only what it has; the rest is NULL. Map-only.
    """
    mapped = [df.select(*[F.expr(e).alias(c) for c, e in mapping.items()]) for df, mapping in feeds]
    union = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), mapped)
    return conform(union, "parts")


def brand_feeds(src):
    """The item table as four plants would deliver it: own column names, units and
    types, one without weights."""
    part = src.scan("part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice").withColumn(
        "brand_no", F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int"))
    north = part.where("brand_no <= 6").selectExpr(
        "p_partkey AS item", "p_brand AS brand", "p_type AS kind", "p_size AS length_mm", "p_retailprice AS weight")
    south = part.where("brand_no BETWEEN 7 AND 12").selectExpr(
        "p_partkey AS item_no", "p_brand AS maker", "p_type AS family", "p_size / 25.4D AS length_in",
        "p_retailprice / 1000D AS weight_t")
    east = part.where("brand_no BETWEEN 13 AND 18").selectExpr(
        "string(p_partkey) AS ref", "upper(p_brand) AS brand", "lower(p_type) AS type",
        "string(p_size) AS len", "string(p_retailprice) AS mass")
    west = part.where("brand_no > 18").selectExpr(
        "p_partkey AS id", "p_brand AS brand", "p_type AS category", "p_size AS size")
    return [
        (north, {"part_id": "concat('N', item)", "part_number": "brand", "part_category": "kind",
                 "length": "length_mm", "weight": "weight"}),
        (south, {"part_id": "concat('S', item_no)", "part_number": "maker", "part_category": "family",
                 "length": "length_in * 25.4D", "weight": "weight_t * 1000D"}),
        (east, {"part_id": "concat('E', ref)", "part_number": "initcap(brand)", "part_category": "upper(type)",
                "length": "double(len)", "weight": "double(mass)"}),
        (west, {"part_id": "concat('W', id)", "part_number": "brand", "part_category": "category",
                "length": "size"}),
    ]

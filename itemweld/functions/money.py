"""Price expressions."""

from pyspark.sql import Column, functions as F


def net_price(price="price_per_unit", discount="unit_discount") -> Column:
    return F.col(price) * (F.lit(1.0) - F.coalesce(F.col(discount), F.lit(0.0)))

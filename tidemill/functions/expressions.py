"""Column expressions that queries share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def net_price() -> Column:
    """A line item's price after its discount."""
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def cents(amount: Column) -> Column:
    """An amount in whole cents, so that sums don't depend on their order; null if it is no number or too large for a long."""
    scaled = F.floor(amount * 100 + 0.5)
    return F.when(F.abs(amount) < 9e16, scaled.cast("long"))


def json_number(text: Column, path: str) -> Column:
    """A whole number in JSON text, or null, also where the text is no JSON or the value no whole number."""
    return F.get_json_object(text, path).try_cast("long")


def url_part(url: Column, part: str) -> Column:
    """A part of a url, or null where it has none or is malformed."""
    return F.try_parse_url(url, F.lit(part))

"""Sort keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAME_DIGITS = 16


def name_key(qname: Column) -> Column:
    """The first 16 digits after the last ASCII letter of a read name, as a number.

    Names without letters skip their first character; no digits give 0.
    """
    tail = F.when(qname.rlike("[A-Za-z]"), F.regexp_extract(qname, "(?s)^.*[A-Za-z](.*)$", 1)).otherwise(F.substring(qname, 2, 1 << 30))
    digits = F.substring(F.regexp_replace(tail, "[^0-9]", ""), 1, NAME_DIGITS)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def sort_key(order: str) -> Column:
    if order not in ("coordinate", "queryname"):
        raise ValueError(f"order is coordinate or queryname, not {order}")
    return F.col("pos") if order == "coordinate" else name_key(F.col("qname"))

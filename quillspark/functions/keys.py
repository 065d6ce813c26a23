"""Keys written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def project_number(col: Column) -> Column:
    """The number in an id written as `123`, `123.0`, `1.23E+2`, `1,234` or with white space around.

    Null where there is no whole number in it.
    """
    bare = F.regexp_replace(col, r"[\s ,]+", "")
    whole = F.when(bare.rlike(r"^\d{1,18}$"), bare.try_cast("bigint"))
    num = F.when(bare.rlike(r"^\d+(\.\d*)?([eE][+-]?\d{1,2})?$"), bare.try_cast("decimal(38,6)"))
    return F.coalesce(whole, F.when(num == F.floor(num), num.try_cast("bigint")))

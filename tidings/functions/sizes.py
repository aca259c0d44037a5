"""Row-size estimates, used to check a side before it is broadcast."""

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FIXED_BYTES = 16  # slot and hash-table share of one column


def row_bytes(df: DataFrame) -> Column:
    """Upper estimate of a row's size once it sits in a hashed relation."""
    text = [
        F.coalesce(F.octet_length(field.name), F.lit(0))
        for field in df.schema
        if isinstance(field.dataType, StringType)
    ]
    return reduce(add, text, F.lit(FIXED_BYTES * (len(df.columns) + 1))).cast("long")

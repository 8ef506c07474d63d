"""Small plan helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_table(spark, rows, schema: str) -> DataFrame:
    """A fixed lookup table (connector names, transition matrix): constant size, safe to broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def iso(ts_col) -> Column:
    """FN-22: timestamp → ISO-8601 text with milliseconds and ``Z`` (session time zone is UTC)."""
    c = F.col(ts_col) if isinstance(ts_col, str) else ts_col
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def join_sorted(arr) -> Column:
    """Order-insensitive text form of a string array (for comparable outputs)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.array_join(F.array_sort(c), ",")

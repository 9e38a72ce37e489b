"""Joins with a side that is usually small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is sent to all tasks.
SMALL_ROWS = 200_000


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", bound: int = SMALL_ROWS) -> DataFrame:
    """Join that broadcasts ``small`` after counting that it has at most ``bound`` rows, and shuffles both sides otherwise.

    ``small`` should be cheap to count, such as a table that was written before.
    """
    if small.limit(bound + 1).count() <= bound:
        return left.join(F.broadcast(small), on, how)
    return left.join(small, on, how)

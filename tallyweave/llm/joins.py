"""Joins on keys that a third of all rows may share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than this part of all rows are joined without a shuffle; there can't be more of them.
MAX_HOT_KEYS = 10_000


def join_counted(rows: DataFrame, figures: DataFrame, keys: Sequence[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with one row of figures per key.

    ``figures`` has the number of rows of each key in column ``n``, and ``total`` is the number of all rows. Keys
    with more than a ten-thousandth of them are at most MAX_HOT_KEYS, so they are broadcast and their rows stay
    where they are; the others are joined as Spark chooses.
    """
    keys = list(keys)
    limit = total // MAX_HOT_KEYS
    hot = figures.filter(F.col(n) > limit)
    rare = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(figures.filter(F.col(n) <= limit), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rare)

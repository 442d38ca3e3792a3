"""A stored order-statistic index of listings: id ranges with their counts, made once per snapshot.

For every listing (the rows of one group) the index holds ranges of the sorted ids: lowest and highest id, rows, and
rows of the listing before it. The rank of a row is then the rows before its range plus its place inside, so a page,
however deep, needs the index and the rows of one range or two. Nothing of the listing itself is written.

Boundaries come from quantile sketches, which Spark merges map-side, so a listing with most of all rows is spread
like any other. They decide how even ranges are; counts and ranks are exact. Gaps and outliers among ids do no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.session import settle

#: Rows that a range should hold, as long as its listing has no more than COARSE * FINE ranges.
RANGE_ROWS = 100_000
COARSE, FINE = 32, 32


def _place(bounds: Column, value: Column) -> Column:
    """The number of sorted bounds below a value, found in two steps."""
    count = lambda part: F.size(F.filter(part, lambda b: b < value))
    coarse = F.transform(F.sequence(F.lit(FINE - 1), F.lit(COARSE * FINE - 1), F.lit(FINE)), lambda i: F.element_at(bounds, i + 1))
    block = F.least(count(coarse), F.lit(COARSE - 1))
    return block * FINE + count(F.slice(bounds, block * FINE + 1, FINE))


def build_index(listed: DataFrame, id_col: str, groups: Sequence[str] = (), range_rows: int = RANGE_ROWS) -> DataFrame:
    """(groups, low, high, rows, before, total): a row for each range of each listing; ids are unique and not null."""
    groups, most = list(groups), COARSE * FINE
    ids = listed.select(*groups, F.col(id_col).cast("long").alias("_id"))
    quantiles = F.percentile_approx("_id", [(i + 1) / most for i in range(most)], 10 * most)
    figures = ids.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"), F.min("_id").alias("low"), F.max("_id").alias("high"))
    figures = settle(figures, "listing-sizes")
    small = figures.filter(F.col("total") <= range_rows).select(*groups, "low", "high", F.col("total").alias("rows"), F.lit(0).cast("long").alias("before"), "total")
    if not figures.filter(F.col("total") > range_rows).limit(1).count():
        return small
    large = figures.filter(F.col("total") > range_rows).select(*groups, "total")
    if groups:
        bounds = ids.join(large, groups).groupBy(*groups, "total").agg(quantiles.alias("bounds"))
        placed = ids.join(settle(bounds, "listing-bounds"), groups)
    else:  # a single listing: its bounds are one short array
        bounds = ids.agg(quantiles).first()[0]
        placed = ids.withColumns({"bounds": F.lit(list(bounds)), "total": F.lit(large.first().total).cast("long")})
    # fewer ranges than bounds: neighbouring ones are one range
    wide = F.ceil(F.lit(most) * F.lit(range_rows) / F.col("total"))
    ranges = placed.withColumn("_range", F.floor(_place(F.col("bounds"), F.col("_id")) / wide)).groupBy(*groups, "total", "_range").agg(
        F.min("_id").alias("low"), F.max("_id").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    earlier = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = ranges.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    return small.unionByName(counted.select(small.columns))


def write_index(index: DataFrame, path: str) -> None:
    """Store the index of a snapshot."""
    index.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def live_ranges(index: DataFrame, first: int, last: int) -> DataFrame:
    """The ranges that hold ranks from ``first`` to ``last``."""
    return index.filter((F.col("before") < last) & (F.col("before") + F.col("rows") >= first))


def slice_all(
    listed: DataFrame, index: DataFrame, id_col: str, groups: Sequence[str], first: int, last: int, rank: str, total: str
) -> DataFrame:
    """The rows of every listing whose rank lies in [first, last]; only rows of live ranges are ranked."""
    groups = list(groups)
    named = {"low": "_low", "high": "_high", "before": "_before", "total": "_total"}
    live = settle(live_ranges(index, first, last).select(*groups, *[F.col(a).alias(b) for a, b in named.items()]), "live-ranges")
    held = listed.join(live, groups).filter(F.col(id_col).between(F.col("_low"), F.col("_high")))
    inside = Window.partitionBy(*groups, "_before").orderBy(id_col)
    ranked = held.withColumn(rank, F.col("_before") + F.row_number().over(inside).cast("long")).filter(F.col(rank).between(first, last))
    return ranked.withColumn(total, F.col("_total")).drop(*named.values())


def slice_one(listed: DataFrame, index: DataFrame, id_col: str, first: int, last: int) -> DataFrame:
    """The rows of one listing whose rank lies in [first, last]; ``index`` holds that listing alone.

    The id bounds of the ranges that hold the slice reach the scan as filters.
    """
    figures = live_ranges(index, first, last).agg(F.min("low"), F.max("high"), F.min("before")).first()
    if figures[0] is None:
        return listed.limit(0)
    held = listed.filter(F.col(id_col).between(F.lit(figures[0]), F.lit(figures[1])))
    # as many rows as a page are kept of each partition before they meet
    reached = held.orderBy(id_col).limit(last - figures[2])
    return reached.offset(first - 1 - figures[2]) if first - 1 > figures[2] else reached

"""Exact ranks and quotas over groups of any size.

A plain ``row_number() over (partition by label)`` sends a whole label to one task. Here every
group is cut into as many ordered buckets as its size calls for; the bucket counts (a small table) are
prefix-summed, and rows are numbered only inside their bucket. The result equals the plain sort, row
for row, while a task never sorts more than about one bucket.

The count tables (per group, per bucket) are stored as soon as a helper is called. Spark then knows
their size when it plans the join with the rows: a small one is broadcast and the rows are not
shuffled for it, a large one is joined by shuffling.

Orders are derived from ``md5(seed:key)``, never from a process random generator, so a retried
task or another partitioning gives the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import settle

# Rows one task should sort. Groups up to this size are a single bucket.
BUCKET_ROWS = 1 << 20
# Lower bound for the finer buckets of a quota or a page, so that counting them stays cheap.
FINEST_BUCKET_ROWS = 1 << 10
# Buckets finer than BUCKET_ROWS are made only up to this many per group (16^4), so that the counts
# of a group with 1e11 rows stay a small table.
MOST_FINE_DIGITS = 4


def shuffle_key(seed: object, *parts: Column | str) -> Column:
    """The reproducible random order key ``md5(seed:part:part...)``."""
    texts = [F.lit(str(seed))] + [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *texts))


def uniform(seed: object, *parts: Column | str) -> Column:
    """A reproducible draw in [0, 1) from the first 32 bits of the same hash."""
    return F.conv(F.substring(shuffle_key(seed, *parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def group_sizes(df: DataFrame, groups: Sequence[str], size: str) -> DataFrame:
    """Rows per group: a map-side combined count."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias(size))


def _with_group(df: DataFrame, groups: Sequence[str], **figures: Column) -> DataFrame:
    """Attach figures of the row's group; without groups those of the whole table, as a scalar subquery."""
    aggregates = [value.alias(name) for name, value in figures.items()]
    if groups:
        return df.join(settle(df.groupBy(*groups).agg(*aggregates), "group-figures"), list(groups))
    whole = df.agg(F.struct(*aggregates).alias("figures")).scalar()
    return df.withColumn("_figures", whole).select("*", "_figures.*").drop("_figures")


def _by_hash(sized: DataFrame, key: Column, rows: Column | int) -> DataFrame:
    """Buckets by the leading hex digits of the hash, as many digits as the group's ``_total`` needs."""
    digits_for = lambda size: F.ceil(F.log(16.0, F.col("_total") / size))
    fine = digits_for(rows if isinstance(rows, Column) else F.lit(rows))
    most = F.greatest(F.lit(MOST_FINE_DIGITS), digits_for(F.lit(BUCKET_ROWS)))
    digits = F.greatest(F.least(fine, most), F.lit(0)).cast("int")
    return sized.withColumn("_key", key).withColumn("_bucket", F.substring("_key", F.lit(1), digits))


def _by_id(df: DataFrame, id_col: str, groups: Sequence[str], rows: int) -> DataFrame:
    """Ranges of the sorted (groups, id), cut by Spark at sampled boundaries, so that gaps and outliers among the
    ids do not matter. The ranges are stored: the boundaries of a second run need not be the same."""
    sized = _with_group(df, groups, _total=F.count(F.lit(1)))
    whole = df.count()
    ranges = max(1, min(-(-whole // rows), max(16**MOST_FINE_DIGITS, -(-whole // BUCKET_ROWS))))
    ordered = sized.repartitionByRange(ranges, *groups, F.col(id_col).cast("long"))
    return settle(ordered.withColumn("_bucket", F.spark_partition_id()), "ranges")


def _offsets(bucketed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, _bucket, _size, _offset): rows in the bucket and in earlier buckets of the group.

    The window runs over bucket counts, not over rows of the data.
    """
    sizes = bucketed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*(groups or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    return sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))


def _number(bucketed: DataFrame, offsets: DataFrame, groups: Sequence[str], order: Sequence[str], rank: str) -> DataFrame:
    inside = Window.partitionBy(*groups, "_bucket").orderBy(*order)
    return bucketed.join(settle(offsets, "bucket-offsets"), [*groups, "_bucket"]).withColumn(
        rank, F.col("_offset") + F.row_number().over(inside).cast("long")
    )


def _finish(df: DataFrame, total: str | None, *extra: str) -> DataFrame:
    kept = df.withColumnRenamed("_total", total) if total else df.drop("_total")
    return kept.drop("_bucket", "_offset", "_size", *extra)


def shuffled_rank(
    df: DataFrame, key: Column, tie: str, groups: Sequence[str] = (), rank: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based rank of every row by (key, tie) within its group (no null groups), optionally with the group's size."""
    bucketed = _by_hash(_with_group(df, groups, _total=F.count(F.lit(1))), key, BUCKET_ROWS)
    ranked = _number(bucketed, _offsets(bucketed, groups), groups, ["_key", tie], rank)
    return _finish(ranked, total, "_key")


def id_rank(df: DataFrame, id_col: str, groups: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """1-based rank by a unique non-null 64-bit id within its group (no null groups)."""
    bucketed = _by_id(df, id_col, groups, BUCKET_ROWS)
    return _finish(_number(bucketed, _offsets(bucketed, groups), groups, [id_col], rank), None)


def id_slice(
    df: DataFrame, id_col: str, groups: Sequence[str], first: int, last: int, rank: str = "rank", total: str | None = None
) -> DataFrame:
    """Rows whose id rank within the group lies in [first, last]; other buckets are dropped before the sort."""
    fine = min(BUCKET_ROWS, max(FINEST_BUCKET_ROWS, last - first + 1))
    bucketed = _by_id(df, id_col, groups, fine)
    live = _offsets(bucketed, groups).filter(
        (F.col("_offset") < last) & (F.col("_offset") + F.col("_size") >= first)
    )
    ranked = _number(bucketed, live, groups, [id_col], rank)
    return _finish(ranked.filter(F.col(rank).between(first, last)), total)


def take_quota(
    pool: DataFrame, quotas: DataFrame, groups: Sequence[str], quota: str, key: Column, tie: str, rank: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """The first ``quota`` rows by (key, tie) of every group listed in ``quotas``.

    Buckets are about as large as the quota, and those that start beyond it are removed by a join
    before any sorting, so little more than the wanted rows is shuffled. ``total`` names a column of
    ``quotas`` with the sizes of the groups where they are known already.
    """
    wanted = quotas.select(*groups, F.col(quota).cast("long").alias("_quota"), *([F.col(total).alias("_total")] if total else []))
    if total is None:
        wanted = settle(wanted.join(group_sizes(pool, groups, "_total"), list(groups)), "group-figures")
    fine = F.least(F.lit(BUCKET_ROWS), F.greatest(F.lit(FINEST_BUCKET_ROWS), F.col("_quota")))
    bucketed = _by_hash(pool.join(wanted, list(groups)), key, fine)
    live = _offsets(bucketed, groups).join(wanted.drop("_total"), list(groups)).filter(F.col("_offset") < F.col("_quota"))
    ranked = _number(bucketed, live.drop("_quota"), groups, ["_key", tie], rank)
    return _finish(ranked.filter(F.col(rank) <= F.col("_quota")), None, "_key", "_quota")

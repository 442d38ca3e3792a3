"""Which of many prefixes begin a text: one sorted pass, without pairing texts with prefixes.

In sorted order all texts that begin with a prefix follow it directly, so the prefixes of a text
are found by looking at the nearest prefix before it: either that one begins the text, or what it
shares with the text holds every other. Prefixes therefore carry the chain of prefixes they
begin with themselves, and a text keeps the part of the chain that fits.

Order is cut into ranges by Spark; inside a range a window looks back, and the last prefix of the
ranges before comes from a table of one row per range. No task holds more than a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.ranking import BUCKET_ROWS
from tallyweave.session import settle


def carry_down(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], mark: Column, name: str, own: bool = True, rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add the greatest ``mark`` of the rows up to this one (before it, unless ``own``) in its group's order.

    For marks that grow along the order that is the nearest one; rows with a null mark look back only. Rows that are equal
    in ``order`` must not differ in their marks, as they have no order among themselves.
    """
    ranges = max(1, -(-df.count() // rows))
    # stored: the sampled boundaries of a second run need not be the same
    cut = settle(
        df.withColumn("_mark", mark).repartitionByRange(ranges, *groups, *order).withColumn("_range", F.spark_partition_id()),
        "prefix-ranges",
    )
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range and group: the window runs over ranges, not over rows
    carried = settle(
        cut.groupBy(*groups, "_range").agg(F.max("_mark").alias("_last")).withColumn("_carried", F.max("_last").over(before)),
        "prefix-carried",
    ).drop("_last")
    inside = Window.partitionBy(*groups, "_range").orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    nearest = F.greatest("_carried", F.max("_mark").over(inside))
    return cut.join(carried, [*groups, "_range"]).withColumn(name, nearest).drop("_mark", "_range", "_carried")


def prefix_chains(prefixes: DataFrame, groups: Sequence[str], prefix: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """Every distinct prefix of a group with the array ``chain`` of prefixes that begin it, itself last.

    Candidates are cut from a prefix only at lengths that occur and within what it shares with the prefix
    before it in order, so few are made however long the texts are. Null and empty prefixes and rows of null groups are left out.
    """
    usable = F.col(prefix) != ""
    for g in groups:
        usable = usable & F.col(g).isNotNull()
    distinct = settle(prefixes.filter(usable).select(*groups, prefix).distinct(), "prefixes")
    # at most as many lengths as the longest text has characters
    lengths = distinct.agg(F.array_sort(F.collect_set(F.length(prefix))).alias("lengths")).scalar()
    looked = carry_down(distinct, groups, [prefix], F.col(prefix), "_before", own=False, rows=rows)
    shared = F.filter(
        F.col("_lengths"),
        lambda n: (n < F.length(prefix)) & (F.substring(prefix, F.lit(1), n) == F.substring("_before", F.lit(1), n)),
    )
    cuts = (
        looked.filter(F.col("_before").isNotNull())
        .withColumn("_lengths", lengths)
        .select(*groups, F.col(prefix).alias("_whole"), F.explode(shared).alias("_length"))
        .select(*groups, "_whole", F.substring("_whole", F.lit(1), F.col("_length")).alias(prefix))
    )
    above = (
        cuts.join(distinct, [*groups, prefix], "left_semi")
        .groupBy(*groups, "_whole")
        # bounded by the number of lengths; prefixes of one text sort by their length
        .agg(F.array_sort(F.collect_set(prefix)).alias("_above"))
        .withColumnRenamed("_whole", prefix)
    )
    nothing = F.array().cast("array<string>")
    chain = F.concat(F.coalesce("_above", nothing), F.array(prefix))
    return distinct.join(above, [*groups, prefix], "left").select(*groups, prefix, chain.alias("chain"))


def prefixes_of(
    texts: DataFrame, prefixes: DataFrame, groups: Sequence[str], text: str, prefix: str, found: str = "found", rows: int = BUCKET_ROWS
) -> DataFrame:
    """The texts that begin with a prefix of their group, with the array ``found`` of all of them, the shortest first.

    Texts need not be distinct. Texts that are null or begin with no prefix, and rows of null groups, are left out.
    """
    chains = prefix_chains(prefixes, groups, prefix, rows)
    mark = F.struct(F.col("_text").alias("prefix"), F.col("_chain").alias("chain"))
    usable = F.col(text).isNotNull()
    for g in groups:
        usable = usable & F.col(g).isNotNull()
    both = texts.filter(usable).withColumns({"_text": F.col(text), "_kind": F.lit(1)}).unionByName(
        chains.select(*groups, F.col(prefix).alias("_text"), F.lit(0).alias("_kind"), F.col("chain").alias("_chain")),
        allowMissingColumns=True,
    )
    swept = carry_down(both, groups, ["_text", "_kind"], F.when(F.col("_kind") == 0, mark), "_near", rows=rows)
    fitting = F.filter(F.col("_near.chain"), lambda p: F.startswith(F.col("_text"), p))
    hit = swept.filter("_kind = 1").withColumn(found, fitting).filter(F.size(found) > 0)
    return hit.select(*texts.columns, found)

"""Mixing sources to target weights.

The words of a source, in a pseudorandom order of its documents, form one long run that is packed into
blocks of a fixed length. Every output shard draws its source for each slot (a multinomial draw in
proportion to the targets); the n-th slot of a source over all shards takes the block that a
pseudorandom permutation of the block numbers names, and a new round begins once all blocks were taken.
Slots drawn beyond a source's quota go to the sources that were drawn too seldom, so that the totals meet
the targets to within a block. Slots and blocks are joined by (source, block number).

Defined results: a null text has no words; documents without words are never taken; sources go by code
point with null last; a null id is an id like any other; repeated rows are taken like different
documents; an empty table gives an empty result. All draws derive from md5 of a seed, so reruns agree
whatever the partitioning. Only the columns id, text and source are read; others are carried by
``mix_documents`` under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 16384
#: Documents of a source are placed in this many ordered buckets (three hex digits of their hash).
BUCKET_DIGITS = 3
#: Cells that the draw's number line is cut into, so that a draw finds its source by an equi-join.
CELLS = 1024
PASSES = 3
PRIME = 2147483647


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hashed(*parts) -> Column:
    """Sixty pseudorandom bits of the given columns and texts."""
    key = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block_words=BLOCK_WORDS) -> DataFrame:
    """One row per source: its number, size, target in words, blocks and the slots it shall get (quota).

    ``sizes`` has source and size. Works on one row per source, after a map-side aggregation.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighted = (
        ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("fill", F.col("cap").cast("double") / F.col("weight"))
    )
    order = Window.orderBy("fill", "sid")
    everything = Window.partitionBy(F.lit(1))
    levels = weighted.select(
        "*",
        F.row_number().over(order).alias("place"),
        (F.sum("cap").over(order) - F.col("cap")).alias("full"),
        (F.sum("weight").over(everything) - F.sum("weight").over(order) + F.col("weight")).alias("open"),
        F.sum("source_size").over(everything).alias("all_size"),
    ).withColumn("level", (F.col("all_size") * share - F.col("full")) / F.col("open"))
    fits = F.when(F.col("level") <= F.col("fill"), F.struct("place", "level"))
    levelled = levels.withColumn("common", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.col("common") * F.col("weight"))
    blocks = F.ceil(F.col("source_size") / F.lit(block_words)).cast("long")
    quota = F.least(blocks * most, F.floor(blocks * F.col("target") / F.nullif(F.col("source_size"), F.lit(0)) + 0.5)).cast("long")
    placed = (
        levelled.withColumn("target", target).withColumn("blocks", blocks)
        .withColumn("quota", F.coalesce(quota, F.lit(0).cast("long")))
    )
    until = F.sum("quota").over(Window.orderBy("sid"))
    return placed.select(
        "source", "sid", "source_size", "target", "blocks", "quota",
        (until - F.col("quota")).alias("low"), until.alias("high"), F.sum("quota").over(everything).alias("slots"),
    )


def placed_words(sizes: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """``sizes`` with ``sid`` and ``start``: where the document's words begin in its source's run.

    The order is by hash. Prefix sums go over bucket totals first, then inside each bucket, so that a
    source of any size is summed by many tasks.
    """
    keyed = sizes.join(sources.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = keyed.withColumn("ord", hashed(seed, id_text)).withColumn("bucket", F.shiftright("ord", 60 - 4 * BUCKET_DIGITS))
    totals = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket"))
    until = F.sum("in_bucket").over(Window.partitionBy("sid").orderBy("bucket"))
    firsts = totals.select(F.col("sid").alias("_sid"), F.col("bucket").alias("_bucket"), (until - F.col("in_bucket")).alias("first"))
    inside = F.sum("size").over(
        Window.partitionBy("sid", "bucket").orderBy("ord", "doc_id", "size", "text_hash")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        keyed.withColumn("inside", inside - F.col("size"))
        .join(firsts, (F.col("sid") == F.col("_sid")) & (F.col("bucket") == F.col("_bucket")))
        .withColumn("start", F.col("first") + F.col("inside"))
        .drop("_sid", "_bucket", "first", "inside", "bucket", "ord")
    )


def _within(rows: DataFrame, value: str, line: DataFrame, span: Column) -> DataFrame:
    """``rows`` joined with the interval [low, high) of ``line`` that holds ``value``, by cells of the line."""
    cell = F.floor(span / CELLS).cast("long") + 1
    low, high = F.expr("cast(low div cell as long)"), F.expr("cast((high - 1) div cell as long)")
    cut = line.filter("high > low").withColumn("cell", cell).withColumn("part", F.explode(F.sequence(low, high))).drop("cell")
    numbered = rows.withColumn("_part", F.expr(f"`{value}` div cell"))
    return numbered.join(cut, (F.col("_part") == F.col("part")) & (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high"))).drop("_part", "part", "low", "high", "cell")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _quotient(x: Column, y: Column) -> Column:
    return ((x - x % y) / y).cast("long")


def permuted(i: Column, n: Column, key: Column, side: Column, width: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``key``, sends ``i``.

    ``side`` and ``width`` are those of the largest rectangle with no more than n cells. Each pass shifts
    the numbers around the circle, then mixes the rectangle by two Feistel rounds; numbers outside the
    rectangle are reached by the next pass.
    """

    def one_pass(last: Column, j: Column) -> Column:
        inner = (key * (j * 2 + 3) + j * 12345) % 1073741824

        def mixed(x: Column) -> Column:
            return ((x % 1073741824 + inner) * (x % 1073741824 + inner)) % PRIME

        def rounds(t: Column) -> Column:
            left = (_quotient(t, width) + mixed(t % width)) % side
            return F.when(t < side * width, _let(left, lambda x: x * width + (t % width + mixed(x)) % width)).otherwise(t)

        return _let((last + (key * (j + 7)) % n) % n, rounds)

    return F.aggregate(F.array(*[F.lit(j).cast("long") for j in range(PASSES)]), i, one_pass)


def dealt_slots(sources: DataFrame, seed: str, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per output slot: shard, slot, sid, repeat, block."""
    spark = sources.sparkSession
    total = sources.agg(F.max("slots")).first()[0] or 0
    # numbers are read as longs throughout; the line of quotas is as long as there are slots
    slots = spark.range(total).select(
        F.col("id").alias("slot"), F.expr(f"id div {shard_slots}").alias("shard"),
        (hashed(seed, "slot", F.col("id").cast("string")) % F.lit(max(total, 1))).alias("point"),
        (F.floor(F.lit(total) / CELLS).cast("long") + 1).alias("cell"),
    )
    line = sources.select("sid", "low", "high")
    drawn = _within(slots, "point", line, F.lit(total)).select("shard", "slot", "sid")
    counts = settle(drawn.groupBy("sid", "shard").agg(F.count("*").alias("n")), "drawn")
    before = counts.select(
        "sid", "shard", (F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")).alias("before")
    )
    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    quotas = sources.join(got, "sid", "left").select("sid", "quota", "blocks", F.coalesce("got", F.lit(0)).alias("got"))
    by_sid = Window.orderBy("sid")
    over, under = F.greatest(F.col("got") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("got"), F.lit(0))
    side = F.floor(F.sqrt(F.col("blocks").cast("double"))).cast("long")
    quotas = quotas.withColumn("side", side).withColumn("width", F.expr("blocks div nullif(side, 0)"))
    quotas = settle(
        quotas.withColumn("over", F.sum(over).over(by_sid) - over).withColumn("high", F.sum(under).over(by_sid))
        .withColumn("low", F.col("high") - under), "quotas",
    )
    numbered = (
        drawn.withColumn("n", F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1)
        .join(before, ["sid", "shard"]).withColumn("n", F.col("n") + F.col("before")).drop("before")
        .join(quotas.select("sid", "quota", "over"), "sid")
    )
    within = numbered.filter("n < quota").select("shard", "slot", "sid", "n")
    moved = (
        numbered.filter("n >= quota")
        .select("shard", "slot", (F.col("over") + F.col("n") - F.col("quota")).alias("point"))
        .withColumn("cell", F.floor(F.lit(total) / CELLS).cast("long") + 1)
    )
    moved = _within(moved, "point", quotas.select("sid", "got", "low", "high", F.col("low").alias("begin")), F.lit(total))
    moved = moved.select("shard", "slot", "sid", (F.col("got") + F.col("point") - F.col("begin")).alias("n"))
    rounds = within.unionByName(moved).join(quotas.select("sid", "blocks", "side", "width"), "sid").select(
        "shard", "slot", "sid", "blocks", "side", "width", F.expr("n div blocks").alias("repeat"), (F.col("n") % F.col("blocks")).alias("i")
    )
    rounds = rounds.withColumn("key", hashed(seed, "round", F.col("sid").cast("string"), F.col("repeat").cast("string")) % PRIME)
    block = permuted(F.col("i"), F.col("blocks"), F.col("key"), F.col("side"), F.col("width"))
    return rounds.select("shard", "slot", "sid", "repeat", block.alias("block"))


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return settle(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
        ),
        "sizes",
    )


def _pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a document has words in: the words [first, last) of the document."""
    return placed.filter("size > 0").select(
        "*", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))).alias("block")
    ).withColumn("first", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))).withColumn(
        "last", F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    )


def mix_report(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed="mix", block_words=BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words, repeats counted)."""
    sizes = _sizes(docs, id_col, text_col, source_col)
    sources = settle(source_targets(sizes, block_words=block_words), "sources")
    placed = placed_words(sizes, sources, seed)
    times = dealt_slots(sources, seed).groupBy("sid", "block").agg(F.count("*").alias("times"))
    taken = (
        _pieces(placed, block_words).join(times, ["sid", "block"], "left")
        .groupBy("doc_id", "sid", "start", "size")
        .agg(F.sum((F.col("last") - F.col("first")) * F.coalesce("times", F.lit(0))).alias("taken"))
        .select("doc_id", "sid", "size", "taken")
    )
    wordless = placed.filter("size = 0").select("doc_id", "sid", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(wordless).join(sources.select("sid", "source_size", "target"), "sid").select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mix_documents(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", seed="mix", block_words=BLOCK_WORDS) -> DataFrame:
    """The mix itself: for each document and round the words taken, in order, with all columns of ``docs``.

    A document is in the result once for each round that takes words of it. Words keep the white space
    that follows them.
    """
    names = docs.columns
    sizes = _sizes(docs, id_col, text_col, source_col)
    sources = settle(source_targets(sizes, block_words=block_words), "sources")
    placed = placed_words(sizes, sources, seed)
    slots = dealt_slots(sources, seed).select("sid", "block", "repeat")
    span = F.struct("first", "last")
    rounds = (
        _pieces(placed, block_words).join(slots, ["sid", "block"])
        .groupBy("doc_id", "source", "text_hash", "start", "repeat").agg(F.sort_array(F.collect_list(span)).alias("spans"))
        .groupBy("doc_id", "source", "text_hash", "start").agg(F.sort_array(F.collect_list(F.struct("repeat", "spans"))).alias("rounds"))
    )
    key = ["doc_id", "source", "text_hash"]
    copies = rounds.withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy("start")))
    right = copies.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("copy").alias("_copy"), "rounds")
    left = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"),
    ).withColumn("copy", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
    same = F.col("copy") == F.col("_copy")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    text = f"c{names.index(text_col)}"
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+$)?"), F.lit(0))
    taken = left.join(right, same).select("*", F.explode("rounds").alias("round"))
    whole = F.element_at("round.spans", 1)["first"] == 0
    count = F.aggregate("round.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    part = F.array_join(
        F.flatten(F.transform("round.spans", lambda s: F.slice(F.col("_words"), (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), ""
    )
    mixed = taken.withColumn("_words", words).withColumn(
        "_text", F.when(whole & (count == F.size("_words")), F.col(text)).otherwise(F.ltrim(part))
    )
    return mixed.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"c{i}").alias(c) for i, c in enumerate(names)])

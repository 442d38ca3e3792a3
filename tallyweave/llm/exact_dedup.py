"""Exact deduplication with two passes over a Bloom filter.

Pass one marks, in a blocked Bloom filter, the slots that at least two rows fall into. Pass two tests
every row: only rows all of whose slots are marked can have an equal row, and only those are shuffled
and grouped. All other rows pass straight through.

Defined results: a null text counts as empty; of equal texts the row with the smallest id stays (null
ids come last); of repeated rows with one id and equal text exactly one is kept; an empty table gives an
empty result. Further columns, whatever their names, are ignored or carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import settle

#: Bits of one block: what one row of the bitmap functions holds.
BLOCK_BITS = 32768
BITS_PER_ROW = 16
SLOTS_PER_ROW = 2
#: Upper bound of the filter, hence of what is broadcast: 2^28 bits are 32 MB. A fuller filter lets more
#: rows through to the shuffle and changes no result.
MAX_FILTER_BITS = 1 << 28
#: Groups that hold more than this part of all rows are joined without a shuffle; there can't be more of them.
MAX_HOT_GROUPS = 10_000

# runs of white space that are more than a single blank; a single blank already is its own replacement
_RUNS = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"


def normalised(text: Column) -> Column:
    """The text with each run of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(blocks))


def _slots(sha: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(sha, F.lit(j + 1)), F.lit(BLOCK_BITS)) for j in range(SLOTS_PER_ROW)]


def repeated_filter(digests: DataFrame, max_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, int]:
    """(block, bits) of the slots that two rows or more fall into, and the number of blocks.

    Column ``sha`` is read. The slot numbers are counted map-side first; what is shuffled is a number
    per slot, never a row.
    """
    rows = digests.count()
    blocks = max(1, min(rows * BITS_PER_ROW, max_bits) // BLOCK_BITS + 1)
    blocks = min(blocks, max(1, max_bits // BLOCK_BITS))
    sha = F.col("sha")
    # the slots of one row are told apart only if they differ: equal slots count once
    slots = F.array_distinct(F.array(*[_block(sha, blocks) * BLOCK_BITS + s for s in _slots(sha)]))
    marked = (
        digests.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count("*").alias("n")).filter("n >= 2")
    )
    position = F.col("slot") + 1  # the bitmap functions count from one
    return (
        marked.groupBy((F.bitmap_bucket_number(position) - 1).alias("block"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(position)).alias("bits")),
        blocks,
    )


def _is_set(bits: Column, slot: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(slot, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(slot, F.lit(8)).cast("int")) == 1


def test_rows(rows: DataFrame, marked: DataFrame, blocks: int) -> DataFrame:
    """The rows with ``possible``: whether an equal ``sha`` may exist elsewhere."""
    held = F.broadcast(marked.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    joined = rows.join(held, _block(F.col("sha"), blocks) == F.col("_block"), "left")
    hit = F.col("_bits").isNotNull()
    for slot in _slots(F.col("sha")):
        hit = hit & _is_set(F.col("_bits"), slot)
    return joined.withColumn("possible", F.coalesce(hit, F.lit(False))).drop("_block", "_bits")


def _groups(possible: DataFrame) -> tuple[DataFrame, DataFrame]:
    per_id = possible.groupBy("sha", "doc_id").agg(F.count("*").alias("copies"))
    groups = per_id.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return per_id, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = settle(docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("sha")), "digests")
    marked, blocks = repeated_filter(digests, max_bits)
    tested = test_rows(digests, settle(marked, "filter"), blocks)
    straight = tested.filter(~F.col("possible")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"),
    )
    per_id, groups = _groups(tested.filter("possible"))
    per_id, groups = settle(per_id, "ids"), settle(groups, "groups")
    # a group above the limit holds so large a share of all rows that there are MAX_HOT_GROUPS at most
    limit = digests.count() // MAX_HOT_GROUPS
    large = F.broadcast(groups.filter(F.col("group_size") > limit))
    grouped = (
        per_id.join(large, "sha")
        .unionByName(per_id.join(large, "sha", "left_anti").join(groups.filter(F.col("group_size") <= limit), "sha"))
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
        .select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
    return straight.unionByName(grouped)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; all columns stay.

    Rows that the filter clears keep their place; only possibly repeated rows are joined with their groups.
    """
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    digests = settle(plain.select(F.col(key).alias("doc_id"), digest(F.col(text)).alias("sha")), "digests")
    marked, blocks = repeated_filter(digests, max_bits)
    marked = settle(marked, "filter")
    _, groups = _groups(test_rows(digests, marked, blocks).filter("possible"))
    tested = test_rows(plain.withColumn("sha", digest(F.col(text))), marked, blocks)
    stays = groups.select(F.col("sha").alias("_sha"), "keep_id")
    kept = tested.filter("possible").join(
        stays, (F.col("sha") == F.col("_sha")) & F.col(key).eqNullSafe(F.col("keep_id")), "left_semi"
    )
    # repeated rows: one id and one text
    kept = kept.groupBy(F.col(key).alias("_key"), "sha").agg(F.first(F.struct(*[f"c{i}" for i in range(len(names))])).alias("row")).select("row.*")
    straight = tested.filter(~F.col("possible")).select(*[f"c{i}" for i in range(len(names))])
    return straight.unionByName(kept).toDF(*names)

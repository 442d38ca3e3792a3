"""Training preparation: seeded split, step counts and batch plans.

All of these need an exact global rank of the shuffled images; ``functions.ranking`` gives it
without a one-partition sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.ranking import shuffle_key, shuffled_rank

# Fixed value: the seed of the split.
SPLIT_SEED = 123


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def train_val_split(
    images: DataFrame, fraction: float, seed: object = SPLIT_SEED, by: Sequence[str] = (), id_col: str = "image_id"
) -> DataFrame:
    """Add ``split`` and ``position`` (1-based within the split).

    One seeded permutation of all images (of each ``by`` group, when given; not stratified by label);
    the last floor(fraction * n) are the validation part.
    """
    ranked = shuffled_rank(images, shuffle_key(seed, id_col), id_col, by, rank="position", total="_n")
    training = F.col("_n") - F.floor(F.col("_n") * F.lit(float(fraction)))
    late = F.col("position") > training
    return ranked.withColumns(
        {
            "split": F.when(late, "validation").otherwise("training"),
            "position": F.when(late, F.col("position") - training).otherwise(F.col("position")),
        }
    ).drop("_n")


def step_counts(split: DataFrame, batch: int, by: Sequence[str] = ()) -> DataFrame:
    """Whole batches per epoch: (steps, val_steps)."""
    size = lambda part: F.count_if(F.col("split") == part)
    return split.groupBy(*by).agg(
        F.floor(size("training") / batch).alias("steps"), F.floor(size("validation") / batch).alias("val_steps")
    )


#: Rounds of the permutation, and the prime its hashes are taken by; numbers below it can be multiplied in 64 bits.
SHUFFLE_ROUNDS = 24
PRIME = 2_147_483_647


def _round_keys(seed: object, number: Column, size: Column) -> Column:
    """The keys of each round of one pass: a place to mirror at, a factor and an addend."""

    def part(step: Column, first: int) -> Column:
        text = F.md5(F.concat_ws(":", F.lit(str(seed)), number.cast("string"), step.cast("string")))
        return F.conv(F.substring(text, first, 8), 16, 10).cast("long")

    return F.transform(
        F.sequence(F.lit(1), F.lit(SHUFFLE_ROUNDS)),
        lambda i: F.struct((part(i, 1) % size).alias("mirror"), (part(i, 9) % PRIME).alias("factor"), (part(i, 17) % PRIME).alias("addend")),
    )


def permuted(place: Column, size: Column, keys: Column) -> Column:
    """Where a place (counted from 0) comes to lie in a keyed permutation of ``size`` places.

    Swap-or-not: each round pairs places by mirroring, and a hash of the larger of a pair decides whether both swap.
    Each round is its own inverse, so the whole is one to one for any size, and a row needs nothing but its place.
    """

    def step(x: Column, key: Column) -> Column:
        other = (key["mirror"] - x + size) % size
        h = (F.greatest(x, other) % PRIME * key["factor"] + key["addend"]) % PRIME
        h = (h * h + key["addend"]) % PRIME
        return F.when(F.shiftright(h, 12) % 2 == 1, other).otherwise(x)

    return F.aggregate(keys, place, step)


def batch_plan(training: DataFrame, epochs: int, batch: int, seed: object = SPLIT_SEED, id_col: str = "image_id") -> DataFrame:
    """(epoch, step, slot, image) in stream order.

    Every pass reshuffles all images and cuts them into ceil(n / batch) batches, the last one short. The passes form
    one endless stream of which each epoch takes floor(n / batch) batches, so a short batch and whatever follows it
    run into the next epoch. Images are ranked once, by their seeded hash; each pass permutes the ranks, which is a
    map over the rows, however many epochs there are.
    """
    n = F.col("_n")
    steps, per_pass = F.floor(n / batch), F.ceil(n / batch)
    ranked = shuffled_rank(training.select(id_col), shuffle_key(seed, id_col), id_col, [], rank="_rank", total="_n")
    # the keys of all passes are one short array for every row
    whole = training.agg(F.count(F.lit(1)).alias("n"))
    keys = F.transform(F.sequence(F.lit(1), F.lit(epochs)), lambda i: _round_keys(seed, i, F.greatest(F.col("n"), F.lit(1))))
    ranked = ranked.withColumn("_keys", whole.select(keys.alias("keys")).scalar())
    passes = ranked.select(id_col, "_rank", "_n", F.posexplode("_keys").alias("_pass", "_round_keys"))
    placed = passes.withColumn("_rank", permuted(F.col("_rank") - 1, n, F.col("_round_keys")) + 1)
    nth = placed.withColumn("_nth", F.col("_pass") * per_pass + F.floor((F.col("_rank") - 1) / batch))
    used = nth.filter(F.col("_nth") < steps * epochs)
    # fewer images than one batch leave no step, and no row that would divide by zero
    size = F.nullif(steps, F.lit(0))
    return used.select(
        (F.floor(F.col("_nth") / size) + 1).cast("int").alias("epoch"),
        (F.col("_nth") % size + 1).alias("step"),
        ((F.col("_rank") - 1) % batch + 1).alias("slot"),
        id_col,
    )


def val_batches(split: DataFrame, batch: int, id_col: str = "image_id") -> DataFrame:
    """(step, slot, image) of the validation part in split order; the short last batch is not used."""
    validation = split.filter(F.col("split") == "validation")
    steps = F.floor(_count(validation) / batch)
    return (
        validation.withColumn("step", F.floor((F.col("position") - 1) / batch) + 1)
        .filter(F.col("step") <= steps)
        .select("step", ((F.col("position") - 1) % batch + 1).alias("slot"), id_col)
    )

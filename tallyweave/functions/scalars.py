"""Column expressions. All run inside Catalyst; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slug(c: Column | str) -> Column:
    """Every space becomes an underscore, then lower case; nothing is trimmed."""
    return F.lower(F.replace(_col(c), F.lit(" "), F.lit("_")))


def basename(c: Column | str) -> Column:
    """Text after the last slash."""
    return F.substring_index(_col(c), "/", -1)


def image_path(dataset_name: Column | str, dataset_id: Column | str, file: Column | str) -> Column:
    return F.concat(
        F.lit("datasets/"), slug(dataset_name), F.lit("-"), _col(dataset_id).cast("string"), F.lit("/"), _col(file)
    )


def format_label(c: Column | str) -> Column:
    """Underscores to spaces and an upper-case first letter per word; the rest of each word is kept."""
    words = F.split(F.replace(_col(c), F.lit("_"), F.lit(" ")), " ")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2147483647))), " "
    )


def _pad2(n: Column) -> Column:
    # lpad would cut hours beyond 99, so only short numbers are padded.
    text = n.cast("string")
    return F.when(n < 10, F.concat(F.lit("0"), text)).otherwise(text)


def format_duration(seconds: Column | str) -> Column:
    """``HH:MM:SS``; the hours grow past two digits."""
    s = F.floor(_col(seconds)).cast("long")
    parts = [F.floor(s / 3600), F.floor(s / 60) % 60, s % 60]
    return F.concat_ws(":", *[_pad2(p.cast("long")) for p in parts])


def session_duration(created: Column | str, updated: Column | str) -> Column:
    """Seconds between two timestamps, at millisecond precision."""
    # unix_millis needs a zoned timestamp; zone-less columns are read in the session zone (UTC).
    return (
        F.unix_millis(_col(updated).cast("timestamp")) - F.unix_millis(_col(created).cast("timestamp"))
    ) / F.lit(1000.0)


def _two_decimals(x: Column) -> Column:
    """Round a non-negative double to hundredths on its exact binary value, ties upward.

    Casting to decimal or ``format_string`` would round the shortest decimal text instead
    (1.005 is below the tie in binary). The product ``x * 200`` is split into its rounded
    value and its exact error (Dekker), which decides the comparison with the odd midpoint.
    """
    split = F.lit(134217729.0)  # 2^27 + 1
    high = x * split - (x * split - x)
    low = x - high
    product = x * F.lit(200.0)
    error = (high * F.lit(200.0) - product) + low * F.lit(200.0)
    below = F.floor(x * F.lit(100.0))
    guess = F.when(below > x * F.lit(100.0), below - 1).otherwise(below)
    midpoint = (guess * 2 + 1).cast("double")
    up = (product > midpoint) | ((product == midpoint) & (error >= 0))
    return F.when(up, guess + 1).otherwise(guess).cast("long")


def pct(c: Column | str, falsy_pending: bool = False) -> Column:
    """Two decimals and a percent sign.

    With ``falsy_pending`` (accuracy and confidence) a zero, NaN or missing value prints
    ``Calculating...``; otherwise only a missing value does, and NaN prints as such.
    """
    x = _col(c)
    hundredths = _two_decimals(x)
    text = F.concat(
        F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("%")
    )
    pending = x.isNull() | (F.isnan(x) | (x == 0) if falsy_pending else F.lit(False))
    return F.when(pending, F.lit("Calculating...")).when(F.isnan(x), F.lit("NaN%")).otherwise(text)


def dataset_kind(base: Column | str, for_testing: Column | str) -> Column:
    return F.when(_col(base), "Base").when(_col(for_testing), "Testing").otherwise("Training")


def join_class_names(names: Column | str) -> Column:
    return F.array_join(_col(names), ", ")


def split_class_names(text: Column | str) -> Column:
    """Back to an array; the class index is the array position."""
    return F.split(_col(text), ", ")


def one_hot(label_idx: Column | str, k: Column | int) -> Column:
    idx = _col(label_idx)
    size = F.lit(k) if isinstance(k, int) else k
    return F.transform(F.sequence(F.lit(0), size.cast("int") - 1), lambda i: (i == idx).cast("int"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """A percentage whose zero denominator counts as zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(F.lit(100.0) * numerator / denominator)

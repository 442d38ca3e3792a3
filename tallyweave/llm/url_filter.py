"""URL rules by a sort-merge range join.

A host is written in reverse (``www.example.org`` becomes ``org.example.www.``), so that the hosts a rule
fits are those that begin with its key: an interval of the sorted hosts. Urls and rules are cut into
ranges of the sorted keys at sampled boundaries; a rule goes to each range that its interval meets. A sweep
over each sorted range keeps a stack of the rules whose intervals are open, which are nested, and judges
each url by them.

The longest fitting rule wins: most characters of host and path together, then the longest host, then the
smallest path, then ``allow`` before ``block``.

Defined results: a null url or one without ``://`` has empty host and path and no rule; repeated urls and
rules are judged like single ones; rules with null parts are ignored; a rule with an empty host fits every
host; without rules every url gets the default verdict; an empty table gives an empty result. Only the id
and url columns are read.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import settle

#: Rows that one range should hold, and sampled keys for each range.
RANGE_ROWS = 1_000
SAMPLED_PER_RANGE = 100
MAX_SAMPLE = 200_000
#: Rows that one task should sweep; it takes several ranges.
TASK_ROWS = 100_000


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the last to the first, each followed by a dot; empty for an empty host.

    A dot sorts between characters of labels, but prefixes stay intervals in any order of characters.
    """
    labels = F.reverse(F.split(host, r"\.", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))


def _boundaries(urls: DataFrame, rows: int, range_rows: int) -> list[tuple[str, int]]:
    """Keys that cut the sorted urls into ranges of similar size, from a sample of bounded size."""
    ranges = rows // range_rows
    if not ranges:
        return []
    wanted = min(MAX_SAMPLE, ranges * SAMPLED_PER_RANGE)
    part = F.pmod(F.xxhash64("salt", F.lit("cut")), F.lit(1 << 30)) < F.lit(int(wanted / rows * (1 << 30)))
    found = sorted((r[0], r[1]) for r in urls.filter(part).select("key", "salt").limit(2 * MAX_SAMPLE).collect())
    step = max(1, len(found) // (ranges + 1))
    return sorted(set(found[step::step]))


def sweep(batches, default: str):
    """Judge the rows of sorted ranges: rules open and close on a stack, urls look at the open ones.

    Rows come by range, key and kind, rules before urls; a new range starts with an empty stack, as it has
    its own copy of every rule that reaches into it.
    """
    current, stack = None, []
    for batch in batches:
        judged, rows = [], batch.to_pydict()
        columns = [rows[c] for c in ("place", "key", "is_url", "host", "path", "verdict")]
        for place, key, is_url, host, path, verdict in zip(*columns, strict=True):
            if place != current:
                current, stack = place, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                stack.append((key, host, path, verdict))
                continue
            fitting = [(-len(h) - len(p), -len(h), p, v, h) for _, h, p, v in stack if path.startswith(p)]
            best = min(fitting, default=None)
            judged.append((best[4] + best[2], best[3]) if best else (None, default))
        urls = batch.filter(batch.column("is_url"))
        verdicts = [pa.array([x[i] for x in judged], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(urls.column(c) for c in ("page_id", "host", "path")), *verdicts], ["page_id", "host", "path", "rule", "verdict"])


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", range_rows: int = RANGE_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """A row per row of ``pages``: page_id, host, path, rule (host and path of the winner, or null), verdict.

    ``rules`` has host, path and verdict; any number of them. Ranges are dealt to tasks of about ``task_rows`` rows, but
    to all cores while there are fewer such tasks than cores.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    # the salt breaks ties of equal keys, so that one common host is spread over many ranges
    urls = settle(
        urls.withColumn("key", reversed_host(F.col("host"))).withColumn("salt", F.xxhash64("path", "page_id")), "urls"
    )
    rows = urls.count()
    cuts = _boundaries(urls, rows, range_rows)
    keys = [k for k, _ in cuts]

    @F.pandas_udf("int")
    def place_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, x) for x in zip(key, salt, strict=True)], dtype="int32")

    @F.pandas_udf("array<int>")
    def places_of(key: pd.Series) -> pd.Series:
        # from the range where the interval begins to the last one that still holds keys with this prefix
        first = [bisect_right(cuts, (k, -(2**63) - 1)) for k in key]
        last = [bisect_right(keys, k + "\U0010ffff") for k in key]
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last, strict=True)])

    id_type = urls.schema["page_id"].dataType.simpleString()
    known = rules.filter("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct()
    opened = known.withColumn("key", reversed_host(F.col("host"))).select(
        F.explode(places_of("key")).alias("place"), "key", F.lit(False).alias("is_url"), F.lit(None).cast(id_type).alias("page_id"),
        "host", "path", "verdict",
    )
    placed = urls.select(
        place_of("key", "salt").alias("place"), "key", F.lit(True).alias("is_url"), "page_id", "host", "path", F.lit("").alias("verdict")
    )
    tasks = min(len(cuts) + 1, max(pages.sparkSession.sparkContext.defaultParallelism, -(-rows // task_rows)))
    ordered = placed.unionByName(opened).repartition(tasks, "place").sortWithinPartitions("place", "key", "is_url")
    return ordered.mapInArrow(
        lambda batches: sweep(batches, default), f"page_id {id_type}, host string, path string, rule string, verdict string"
    )

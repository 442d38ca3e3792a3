"""Secret scans over an incremental ledger of blobs.

Every version of a path is addressed by the sha256 of its content. The ledger, a Parquet folder, holds a
row for each scanned pair of blob and rule version with the spans found (none, too). A scan looks up which
pairs it has not seen, reads one text for each such blob, appends the new rows, and joins findings back to
all paths that carry the blob.

Defined results: a null text counts as empty and has no findings; rows with a null path are paths like any
other; repeated rows each get their findings; an empty table gives an empty result. Spans count code
points and their end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tallyweave.session import scratch, settle


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: The rules asked for, in their order.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # shorter runs fail the length rule and hide nothing
)
LEDGER_SCHEMA = "blob binary, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def spans(text: Column, rule: Rule) -> Column:
    """The spans of one rule: gaps and matches alternate, so positions are running sums of their lengths."""
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    sizes = F.transform(matches, F.length)
    measured = sizes if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    kind = "array<struct<start:bigint,end:bigint,ok:boolean>>"
    rows = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), measured.alias("value"))

    def step(done: Column, row: Column) -> Column:
        start = F.when(F.size(done) == 0, F.lit(0).cast("long")).otherwise(F.element_at(done, -1)["end"]) + row["gap"]
        ok = row["value"] >= rule.least
        new = F.struct(start.alias("start"), (start + row["size"]).alias("end"), ok.alias("ok"))
        return F.concat(done, F.array(new)).cast(kind)

    found = F.aggregate(rows, F.array().cast(kind), step)
    kept = F.transform(F.filter(found, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.when(text.rlike(rule.pattern), kept).otherwise(none)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger; empty where the folder does not exist yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def scan_new(versions: DataFrame, folder: str, rules=RULES) -> DataFrame:
    """Scan the unseen pairs of ``versions`` (path, text), append them to the ledger and return the addresses.

    The result has a row (path, blob) for each row of ``versions``. Appending twice is harmless: a second
    call finds every pair seen.
    """
    spark = versions.sparkSession
    addressed = versions.select("path", blob_of(F.col("text")).alias("blob"))
    addresses = settle(addressed, "addresses")
    ledger = read_ledger(spark, folder)
    wanted = F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])).alias("rule")
    blobs = addresses.groupBy("blob").agg(F.min("path").alias("path"))
    unseen = (
        blobs.select("blob", "path", wanted).select("blob", "path", "rule.kind", "rule.version")
        .join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        .groupBy("blob", "path").agg(F.collect_set("kind").alias("kinds"))
    )
    unseen = settle(unseen, "unseen")
    texts = versions.select(F.col("path").alias("_path"), F.coalesce("text", F.lit("")).alias("text"))
    picked = texts.join(unseen.hint("shuffle_hash"), F.col("_path").eqNullSafe(F.col("path"))).filter(
        blob_of(F.col("text")) == F.col("blob")
    )
    scanned = picked.select(
        "blob",
        F.array(*[
            F.struct(
                F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                F.when(F.array_contains("kinds", r.kind), spans(F.col("text"), r)).alias("spans"),
            )
            for r in rules
        ]).alias("found"),
    )
    rows = scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.kind", "f.version", "f.spans").filter("spans is not null")
    rows.write.mode("append").parquet(folder)
    return addresses


def findings(addresses: DataFrame, folder: str, rules=RULES) -> DataFrame:
    """(path, found) for every address: the spans of all rules as (start, place of the rule, kind, end), in order."""
    spark = addresses.sparkSession
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    ledger = read_ledger(spark, folder).withColumn("place", order[F.concat_ws(":", "kind", "version")]).filter("place is not null")
    each = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), F.col("place").alias("place"), F.col("kind").alias("kind"), s["end"].alias("end"))
    )
    hits = ledger.filter(F.size("spans") > 0).dropDuplicates(["blob", "place"])
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(each))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>")
    return addresses.join(by_blob, "blob", "left").select("path", "blob", F.coalesce("found", none).alias("found"))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, rules=RULES) -> DataFrame:
    """Findings of every row of ``docs`` by a ledger in ``folder`` (a fresh one in the shared folder by default)."""
    folder = folder or scratch(docs.sparkSession, "ledger")
    versions = docs.select(F.col(id_col).alias("path"), F.col(text_col).alias("text"))
    return findings(scan_new(versions, folder, rules), folder, rules).withColumnRenamed("path", "doc_id")


def span_list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")

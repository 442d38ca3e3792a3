"""Removal of long repeated byte strings.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else as well. Documents are far too many
for one suffix array, so the sorted suffixes are cut where no repeat is lost: each window of LENGTH bytes
chooses, by the smallest hash, an anchor of ANCHOR bytes inside it; equal windows choose equal anchors at equal
places. Suffixes that begin with one anchor form one interval of the suffix array, and any repeat can be found
inside the interval of its anchor.

For each such interval the suffixes are sorted, and the interval is extended backwards one byte a round, all
intervals breadth first: the byte in front of each suffix (its Burrows-Wheeler column) splits an interval into
smaller ones. After o rounds two suffixes of one interval have o bytes in front in common, and repeat
LENGTH bytes if what they share behind the anchor has reached LENGTH - ANCHOR - o. The common prefixes asked for
thus fall as those found rise by one a round; intervals of a single suffix are dropped, and the expansion
stops at LENGTH.

Only anchors that occur twice are considered, and occurrences with equal surroundings (LENGTH bytes less the
anchor on either side, so that every window over the anchor is the same) stand as one. An interval with more
than HOT different surroundings is not put into one task: each of its windows becomes a row with its hash, and
equal rows are counted.

Defined results: a null text has no bytes; texts shorter than LENGTH lose nothing; repeated rows count as
different documents, so each is a copy of the other; null ids are ids like any other; an empty table gives an
empty result. Only id and text are read; matches never cross documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.joins import join_counted
from tallyweave.llm.words import RUN_BYTES, mix, powers
from tallyweave.session import configure, settle

LENGTH = 400
ANCHOR = 100
#: Different surroundings of one anchor that one task takes; beyond, windows are counted as rows.
HOT = 20_000
#: Surroundings that one task should take.
SHARD_ROWS = 4_000
#: Longer texts are cut into overlapping parts of this many bytes.
PART_BYTES = 1_000_000
_PLACE = np.uint64(0xFFFFFF)


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)
    return np.concatenate([np.zeros(1, np.uint64), sums])


def _span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``begin`` to ``end``; equal strings of equal length agree wherever they are."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[begin]) * down[begin])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """(part, place, anchor hash, hash of surroundings, bytes in front, bytes behind) of the parts' anchors.

    ``starts`` and ``ends`` delimit the parts within ``data``; places count from a part's start.
    """
    width = length - anchor + 1
    sums = _sums(data)
    grams = len(data) - anchor + 1
    valid = [np.arange(a, b - length + 1) for a, b in zip(starts, ends, strict=True) if b - a >= length]
    if not valid:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    at = np.arange(grams)
    hashes = _span_hash(sums, at, at + anchor)
    # the order is by the upper bits; the place in the lower ones makes the leftmost of equals the smallest
    order = (hashes & ~_PLACE) | at.astype(np.uint64)
    blocks = -(-grams // width)
    padded = np.concatenate([order, np.full(blocks * width - grams, np.uint64(2**64 - 1))]).reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.concatenate(valid)
    least = np.minimum(behind[windows], ahead[windows + width - 1]) & _PLACE
    place = least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64)
    part = np.searchsorted(starts, place, side="right") - 1
    front = np.minimum(length - anchor, place - starts[part])
    back = np.minimum(length - anchor, ends[part] - place - anchor)
    around = _span_hash(sums, place - front, place + anchor + back)
    around = mix(around ^ (front.astype(np.uint64) << np.uint64(32) | back.astype(np.uint64)))
    return part, place - starts[part], hashes[place], around, front, back


def _anchor_batches(batches, length: int, anchor: int):
    for batch in batches:
        texts = batch.column("text")
        run, size = [], 0
        for row in range(batch.num_rows):
            data = texts[row].as_buffer()
            run.append((row, 0, data.size, data))
            size += data.size + 1
            if size >= RUN_BYTES or row == batch.num_rows - 1:
                yield from _anchor_run(batch, run, length, anchor)
                run, size = [], 0


def _anchor_run(batch, run, length: int, anchor: int):
    """Anchors of some rows; a text longer than a part is cut into parts that share LENGTH - 1 bytes."""
    parts = []
    for row, _, size, data in run:
        whole = np.frombuffer(data, np.uint8) if size else np.zeros(0, np.uint8)
        for a in range(0, max(1, size - length + 1), PART_BYTES):
            parts.append((row, a, size, whole[a : a + PART_BYTES + length - 1]))
    group, total = [], 0
    for k, part in enumerate(parts):
        group.append(part)
        total += len(part[3])
        if total >= RUN_BYTES or k == len(parts) - 1:
            sizes = np.array([len(p[3]) for p in group])
            ends = np.cumsum(sizes)
            found, place, gram, _, _, _ = out = anchors(np.concatenate([p[3] for p in group]), ends - sizes, ends, length, anchor)
            if len(found):
                yield _anchor_rows(batch, group, out, length, anchor)
            group, total = [], 0


def _anchor_rows(batch, group, out, length: int, anchor: int):
    part, place, gram, around, front, back = out
    rows = np.array([p[0] for p in group])[part]
    offset, size = np.array([p[1] for p in group])[part], np.array([p[2] for p in group])[part]
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id").take(pa.array(rows)), batch.column("text_hash").take(pa.array(rows)), pa.array(gram.view(np.int64)),
            pa.array(around.view(np.int64)), pa.array(place + offset), pa.array(front.astype(np.int32)), pa.array(back.astype(np.int32)),
        ],
        ["doc_id", "text_hash", "anchor", "around", "place", "front", "back"],
    )


def _surroundings(batches, length: int, anchor: int):
    """The bytes around the anchors listed with each text."""
    names = ["doc_id", "text_hash", "anchor", "around", "n", "crowded", "place", "front", "back"]
    kinds = {"crowded": pa.bool_(), "front": pa.int32(), "back": pa.int32()}
    for batch in batches:
        texts = batch.column("text")
        for row in range(batch.num_rows):
            data = memoryview(texts[row].as_buffer())
            listed = batch.column("listed")[row].as_py()
            columns = {k: [x[k] for x in listed] for k in names[2:]}
            hulls = [bytes(data[x["place"] - x["front"] : x["place"] + anchor + x["back"]]) for x in listed]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("doc_id")[row].as_py()] * len(listed), batch.column("doc_id").type),
                    pa.array([batch.column("text_hash")[row].as_py()] * len(listed), pa.int64()),
                    *[pa.array(columns[k], kinds.get(k, pa.int64())) for k in names[2:]],
                    pa.array(hulls, pa.binary()),
                ],
                [*names, "hull"],
            )


def repeated_windows(anchor_ids: np.ndarray, hulls: list[bytes], front: np.ndarray, back: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> np.ndarray:
    """Which windows repeat: a row for each suffix, a column for the number of bytes in front of the anchor."""
    reach, n = length - anchor, len(hulls)
    marks = np.zeros((n, reach + 1), bool)
    # bytes are stored as 255 - byte; 0 then stands for what lies beyond a document's edge, as UTF-8 has no 255
    before, after = np.zeros((n, reach), np.uint8), np.zeros((n, reach), np.uint8)
    for i, hull in enumerate(hulls):
        data = 255 - np.frombuffer(hull, np.uint8)
        f = front[i]
        before[i, :f] = data[:f][::-1]
        after[i, : back[i]] = data[f + anchor :]
    # sorted suffixes: by anchor, then by what follows it
    key = np.concatenate([anchor_ids.astype(">u8").reshape(-1, 1).view(np.uint8), after], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{8 + reach}").ravel(), kind="stable")
    anchor_ids, before, after, front, back = anchor_ids[order], before[order], after[order], front[order], back[order]
    differ = after[1:] != after[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), reach)
    shared = np.minimum(shared, np.minimum(back[1:], back[:-1]))
    shared[anchor_ids[1:] != anchor_ids[:-1]] = -1
    interval = np.unique(anchor_ids, return_inverse=True)[1]
    live = np.arange(n)
    for o in range(reach + 1):
        sizes = np.bincount(interval)
        keep = (sizes[interval] >= 2) & (front[live] >= o)
        live, interval = live[keep], interval[keep]
        if not len(live):
            break
        # suffixes that share what is still asked for stand side by side in the sorted order
        alike = np.concatenate([[0], np.cumsum(shared < reach - o)])
        long_enough = back[live] >= reach - o
        same = interval.astype(np.int64) * n + alike[live]
        _, which, counts = np.unique(same, return_inverse=True, return_counts=True)
        marks[live, o] = (counts[which] >= 2) & long_enough
        if o < reach:
            interval = np.unique(interval.astype(np.int64) << 8 | before[live, o], return_inverse=True)[1]
    result = np.empty_like(marks)
    result[order] = marks
    return result


def _covered(marks: np.ndarray, length: int):
    """(row, from, to) relative to the anchor for runs of marked windows."""
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return row, -last, length - first


def _expanded(table: pa.Table, length: int, anchor: int) -> pa.Table:
    """One shard: the covered spans of the occurrences that stand alone."""
    ids = table.column("anchor").to_numpy().view(np.uint64)
    around = table.column("around").to_numpy()
    # a repeated row of the input brings its surroundings twice
    _, once = np.unique(np.stack([ids.view(np.int64), around], axis=1), axis=0, return_index=True)
    table = table.take(pa.array(once))
    front, back = table.column("front").to_numpy(), table.column("back").to_numpy()
    marks = repeated_windows(ids[once], table.column("hull").to_pylist(), front, back, length, anchor)
    marks[table.column("n").to_numpy() > 1] = False
    row, begin, end = _covered(marks, length)
    place = table.column("place").to_numpy()[row]
    taken = table.take(pa.array(row))
    return pa.table({"doc_id": taken.column("doc_id"), "text_hash": taken.column("text_hash"), "begin": place + begin, "end": place + end})


def _windows(batches, length: int, anchor: int):
    """Every window over an anchor as a row with its hash."""
    for batch in batches:
        for k in range(batch.num_rows):
            hull = np.frombuffer(batch.column("hull")[k].as_buffer(), np.uint8)
            starts = np.arange(len(hull) - length + 1)
            hashes = _span_hash(_sums(hull), starts, starts + length)
            front, place = batch.column("front")[k].as_py(), batch.column("place")[k].as_py()
            same = pa.array(np.full(len(starts), k))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(same) for c in ("doc_id", "text_hash", "anchor", "n")), pa.array(hashes.view(np.int64)), pa.array(front - starts), pa.array(place - front + starts)],
                ["doc_id", "text_hash", "anchor", "n", "window", "offset", "begin"],
            )


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, begin, end): byte spans covered by repeated strings; spans of a document may overlap.

    ``docs`` has doc_id, text_hash and text.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {id_type}, text_hash bigint"
    long_enough = docs.filter(F.octet_length("text") >= length)
    found = settle(
        long_enough.mapInArrow(
            lambda b: _anchor_batches(b, length, anchor), f"{columns}, anchor bigint, around bigint, place bigint, front int, back int"
        ),
        "anchors",
    )
    per_anchor = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    repeated = settle(per_anchor.filter("n >= 2").select("anchor", F.col("n").alias("rows"), (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    again = settle(join_counted(found, repeated, ["anchor"], "rows", found.count()).drop("rows"), "repeated")
    place = F.struct("doc_id", "text_hash", "place", "front", "back")
    per_around = settle(
        again.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(place).alias("at")), "around"
    )
    copied = join_counted(again, per_around.filter("n >= 2").select("anchor", "around", "n"), ["anchor", "around"], "n", again.count())
    copied = copied.select(
        "doc_id", "text_hash", (F.col("place") - F.col("front")).alias("begin"), (F.col("place") + anchor + F.col("back")).alias("end")
    )
    mixed = per_around.filter("mixed").select("anchor", "around", "n", "at.*")
    kinds = mixed.count()
    per_mixed = settle(mixed.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumn("crowded", F.col("kinds") > hot), "kinds")
    flagged = join_counted(mixed, per_mixed, ["anchor"], "kinds", kinds)
    entry = F.struct("anchor", "around", "n", "crowded", "place", "front", "back")
    listed = flagged.groupBy("doc_id", "text_hash").agg(F.collect_list(entry).alias("listed"))
    listed = listed.withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    hulls = settle(
        long_enough.join(listed, same).select("doc_id", "text_hash", "text", "listed").mapInArrow(
            lambda b: _surroundings(b, length, anchor),
            f"{columns}, anchor bigint, around bigint, n bigint, crowded boolean, place bigint, front int, back int, hull binary",
        ),
        "surroundings",
    )
    shards = max(1, kinds // SHARD_ROWS)
    expanded = (
        hulls.filter("not crowded").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .groupBy("shard").applyInArrow(lambda t: _expanded(t, length, anchor), f"{columns}, begin bigint, end bigint")
    )
    windows = hulls.filter("crowded").dropDuplicates(["anchor", "around"]).mapInArrow(
        lambda b: _windows(b, length, anchor), f"{columns}, anchor bigint, n bigint, window bigint, offset bigint, begin bigint"
    )
    # the place of the anchor is part of the key: one window may hold the anchor twice
    key = ["anchor", "offset", "window"]
    twice = windows.groupBy(*key).agg(F.count("*").alias("c")).filter("c >= 2").select(*key)
    counted = windows.filter("n = 1").join(twice, key).select(
        "doc_id", "text_hash", "begin", (F.col("begin") + length).alias("end")
    )
    return copied.unionByName(expanded).unionByName(counted)


def _kept(batches, whole: bool):
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            text = memoryview(batch.column("text")[row].as_buffer())
            spans = batch.column("spans")[row].as_py() or []
            kept, removed, runs, at = [], 0, 0, 0
            merged = []
            for s in sorted((x["begin"], x["end"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            for a, b in merged:
                kept.append(text[at:a])
                removed, runs, at = removed + b - a, runs + 1, b
            kept.append(text[at:])
            if whole:
                out.append((b"".join(kept), [{"begin": a, "end": b} for a, b in merged]))
            else:
                sha = hashlib.sha256()
                for part in kept:
                    sha.update(part)
                out.append((len(text), removed, runs, sha.hexdigest()))
        types = [pa.binary(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))] if whole else [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = ["kept", "removed"] if whole else ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])


def _cut(docs: DataFrame, id_col: str, text_col: str, whole: bool, schema: str, **limits) -> DataFrame:
    configure(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(texts, **limits).groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).agg(
        F.collect_set(F.struct("begin", "end")).alias("spans")
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    joined = texts.join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda b: _kept(b, whole), f"doc_id {id_type}, {schema}")


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _cut(docs, id_col, text_col, False, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", **limits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """A row per row of ``docs``: doc_id, the bytes kept, and the spans removed."""
    return _cut(docs, id_col, text_col, True, "kept binary, removed array<struct<begin:bigint,end:bigint>>", **limits)

"""Removal of passages that an earlier document holds, by seed and extend.

Words are runs without white space (space and the characters 9 to 13), unchanged. A document loses each word that
a window of LENGTH words covers whose sequence also starts in a document with a smaller id.

Seeds: of the grams of SEED words in each window, winnowing takes the one with the smallest hash, the leftmost of
equals; equal windows take equal grams at equal places, so documents that share a window meet when they are joined
on these anchors. An anchor is at most LENGTH - SEED words from either end of its window, so that many words to
both sides (its surroundings) are all that extension has to look at.

Extension: occurrences of an anchor with the same surroundings are one match, extended in full: all of it is
repeated in each document but the one with the smallest id. The different surroundings of an anchor meet in one
task, where matches grow to both sides one word at a time, those with the same words staying together; a match
that has grown to LENGTH words, and that a smaller document is part of, is kept. Kept matches that touch or
overlap are one maximal repeat. An anchor with more than HOT different surroundings does not go into one task:
its windows become rows, and the smallest document of equal rows is found by grouping.

Words, grams and surroundings are compared by 64-bit hashes.

Defined results: a null or empty text has no words and the digest of nothing; texts shorter than LENGTH words lose
none; very long texts are hashed and cut in pieces that end at white space; repeated rows with one id are the same
document, so neither is smaller than the other; a null id is larger than every other; an empty table gives an empty
result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.joins import join_counted
from tallyweave.llm.words import RUN_BYTES, mix, powers
from tallyweave.session import configure, settle

LENGTH = 13
SEED = 5
#: Different surroundings of one anchor that one task takes; beyond, windows are rows.
HOT = 20_000
#: Surroundings that one task should take.
SHARD_ROWS = 20_000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about RUN_BYTES that end at white space."""
    begin = 0
    while len(text) - begin > RUN_BYTES:
        cut = _SPACE.search(text, begin + RUN_BYTES)
        if cut is None:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def _hashed(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all parts, and the number of words of each part."""
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data))
    sums = np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    upto = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
    return hashes, np.diff(upto, prepend=0)


def word_runs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, words per row) for runs of rows of bounded size, unless a single text is larger."""

    def run(first, parts, owners):
        hashes, counts = [], np.zeros(owners[-1] - first + 1, np.int64)
        batch, size, begin = [], 0, 0
        for k, part in enumerate(parts):
            batch.append(part)
            size += len(part)
            if size >= RUN_BYTES or k == len(parts) - 1:
                h, n = _hashed(batch)
                hashes.append(h)
                np.add.at(counts, np.array(owners[begin : k + 1]) - first, n)
                batch, size, begin = [], 0, k + 1
        return first, np.concatenate(hashes), counts

    first, parts, owners, size = 0, [], [], 0
    for row in range(len(texts)):
        for part in pieces(texts[row].as_buffer().to_pybytes()):
            parts.append(part)
            owners.append(row)
            size += len(part)
        if size >= RUN_BYTES or row == len(texts) - 1:
            yield run(first, parts, owners)
            first, parts, owners, size = row + 1, [], [], 0


def anchors(hashes: np.ndarray, counts: np.ndarray, length: int, seed: int):
    """(row, place, anchor, around, front, back) of the winnowed grams of each row; places count words of the row."""
    reach, n = length - seed, len(hashes)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(n)
    windows = at[at + length <= ends[owner]]
    if not len(windows):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    padded = np.concatenate([hashes, np.zeros(seed, np.uint64)])
    grams = np.zeros(n, np.uint64)
    for j in range(seed):
        grams = mix(grams * _U(31) + padded[j : j + n])
    # the leftmost smallest gram of each window of reach + 1 grams, by doubling spans
    least, span = at, 1
    while span < reach + 1:
        step = min(span, reach + 1 - span)
        later = least[np.minimum(at + step, n - 1)]
        least, span = np.where(grams[later] < grams[least], later, least), span + step
    place = least[windows]
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    row = owner[place]
    begins = ends - counts
    front = np.minimum(reach, place - begins[row])
    back = np.minimum(reach, ends[row] - place - seed)
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)])
    around = mix((sums[place + seed + back] - sums[place - front]) * down[place - front])
    around = mix(around ^ (front.astype(np.uint64) << _U(32) | back.astype(np.uint64)))
    return row, place - begins[row], grams[place], around, front, back


def _find_anchors(batches, length: int, seed: int):
    for batch in batches:
        for first, hashes, counts in word_runs(batch.column("text")):
            row, place, gram, around, front, back = anchors(hashes, counts, length, seed)
            rows = pa.array(row + first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(gram.view(np.int64)),
                    pa.array(around.view(np.int64)), pa.array(place, pa.int32()), pa.array(front, pa.int8()), pa.array(back, pa.int8()),
                ],
                ["doc_id", "text_hash", "anchor", "around", "place", "front", "back"],
            )


def _surroundings(batches, reach: int, seed: int):
    """The word hashes around the anchors listed with each text."""
    names = ["anchor", "around", "n", "crowded", "place", "front", "back"]
    for batch in batches:
        for first, hashes, counts in word_runs(batch.column("text")):
            listed = batch.column("listed").slice(first, len(counts))
            entries = listed.flatten()
            number = listed.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(counts)), number)
            columns = {k: entries.field(k) for k in names}
            place, front, back = (columns[k].to_numpy().astype(np.int64) for k in ("place", "front", "back"))
            begin = (np.cumsum(counts) - counts)[row] + place - front
            sizes = front + seed + back
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            flat = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)
            hulls = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[flat].view(np.int64)))
            rows = pa.array(row + first)
            ids = [batch.column(c).take(rows) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*ids, *columns.values(), hulls], ["doc_id", "text_hash", *names, "hull"])


def extend(anchor: np.ndarray, before: np.ndarray, after: np.ndarray, front: np.ndarray, back: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which matches of full length a smaller document is part of: a row for each occurrence, a column for the words in front.

    ``before`` has the words in front of each anchor, nearest first, ``after`` those behind it; ``order`` ranks documents.
    """
    n, reach = before.shape
    names = lambda values: np.unique(values, return_inverse=True)[1].astype(np.int64)
    grown = [names(anchor)]
    for step in range(reach):
        # occurrences that share step + 1 words behind the anchor have one name
        grown.append(names(grown[-1] * n + names(after[:, step])))
    marks = np.zeros((n, reach + 1), bool)
    left = grown[0]
    for step in range(reach + 1):
        live = np.flatnonzero((front >= step) & (back >= reach - step))
        if len(live):
            match = names(left[live] * n + grown[reach - step][live])
            least = np.full(match.max() + 1, n)
            np.minimum.at(least, match, order[live])
            marks[live, step] = order[live] > least[match]
        if step < reach:
            left = names(left * n + names(before[:, step]))
    return marks


def _extended(table: pa.Table, length: int, seed: int) -> pa.Table:
    """One shard: the kept matches of its occurrences, as spans relative to the anchor."""
    reach, n = length - seed, table.num_rows
    table = table.combine_chunks()
    front, back = (table.column(c).to_numpy().astype(np.int64) for c in ("front", "back"))
    hulls = table.column("hull").combine_chunks()
    flat, begin = hulls.flatten().to_numpy(), hulls.offsets.to_numpy()[:-1]
    begin = begin - hulls.offsets[0].as_py()
    before, after = np.zeros((n, reach), np.int64), np.zeros((n, reach), np.int64)
    for step in range(reach):
        has = front > step
        before[has, step] = flat[begin[has] + front[has] - 1 - step]
        has = back > step
        after[has, step] = flat[begin[has] + front[has] + seed + step]
    ids = table.column("doc_id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    order = np.full(n, n - 1, np.int64)
    order[known] = np.unique(ids.drop_null().to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order[~known] = order[known].max(initial=-1) + 1
    marks = extend(table.column("anchor").to_numpy(), before, after, front, back, order)
    # runs of marked columns are one span
    edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    taken = table.take(pa.array(row)).select(["doc_id", "text_hash", "anchor", "around", "n", "place"])
    return taken.append_column("lower", pa.array(-last)).append_column("upper", pa.array(length - first))


def _smaller(least: Column, own: Column) -> Column:
    """Whether an id is smaller; a null one is the largest."""
    return F.coalesce(least < own, least.isNotNull())


def _rowwise(hulls: DataFrame, length: int, seed: int) -> DataFrame:
    """The kept matches of anchors with very many surroundings: a row for each window, grouped."""
    reach = length - seed
    ahead = F.explode(F.sequence(F.greatest(F.lit(0), reach - F.col("back")), F.least(F.col("front"), F.lit(reach)).cast("int")))
    windows = hulls.withColumn("ahead", ahead).withColumn("window", F.xxhash64(F.slice("hull", F.col("front") - F.col("ahead") + 1, length)))
    key = ["anchor", "ahead", "window"]
    windows = settle(windows.select("doc_id", "text_hash", "around", "n", "place", *key), "windows")
    figures = windows.groupBy(*key).agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    figures = settle(figures.filter("rows >= 2"), "window-groups")
    met = join_counted(windows, figures, key, "rows", windows.count()).filter(_smaller(F.col("least"), F.col("doc_id")))
    return met.select("doc_id", "text_hash", "anchor", "around", "n", "place", (-F.col("ahead")).alias("lower"), (length - F.col("ahead")).alias("upper"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(doc_id, text_hash, begin, end): spans of words that an earlier document holds; spans of a document may overlap.

    ``docs`` has doc_id, text_hash and text.
    """
    reach = length - seed
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {id_type}, text_hash int"
    long_enough = docs.filter(F.octet_length("text") >= 2 * length - 1)
    found = settle(
        long_enough.mapInArrow(
            lambda b: _find_anchors(b, length, seed), f"{columns}, anchor bigint, around bigint, place int, front tinyint, back tinyint"
        ),
        "anchors",
    )
    total = found.count()
    per_anchor = found.groupBy("anchor").agg(
        F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("doc_id").alias("known"),
        F.min("around").alias("some"), F.max("around").alias("other"),
    )
    # anchors of several documents; null ids are one more
    several = (F.col("low") != F.col("high")) | ((F.col("known") > 0) & (F.col("known") < F.col("rows")))
    repeated = settle(per_anchor.filter(several).select("anchor", "rows", (F.col("some") != F.col("other")).alias("mixed")), "repeated")
    again = settle(join_counted(found, repeated, ["anchor"], "rows", total).drop("rows"), "occurrences")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "place", "front", "back")
    matches = again.groupBy("anchor", "around").agg(F.count("*").alias("n"), F.max("mixed").alias("mixed"), F.min(first).alias("at"))
    matches = settle(matches.select("anchor", "around", "n", "mixed", "at.doc_id", "at.text_hash", "at.place", "at.front", "at.back"), "matches")

    # matches that extend in full: the smallest document stays, the others are covered
    ids = {"doc_id": "least", "text_hash": "least_hash", "place": "least_place"}
    shared = matches.filter("n >= 2").select("anchor", "around", "n", *[F.col(a).alias(b) for a, b in ids.items()])
    met = join_counted(again, shared, ["anchor", "around"], "n", again.count())
    met = met.withColumn("covered", _smaller(F.col("least"), F.col("doc_id")))
    same = (F.col("text_hash") == F.col("least_hash")) & (F.col("place") == F.col("least_place"))
    met = settle(met.filter(F.col("covered") | ~same).select("doc_id", "text_hash", "anchor", "around", "place", "front", "back", "covered"), "met")
    in_full = met.filter("covered").select(
        "doc_id", "text_hash", (F.col("place") - F.col("front")).alias("begin"), (F.col("place") + seed + F.col("back")).alias("end")
    )

    # different surroundings of one anchor
    mixed = matches.filter("mixed")
    per_mixed = settle(mixed.groupBy("anchor").agg(F.count("*").alias("kinds")).withColumn("crowded", F.col("kinds") > hot), "kinds")
    kinds = mixed.count()
    flagged = join_counted(mixed, per_mixed, ["anchor"], "kinds", kinds).filter("kinds >= 2")
    entry = F.struct("anchor", "around", "n", "crowded", "place", "front", "back")
    listed = flagged.groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).agg(F.collect_list(entry).alias("listed"))
    own = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    # rows of one id and one text would bring their surroundings twice, which changes nothing
    hulls = settle(
        long_enough.join(listed, own).select("doc_id", "text_hash", "text", "listed").mapInArrow(
            lambda b: _surroundings(b, reach, seed),
            f"{columns}, anchor bigint, around bigint, n bigint, crowded boolean, place int, front tinyint, back tinyint, hull array<bigint>",
        ),
        "surroundings",
    )
    shards = max(1, kinds // SHARD_ROWS)
    grown = (
        hulls.filter("not crowded").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
        .applyInArrow(lambda t: _extended(t, length, seed), f"{columns}, anchor bigint, around bigint, n bigint, place int, lower bigint, upper bigint")
    )
    grown = settle(grown.unionByName(_rowwise(hulls.filter("crowded"), length, seed)), "grown")
    alone = grown.select("doc_id", "text_hash", (F.col("place") + F.col("lower")).alias("begin"), (F.col("place") + F.col("upper")).alias("end"))
    # the same surroundings once more in the document that stands for them
    echoes = met.filter("not covered").join(grown.filter("n >= 2").select("anchor", "around", "lower", "upper"), ["anchor", "around"])
    echoes = echoes.select("doc_id", "text_hash", (F.col("place") + F.col("lower")).alias("begin"), (F.col("place") + F.col("upper")).alias("end"))
    return in_full.unionByName(alone).unionByName(echoes)


def _merged(spans) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return out


def _kept_words(text: bytes, spans: list[list[int]]) -> Iterator[tuple[int, list[bytes]]]:
    """(words, those kept) of each piece of a text."""
    at = 0
    for piece in pieces(text):
        words = piece.split()
        kept, done = [], 0
        for begin, end in spans:
            a, b = max(begin - at, 0), min(end - at, len(words))
            if a < b:
                kept += words[done:a]
                done = b
        yield len(words), kept + words[done:]
        at += len(words)


def _cut(batches, whole: bool):
    for batch in batches:
        texts, spans, out = batch.column("text"), batch.column("spans").to_pylist(), []
        for row in range(batch.num_rows):
            merged = _merged(spans[row])
            sha, total, left, parts = hashlib.sha256(), 0, 0, []
            for words, kept in _kept_words(texts[row].as_buffer().to_pybytes(), merged):
                if kept:
                    joined = (b" " if left else b"") + b" ".join(kept)
                    sha.update(joined)
                    if whole:
                        parts.append(joined)
                total, left = total + words, left + len(kept)
            if whole:
                out.append((b"".join(parts).decode(), [{"begin": a, "end": b} for a, b in merged]))
            else:
                out.append((total, total - left, sha.hexdigest()))
        types = [pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))] if whole else [pa.int64(), pa.int64(), pa.string()]
        columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *(["kept", "removed"] if whole else ["n_words", "n_removed", "kept_sha256"])])


def _judged(docs: DataFrame, id_col: str, text_col: str, whole: bool, schema: str, **limits) -> DataFrame:
    configure(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.hash("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(texts, **limits).groupBy(F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash")).agg(
        F.collect_set(F.struct("begin", "end")).alias("spans")
    )
    own = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash"))
    joined = texts.join(spans, own, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(lambda b: _cut(b, whole), f"doc_id {id_type}, {schema}")


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space)."""
    return _judged(docs, id_col, text_col, False, "n_words bigint, n_removed bigint, kept_sha256 string", **limits)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """A row per row of ``docs``: doc_id, the kept words joined by one space, and the spans of words removed."""
    return _judged(docs, id_col, text_col, True, "kept string, removed array<struct<begin:bigint,end:bigint>>", **limits)

"""Grouping of spelling variants, by k-d trees over letter counts.

Words are counted over all texts. Two words are near if they differ by exactly one inserted, deleted or replaced
character. A word's form is its near word of largest count (the smallest in code-point order of equals) if that is
at least RATIO times the word's own; its root is where following forms ends.

A word is a point whose coordinates count its letters (a to z each, all others in OTHERS buckets). One edit adds at
most one to one coordinate and takes at most one from another, so near words are at L1 distance of two at most. For
words of one length, both happen; from a word to those with one character more, only the first.

For each length, a k-d tree over a bounded sample of its points cuts space into cells; each word goes to the one cell
that holds its point, and asks all cells of its own length and of the next whose box it can reach with what one edit
may add and take. In its cell, points stand in a k-d tree of their own with tight boxes, which is searched for many
words at once; what remains is verified letter by letter. The sample decides how even cells are, never what is
found. A cell with more than CELL_WORDS words is dealt into blocks and asked block by block, so no task holds more.

Defined results: null and empty texts have no words; a text of any length is read in pieces that end between words;
repeated rows count again; words of one count tie by code-point order; an empty table gives an empty result. Only id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.words import RUN_BYTES
from tallyweave.session import configure, settle

LEAST_CHARS = 6
LEAST_COUNT = 5
RATIO = 5
#: Words of one cell, or of one of its blocks, and bytes of them.
CELL_WORDS = 4_000
BLOCK_CHARS = 1 << 20
#: Points from which the cells are made.
MAX_SAMPLE = 100_000
LEAF = 16
OTHERS = 6
DIMS = 26 + OTHERS
#: Distinct words that a task counts before it gives them out.
HELD_WORDS = 200_000

_DIM = np.array([c - 97 if 97 <= c <= 122 else 26 + c % OTHERS for c in range(256)], np.int16)
# every character as one byte: letters stay, A-Z in lower case, all others become a blank
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def text_words(text: str) -> Iterator[list[bytes]]:
    """The maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF), A-Z in lower case, as Latin-1 bytes."""
    data = text.encode("latin-1", "replace").translate(_LETTERS)
    begin = 0
    while begin < len(data):
        end = data.find(b" ", begin + RUN_BYTES)
        end = len(data) if end < 0 else end
        yield data[begin:end].split()
        begin = end


Change = Callable[[object, Counter], Counter]


def count_words(docs: DataFrame, change: Change | None = None, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts that are long and frequent enough.

    ``change`` takes an id and a document's words with their counts and returns other words with counts.
    ``docs`` has doc_id and text.
    """

    def run(batches):
        held: Counter = Counter()

        def given():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found: Counter = Counter()
                for words in text_words(text or ""):
                    found.update(words)
                for word, n in (change(doc_id, found) if change else found).items():
                    if len(word) >= least_chars:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield given()
        if held:
            yield given()

    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def drop_letters(doc_id: object, words: Counter, divisor: int = 199, least_chars: int = LEAST_CHARS) -> Counter:
    """A misspelling in some words of a document: where ``divisor`` divides h, the character at h modulo the length goes.

    h is the crc32 of ``<doc_id>:<word>`` in UTF-8, with nothing for a null id. Words of fewer than ``least_chars`` characters are left out.
    """
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in words.items():
        size = len(word)
        if size < least_chars:
            continue
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % divisor == 0:
            at = h % size
            word = word[:at] + word[at + 1 :]
        out[word] += n
    return out


def codes(words: list[str]) -> np.ndarray:
    """The characters of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def points(letters: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    dims = np.where(letters < 256, _DIM[np.minimum(letters, 255)], 26 + letters % OTHERS).astype(np.int64)
    flat = (np.arange(len(letters))[:, None] * DIMS + dims).ravel()
    return np.minimum(np.bincount(flat, minlength=len(letters) * DIMS), 30_000).reshape(-1, DIMS).astype(np.int16)


class Tree:
    """A k-d tree over some points: boxes of its nodes, and what its leaves hold.

    With ``whole``, boxes are those that the splits make, so that the leaves cover all space; else they are as tight
    as the points allow.
    """

    def __init__(self, at: np.ndarray, leaf: int, whole: bool = False):
        lower, upper, self.left, self.split, self.leaves = [], [], [], [], []
        least, most = np.full(DIMS, -1, np.int16), np.full(DIMS, 32_000, np.int16)
        waiting = [(np.arange(len(at)), least, most)]
        for rows, least, most in waiting:  # breadth first: children come behind all nodes so far
            held = at[rows]
            low, high = (held.min(axis=0), held.max(axis=0)) if len(rows) else (least, most)
            lower.append(least if whole else low)
            upper.append(most if whole else high)
            spread = (high > low) * (1 + held.astype(np.float32).var(axis=0)) if len(rows) > leaf else np.zeros(DIMS)
            if not spread.any():
                self.left.append(-1)
                self.split.append((0, 0))
                self.leaves.append(rows)
                continue
            dim = int(spread.argmax())
            cut = int(np.median(held[:, dim]))
            cut = min(max(cut, int(low[dim])), int(high[dim]) - 1)
            self.left.append(len(waiting))
            self.split.append((dim, cut))
            self.leaves.append(None)
            below = held[:, dim] <= cut
            top, bottom = most.copy(), least.copy()
            top[dim], bottom[dim] = cut, cut + 1
            waiting += [(rows[below], least, top), (rows[~below], bottom, most)]
        self.lower, self.upper = np.array(lower), np.array(upper)
        self.left = np.array(self.left)

    def reach(self, asked: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``asked``, leaf) of the leaves that an edit can reach: it adds ``more`` to counts and takes ``less`` at most."""
        row, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
        found = [(row[:0], node[:0])]
        while len(row):
            kept = []
            for begin in range(0, len(row), 1 << 16):
                part = slice(begin, begin + (1 << 16))
                here, box = asked[row[part]], node[part]
                add = np.maximum(self.lower[box] - here, 0).sum(axis=1, dtype=np.int64)
                take = np.maximum(here - self.upper[box], 0).sum(axis=1, dtype=np.int64)
                kept.append((add <= more) & (take <= less))
            kept = np.concatenate(kept)
            row, node = row[kept], node[kept]
            child = self.left[node]
            found.append((row[child < 0], node[child < 0]))
            row, child = row[child >= 0], child[child >= 0]
            row, node = np.concatenate([row, row]), np.concatenate([child, child + 1])
        return np.concatenate([r for r, _ in found]), np.concatenate([n for _, n in found])

    def home(self, at: np.ndarray) -> np.ndarray:
        """The leaf whose box holds each point."""
        row, node = self.reach(at, 0, 0)
        out = np.zeros(len(at), np.int64)
        out[row] = node
        return out


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of characters differ by one replacement, or by one insertion if those of ``long`` have one more."""
    size = short.shape[1]
    if long.shape[1] == size:
        return (short != long).sum(axis=1) == 1
    same_ahead = np.logical_and.accumulate(short == long[:, :size], axis=1).sum(axis=1)
    same_behind = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same_ahead + same_behind >= size


def search(words: np.ndarray, asked: np.ndarray, own: Tree | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``asked``, row of ``words``) of near words; ``asked`` has words as long or one character shorter."""
    tree = own or Tree(points(words), LEAF)
    at, here = points(words), points(asked)
    grows = words.shape[1] - asked.shape[1]
    row, leaf = tree.reach(here, 1, 1 - grows)
    sizes = np.array([0 if x is None else len(x) for x in tree.leaves])
    members = np.concatenate([x for x in tree.leaves if x is not None])
    starts = np.cumsum(sizes) - sizes
    hits = [(row[:0], row[:0])]
    step = max(1, (1 << 20) // max(words.shape[1], DIMS) // LEAF)
    for begin in range(0, len(row), step):
        r, n = row[begin : begin + step], leaf[begin : begin + step]
        many = sizes[n]
        left = np.repeat(r, many)
        right = members[np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[n], many)]
        change = at[right] - here[left]
        near = (np.maximum(change, 0).sum(axis=1) <= 1) & (np.maximum(-change, 0).sum(axis=1) <= 1 - grows)
        left, right = left[near], right[near]
        near = one_edit(asked[left], words[right])
        hits.append((left[near], right[near]))
    return np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits])


def _cells(words: DataFrame, cell_words: int, max_sample: int) -> dict[int, Tree]:
    """A tree for each length with more words than a cell takes, from a sample of all words of bounded size."""
    total = words.count()
    share = int(min(1.0, max_sample / max(total, 1)) * (1 << 30))
    part = F.pmod(F.xxhash64("word", F.lit("cells")), F.lit(1 << 30)) < F.lit(share)
    sample = [r[0] for r in words.filter(part).select("word").limit(2 * max_sample).collect()]
    by_length: dict[int, list[str]] = {}
    for word in sample:
        by_length.setdefault(len(word), []).append(word)
    leaf = max(1, int(cell_words * len(sample) / max(total, 1) / 2))
    return {size: Tree(points(codes(sorted(held))), leaf, whole=True) for size, held in by_length.items() if len(held) > leaf}


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, characters) of words, those of one length together in runs of bounded size."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, BLOCK_CHARS // int(size))
        for begin in range(0, len(rows), step):
            part = rows[begin : begin + step]
            yield int(size), part, codes([words[i] for i in part])


def _place(batches, cells: dict[int, Tree]):
    """Each word in its own cell (asks = false), and as a question to the cells it can reach."""
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for size, rows, letters in _by_length(words):
            at = points(letters)
            out = []
            for target, grows in ((size, 0), (size + 1, 1)):
                tree = cells.get(target)
                if not grows:
                    out.append((np.arange(len(rows)), tree.home(at) if tree else np.zeros(len(rows), np.int64), target, False))
                out.append((*(tree.reach(at, 1, 1 - grows) if tree else (np.arange(len(rows)), np.zeros(len(rows), np.int64))), target, True))
            for row, cell, target, asks in out:
                taken = rows[row]
                columns = [pa.array(np.full(len(row), target), pa.int32()), pa.array(cell, pa.int32()), pa.array(np.full(len(row), asks))]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("word").take(pa.array(taken)), pa.array(n[taken])], ["size", "cell", "asks", "word", "n"])


def _met(batches):
    """Sorted blocks, words before questions: the near pairs, both ways round."""
    current, held, held_n, letters, tree = None, [], [], None, None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("size", "cell", "block")], strict=True))
        asks, words, n = batch.column("asks").to_pylist(), batch.column("word").to_pylist(), batch.column("n").to_pylist()
        cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1] or asks[k] != asks[k - 1]], len(keys)]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin == end:
                continue
            if keys[begin] != current:
                current, held, held_n, tree = keys[begin], [], [], None
            if not asks[begin]:
                held, held_n, tree = held + words[begin:end], held_n + n[begin:end], None
                continue
            if not held:
                continue
            if tree is None:
                letters = codes(held)
                tree, held_n = Tree(points(letters), LEAF), list(held_n)
            for _, rows, asked in _by_length(words[begin:end]):
                left, right = search(letters, asked, tree)
                if not len(left):
                    continue
                a, b = [words[begin + i] for i in rows[left]], [held[i] for i in right]
                a_n, b_n = [n[begin + i] for i in rows[left]], [held_n[i] for i in right]
                out = [(a, b, b_n)]
                if asked.shape[1] < letters.shape[1]:  # words of one length meet twice, others once
                    out.append((b, a, a_n))
                for x, y, y_n in out:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(y_n, pa.int64())], ["word", "near", "near_n"])


def near_pairs(words: DataFrame, cell_words: int = CELL_WORDS, max_sample: int = MAX_SAMPLE) -> DataFrame:
    """(word, near, near_n): every pair of near words, both ways round. ``words`` has distinct words and n."""
    cells = _cells(words, cell_words, max_sample)
    placed = settle(words.select("word", "n").mapInArrow(lambda b: _place(b, cells), "size int, cell int, asks boolean, word string, n bigint"), "placed")
    # a question goes to every block of its cell, a word to one
    held = placed.filter("not asks").groupBy("size", "cell").agg(F.count("*").alias("held"))
    bound = F.greatest(F.lit(1), F.least(F.lit(cell_words), (F.lit(BLOCK_CHARS) / F.col("size")).cast("int")))
    blocks = settle(held.select("size", "cell", F.ceil(F.col("held") / bound).cast("int").alias("blocks")), "cells")
    dealt = placed.join(blocks, ["size", "cell"])
    each = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")))
    dealt = dealt.select("size", "cell", F.explode(each).alias("block"), "asks", "word", "n")
    keys = ["size", "cell", "block"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(_met, "word string, near string, near_n bigint")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): where following ``form`` from each word ends; the way ahead doubles each round.

    ``forms`` has word and form for words that have one; a form is always more frequent, so there are no rings.
    """
    ways = settle(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = ways.join(ahead, "root", "left")
        if not longer.filter("further is not null").limit(1).count():
            return ways
        ways = settle(longer.select("word", F.coalesce("further", "root").alias("root")), "ways")


def group_variants(words: DataFrame, ratio: int = RATIO, **limits) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n. ``words`` has distinct words and n."""
    configure(words.sparkSession)
    words = settle(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_pairs(words, **limits).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = words.join(near, "word", "left")
    fits = -F.col("best.less") >= ratio * F.col("n")
    known = settle(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow(known.filter("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

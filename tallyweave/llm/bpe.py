"""Byte-level BPE encoding and decoding with numpy matrices.

Inside a task the pieces that the pattern cuts from the texts are collected, and each piece not met before
is encoded: pieces of similar length form the rows of one padded matrix of token ids, and in each round
every row merges its leftmost pair of lowest rank, found by a hashed lookup of pairs; the rest of the row
moves up by one, and finished rows leave the matrix. Pieces met before come from a bounded cache.

Defined results: a null text encodes like an empty one (no ids), null ids decode to no bytes; ids of rows
pass through unchanged, null or repeated; an empty table gives an empty result. Texts of any length are
cut into bounded runs of pieces. Only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces cached by a worker before the cache is emptied; bounds memory, changes no result.
CACHE_PIECES = 150_000
#: Pieces handled at once.
RUN_PIECES = 150_000
#: Text handled at once, in characters; longer texts are cut between pieces.
RUN_CHARS = 750_000
#: Longer pieces are merged one by one with a heap, as a padded matrix would take a round per merge.
MATRIX_BYTES = 128
#: Cells and rows of a matrix at most.
MATRIX_CELLS = 1 << 18
MATRIX_ROWS = 20_000
NO_RANK = np.int32(2**31 - 1)
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of the merged token."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.bits = max(4, int(np.ceil(np.log2(max(len(pairs), 1)))) + 3)
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NO_RANK)
        self.probes, pending = 0, np.arange(len(keys))
        slots = self._slot(keys)
        while len(pending):
            at = (slots[pending] + self.probes) & ((1 << self.bits) - 1)
            free = self.keys[at] == np.uint64(2**64 - 1)
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            won = free & first
            self.keys[at[won]], self.values[at[won]] = keys[pending[won]], values[pending[won]]
            pending, self.probes = pending[~won], self.probes + 1

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The pairs as a dict, for merges one at a time."""
        used = self.keys != np.uint64(2**64 - 1)
        return dict(zip(self.keys[used].tolist(), self.values[used].tolist(), strict=True))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each merged pair, or NO_RANK."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        out, slots = np.full(keys.shape, NO_RANK), self._slot(keys)
        todo = np.arange(keys.size)
        keys, slots, flat = keys.ravel(), slots.ravel(), out.reshape(-1)
        for probe in range(self.probes):
            at = (slots[todo] + probe) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[todo]
            flat[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (held != np.uint64(2**64 - 1))]
            if not len(todo):
                break
        return out


class Coder:
    """Encodes pieces and decodes ids by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = Ragged.of(tokens)
        self.token_names = Ragged.of([b"%d " % i for i in range(size)])
        self._empty_cache()

    @cached_property
    def table(self) -> PairTable:
        """Made by the first merge; workers that only decode do without."""
        return PairTable(self.ranks)

    def _empty_cache(self) -> None:
        self.cache: dict[str, int] = {}
        self.store, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _merge_matrix(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of pieces of similar length: one padded row each, one merge per row and round."""
        sizes = np.array([len(p) for p in pieces])
        width = int(sizes.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids, result = self.byte_ids[raw], [None] * len(pieces)
        rows = np.arange(len(pieces))
        ranks = self.table.lookup(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), NO_RANK)
        ranks[np.arange(1, width)[None, :] >= sizes[:, None]] = NO_RANK
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            lowest = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NO_RANK)
            done = lowest == NO_RANK
            for i in np.flatnonzero(done):
                result[rows[i]] = ids[i, : sizes[i]].copy()
            live = ~done
            rows, ids, ranks, sizes, best, lowest = rows[live], ids[live], ranks[live], sizes[live], best[live], lowest[live]
            if not len(rows):
                break
            each = np.arange(len(rows))
            # close the gap: what stands right of the pair moves up by one
            column = np.arange(ids.shape[1] - 1)[None, :]
            ids = np.where(column <= best[:, None], ids[:, :-1], ids[:, 1:])
            ids[each, best] = lowest
            sizes = sizes - 1
            column = np.arange(ranks.shape[1] - 1)[None, :]
            ranks = np.where(column < best[:, None], ranks[:, :-1], ranks[:, 1:])
            for shift in (-1, 0):  # only the two pairs beside the merged token are new
                at = best + shift
                ok = (at >= 0) & (at + 1 < sizes)
                ranks[each[ok], at[ok]] = self.table.lookup(ids[each[ok], at[ok]], ids[each[ok], at[ok] + 1])
        return result

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece: the same merges in the same order, with a heap of (rank, place)."""
        ids, n, pairs = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist(), len(piece), self.table.pairs
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a in (left[i], i):
                b = right[a] if a >= 0 else n
                if a >= 0 and b < n and (r := pairs.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        result: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                result[k] = np.array([rank], np.int32)
            elif len(piece) > MATRIX_BYTES:
                result[k] = self._merge_long(piece)
            else:
                buckets.setdefault((len(piece) + 3) // 4, []).append(k)
        for quarter, members in buckets.items():
            each = max(1, min(MATRIX_ROWS, MATRIX_CELLS // (4 * quarter)))
            for a in range(0, len(members), each):
                part = members[a : a + each]
                for k, ids in zip(part, self._merge_matrix([pieces[k] for k in part]), strict=True):
                    result[k] = ids
        return result

    def encode_run(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of pieces in order, and how many each piece has."""
        if len(self.cache) > CACHE_PIECES:
            self._empty_cache()
        new = [p for p in dict.fromkeys(pieces) if p not in self.cache]
        if new:
            encoded = self.encode_pieces([p.encode() for p in new])
            lengths = np.array([len(x) for x in encoded], np.int64)
            self.starts = np.concatenate([self.starts, len(self.store) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.store = np.concatenate([self.store, *encoded])
            base = len(self.cache)
            self.cache.update((p, base + i) for i, p in enumerate(new))
        at = np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))
        return Ragged(self.store, self.starts, self.lengths).gather(at), self.lengths[at]

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text in bounded runs."""
        if len(text) <= RUN_CHARS:
            yield self.pattern.findall(text)
            return
        matches = (m.group() for m in self.pattern.finditer(text))
        while run := list(islice(matches, RUN_PIECES)):
            yield run

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        result: list[np.ndarray] = [None] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        pieces = 0

        def flush() -> None:
            nonlocal waiting, pieces
            ids, counts = self.encode_run([p for _, run in waiting for p in run])
            ends = np.cumsum(np.concatenate([[0], counts]))
            at = 0
            for k, run in waiting:
                result[k] = ids[ends[at] : ends[at + len(run)]]
                at += len(run)
            waiting, pieces = [], 0

        for k, text in enumerate(texts):
            if len(text) > RUN_CHARS:
                result[k] = np.concatenate([np.zeros(0, np.int32), *[self.encode_run(run)[0] for run in self.runs(text)]])
                continue
            run = next(self.runs(text))
            waiting.append((k, run))
            pieces += len(run)
            if pieces > RUN_PIECES:
                flush()
        flush()
        return result


class Ragged:
    """Rows of different lengths in one array."""

    def __init__(self, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.values, self.starts, self.lengths = values, starts, lengths

    @classmethod
    def of(cls, rows: list[bytes]) -> Ragged:
        lengths = np.array([len(r) for r in rows], np.int64)
        return cls(np.frombuffer(b"".join(rows), np.uint8), np.cumsum(lengths) - lengths, lengths)

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The chosen rows, one after the other."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[at] - (ends - lengths), lengths)
        return self.values[shift + np.arange(len(shift))]


_CODERS: dict[tuple[int, str], Coder] = {}


def _coder(data: bytes, pattern: str) -> Coder:
    key = (hash(data), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(parse_ranks(data), pattern)
    return _CODERS[key]


def _cuts(lengths: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to ``most`` or little more."""
    begin = total = end = 0
    for end, n in enumerate(lengths, 1):
        total += n or 0
        if total >= most:
            yield begin, end
            begin, total = end, 0
    if begin < end:
        yield begin, end


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _encoding(sent: Broadcast, pattern: str) -> Callable:
    """From batches (doc_id, text) to batches (doc_id, ids)."""

    def run(batches):
        coder = _coder(sent.value, pattern)
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(1)).to_pylist()
            for a, b in _cuts(lengths, 1_500_000):
                part = batch.slice(a, b - a)
                rows = coder.encode_many(part.column(1).to_pylist())
                offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])
        coder._empty_cache()  # workers live on after the task
        pa.default_memory_pool().release_unused()

    return run


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, in the order of ``docs``' partitions, without a shuffle.

    ``ranks`` is the content of a rank file, whose size bounds what is sent to the workers.
    """
    plain = _plain(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    return plain.mapInArrow(_encoding(sent, pattern), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def encode_and_check(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256): the ids of each text with digests of them and of the bytes they decode to.

    A batch is encoded and decoded by one worker, where ``encode`` and ``decode_digests`` in turn keep two for each task.
    """
    plain = _plain(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    encoding, decoding = _encoding(sent, pattern), _decoding(sent, pattern, whole=False, keep=True)
    id_type = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(lambda batches: decoding(encoding(batches)), f"doc_id {id_type}, ids array<int>, {DIGESTS}")


def decode_digests(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids), decoding the ids."""
    return _decoded(encoded, ranks, pattern, DIGESTS)


def decode(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes that the ids of each row stand for."""
    return _decoded(encoded, ranks, pattern, "decoded binary")


def _decoded(encoded: DataFrame, ranks: bytes, pattern: str, columns: str) -> DataFrame:
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    id_type = encoded.schema["doc_id"].dataType.simpleString()
    run = _decoding(sent, pattern, whole=columns.startswith("decoded"))
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, {columns}")


def _decoding(sent: Broadcast, pattern: str, whole: bool, keep: bool = False) -> Callable:
    """From batches (doc_id, ids) to batches of the decoded bytes, or of digests, beside the ids if they are kept."""

    def run(batches):
        coder = _coder(sent.value, pattern)
        for batch in batches:
            ids = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            for a, b in _cuts(pa.compute.list_value_length(ids).to_pylist(), 1_000_000):
                part = ids.slice(a, b - a)
                rows = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(part).to_numpy())]).astype(np.int64)
                flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                out = []
                for k in range(b - a):
                    out.append(_one(coder, flat[rows[k] : rows[k + 1]], whole))
                columns_out = [pa.array([x[i] for x in out], t) for i, t in enumerate([pa.binary()] if whole else [pa.int64(), pa.string(), pa.string()])]
                names = ["decoded"] if whole else ["n_tokens", "ids_sha256", "decoded_sha256"]
                held = [batch.column(0), ids][: 1 + keep]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in held), *columns_out], [*["doc_id", "ids"][: 1 + keep], *names])

    return run


def _one(coder: Coder, ids: np.ndarray, whole: bool) -> tuple:
    """The decoded bytes of one row, or its digests; long rows go part by part."""
    if whole:
        return (coder.token_bytes.gather(ids).tobytes(),)
    decoded, named = hashlib.sha256(), hashlib.sha256()
    for a in range(0, len(ids), 500_000):
        part = ids[a : a + 500_000]
        decoded.update(coder.token_bytes.gather(part))
        names = coder.token_names.gather(part)
        named.update(names[:-1] if a + 500_000 >= len(ids) else names)
    return len(ids), named.hexdigest(), decoded.hexdigest()

"""Hashes of the words of many texts at once, with numpy.

A word is a run of letters and digits in lower case (each byte above ASCII counts as a letter); words of more
than CUT_CHARS characters are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text handled at once, and where a longer text is cut (at white space if there is any).
RUN_BYTES = 750_000
CUT_CHARS = 400_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_IN_WORD = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0..n modulo 2^64, and their inverses."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, RUN_BYTES + 2 * CUT_CHARS)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _POWERS[:] = [
            np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b)]), dtype=np.uint64) for b in (_BASE, inverse)
        ]
    return _POWERS[0], _POWERS[1]


def _parts(text: str) -> Iterator[str]:
    begin = 0
    while len(text) - begin > CUT_CHARS:
        end = max(text.rfind(" ", begin, begin + CUT_CHARS), text.rfind("\n", begin, begin + CUT_CHARS))
        end = end + 1 if end >= begin else begin + CUT_CHARS
        yield text[begin:end]
        begin = end
    yield text[begin:]


def _hash_run(parts: list[bytes], prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the parts in order, hashes of the words' first bytes, and how many words each part has."""
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(data))
    sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), sums])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    heads = np.zeros(0, np.uint64)
    if prefix:
        heads = mix((sums[np.minimum(starts + prefix, ends)] - sums[starts]) * down[starts] + np.uint64(prefix))
        heads[ends - starts < prefix] = 0
    part_ends = np.cumsum([len(p) + 1 for p in parts])
    upto = np.searchsorted(starts, part_ends)
    return hashes, heads, np.diff(upto, prepend=0)


def word_hashes(texts: list[str | None], prefix: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, hashes, hashes of heads, words per row) for runs of rows; a null text has no words.

    With ``prefix``, a head is a word's first bytes, 0 for a shorter word. A run has bounded size unless a
    single text is larger.
    """
    first, parts, owners, size = 0, [], [], 0
    for row, text in enumerate(texts):
        for part in _parts((text or "").lower()):
            parts.append(part.encode("utf-8", "surrogatepass"))
            owners.append(row)
            size += len(parts[-1]) + 1
        if size >= RUN_BYTES:
            yield _run(first, row, parts, owners, prefix)
            first, parts, owners, size = row + 1, [], [], 0
    if owners:
        yield _run(first, owners[-1], parts, owners, prefix)


def _run(first: int, last: int, parts: list[bytes], owners: list[int], prefix: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    # a very long text is hashed part by part
    hashed, headed, counts, batch, size, begin = [], [], np.zeros(last - first + 1, np.int64), [], 0, 0
    for k, part in enumerate(parts):
        batch.append(part)
        size += len(part) + 1
        if size >= RUN_BYTES or k == len(parts) - 1:
            h, heads, n = _hash_run(batch, prefix)
            hashed.append(h)
            headed.append(heads)
            np.add.at(counts, np.array(owners[begin : k + 1]) - first, n)
            batch, size, begin = [], 0, k + 1
    return first, np.concatenate(hashed), np.concatenate(headed), counts

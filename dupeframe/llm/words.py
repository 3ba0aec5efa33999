"""Words and shingles of whole texts, for tasks that read texts as UTF-8 bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, functions as F

# A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

CHUNK_BYTES = 1 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def text_bytes(column: str | Column) -> Column:
    """The UTF-8 bytes of a text column; null is an empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def chunks(data: bytes, size: int = CHUNK_BYTES) -> Iterator[bytes]:
    """Cut a text at white space into pieces of about ``size`` bytes, so that the word list of a
    very long text is never held at once. No word is cut. ``bytes.split`` without an argument
    splits at exactly the six characters of ``GAP``."""
    gap, start = re.compile(rb"[\x20\x09-\x0D]"), 0
    while len(data) - start > size:
        found = gap.search(data, start + size)
        if not found:
            break
        yield data[start:found.start()]
        start = found.end()
    yield data[start:] if start else data


class WordHashes:
    """64-bit hashes of the words of texts, computed for all bytes of a text at once.

    A word's hash is the sum of its bytes (each + 1) times powers of an odd base, by its place in
    the word: differences of one running sum, divided by the power at which the word starts.
    """

    def __init__(self, lower: bool = False):
        self.lower = lower
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.gap = np.zeros(256, bool)
        self.gap[[0x20, *range(0x09, 0x0E)]] = True

    def _reach(self, size: int) -> None:
        if size > len(self.powers):
            size = max(1 << 12, 1 << size.bit_length())
            base = int(_PRIME)
            for name, step in (("powers", base), ("inverses", pow(base, -1, 1 << 64))):
                values = np.full(size, step, np.uint64)
                values[0] = 1
                setattr(self, name, np.cumprod(values, dtype=np.uint64))

    def of(self, data: bytes) -> np.ndarray:
        """The hashes of all words of a text, in order."""
        parts = [self._piece(piece.lower() if self.lower else piece) for piece in chunks(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _piece(self, data: bytes) -> np.ndarray:
        values = np.frombuffer(data, np.uint8)
        self._reach(len(values) + 1)
        edges = np.flatnonzero(np.diff(self.gap[values], prepend=True, append=True))
        if not len(edges):
            return np.empty(0, np.uint64)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.powers[:len(values)], out=sums[1:])
        starts, ends = edges[::2], edges[1::2]
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit hash for each window of ``size`` words, in order."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    value = hashes[:count].copy()
    for k in range(1, size):
        value *= _PRIME
        value += hashes[k:count + k]
    return mixed(value)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of windows; a shorter text is one shingle; no words, no shingles."""
    if 0 < len(hashes) < size:
        return windows(np.append(hashes, np.uint64(len(hashes))), len(hashes) + 1)
    found = windows(hashes, size)
    found.sort()
    if len(found) < 2:
        return found
    keep = np.empty(len(found), bool)
    keep[0] = True
    np.not_equal(found[1:], found[:-1], out=keep[1:])
    return found[keep]

"""Word spans and 64-bit word hashes of whole texts, computed on UTF-8 bytes with numpy.

The helpers work on the raw buffers of an Arrow string array, so a task never builds a
Python string per word.  Texts are taken in slices of a bounded number of bytes
(``slices``); one text is never split over two slices.

A word hash is a polynomial over random byte values, mod 2**64, taken from one running
sum; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse mod 2**64
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of text that one numpy step handles at once (a longer single text is one step).
SLICE_BYTES = 1 << 20


def byte_class(spec: str) -> np.ndarray:
    """A table of 256 booleans for the bytes named: ``space`` or ``word10`` (see below)."""
    table = np.zeros(256, dtype=bool)
    if spec == "space":  # \x20 \x09-\x0D
        table[[32, 9, 10, 11, 12, 13]] = True
    else:
        raise ValueError(spec)
    return table


SPACE = byte_class("space")
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32  # A-Z only; bytes of other letters stay


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads close values apart."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _STEP), ("down", _UNSTEP)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within the bytes) for runs of rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, body[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


class Words:
    """The words of a run of texts.

    starts, ends: byte spans; row: the text that each word belongs to (from 0);
    first: per text, the index of its first word, with the number of words at the end.
    """

    def __init__(self, body: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE):
        n = len(body)
        inside = np.zeros(n + 2, dtype=bool)
        inside[1:-1] = ~separator[body]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cut = offsets[(offsets > 0) & (offsets < n)]
        begins[cut] = inside[cut + 1]
        ends[cut - 1] = inside[cut]
        self.body = body
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, fold: np.ndarray = FOLD) -> np.ndarray:
        """One 64-bit hash a word, of its bytes after `fold`."""
        n = len(self.body)
        if n == 0:
            return np.zeros(0, dtype=np.uint64)
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[fold][self.body] * up[:n], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

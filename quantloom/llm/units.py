"""Units of texts that a tokenizer never merges across, and what a worker remembers of them.

A tokenizer's result on a text is the sequence of its results on the text's units, so that a
worker tokenises a unit once and looks it up by a 64-bit hash of its bytes afterwards.  The
memory is bounded: it starts anew when it is full.
"""

from __future__ import annotations

import numpy as np

from quantloom.llm.bytewords import _BYTE_VALUES, _powers, mix


def hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each span of bytes, of its bytes and its length."""
    up, down = _powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[body] * up[: len(body)], out=sums[1:])
    return mix(mix((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of runs that begin at `starts`, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Ragged:
    """Arrays of any lengths, kept end to end."""

    def __init__(self, dtype: type):
        self.data = np.empty(1024, dtype)
        self.ends = np.zeros(1, np.int64)

    def extend(self, values: np.ndarray, lengths: np.ndarray) -> None:
        used = int(self.ends[-1])
        if used + len(values) > len(self.data):
            self.data = np.concatenate([self.data[:used], np.empty(max(used, 2 * len(values)), self.data.dtype)])
        self.data[used : used + len(values)] = values
        self.ends = np.concatenate([self.ends, used + np.cumsum(lengths)])

    def lengths(self, entries: np.ndarray) -> np.ndarray:
        return self.ends[entries + 1] - self.ends[entries]

    def take(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arrays of `entries` end to end, and their lengths."""
        lengths = self.lengths(entries)
        return self.data[spread(self.ends[entries], lengths)], lengths


class Memo:
    """Hashes in sorted order with the number of their entry, from 0 in order of arrival."""

    def __init__(self):
        self.keys, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entries of `keys`, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.entries[at], -1)

    def add(self, keys: np.ndarray) -> np.ndarray:
        """New entries for `keys`, which are sorted and not known."""
        new = np.arange(len(self.keys), len(self.keys) + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.entries = np.insert(self.keys, at, keys), np.insert(self.entries, at, new)
        return new


def byte_letters() -> str:
    """The 256 letters that byte-level vocabularies write for the bytes: printable ones stay, others follow from 256 on."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in stay else next(others)) for b in range(256))


def pack_small(values: np.ndarray) -> bytes:
    """Numbers from 0 to 2**28 - 1 as one to four bytes of seven bits, the lowest first."""
    width = 1 + sum((values >= 1 << 7 * k).astype(np.int64) for k in (1, 2, 3)) if len(values) else np.zeros(0, np.int64)
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        has = width > k
        more = (width[has] > k + 1).astype(np.uint8) << 7
        out[ends[has] - width[has] + k] = (values[has] >> 7 * k & 127).astype(np.uint8) | more
    return out.tobytes()


def unpack_small(packed: bytes | np.ndarray) -> np.ndarray:
    b = np.frombuffer(packed, np.uint8) if isinstance(packed, bytes) else packed
    if not len(b):
        return np.zeros(0, np.int64)
    last = b < 128
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(b)]])))
    return np.add.reduceat((b & 127).astype(np.int64) << 7 * place, starts)

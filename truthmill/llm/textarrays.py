"""Words, rolling hashes and window minima of many texts at once, as numpy arrays in a task.

A batch of texts is one byte array with offsets. It is worked on in pieces of about two
megabytes (a longer text is a piece of its own), so memory follows the longest text and not
the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
LONG_WORD = 512
BLANKS = frozenset([0x20, *range(0x09, 0x0E)])
#: Bytes that part words of lower-cased letters and digits; bytes of other scripts belong to words.
NON_WORD = frozenset([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence: a polynomial modulo 2**64 with an odd base.

    For windows of bytes or of word hashes. Long patterns of only two values can agree (from 1,024 values on), so words themselves are
    hashed by ``word_hashes``.
    """

    def __init__(self, seed: int = 1):
        start = mix(np.arange(1, 259, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.bytes = start[:256]
        self.base = int(start[256]) | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of a sequence of 64-bit values (or of bytes), for ``stretch``."""
        if values.dtype == np.uint8:
            values = self.bytes[values]
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each stretch from start to before end."""
        return mix((sums[end] - sums[start]) * self.inverses[start])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each stretch of bytes, eight bytes mixed in at a time.

    Unlike sums of powers, which some long patterns of two letters leave equal whatever the base, a step mixes all that came before with the next bytes;
    stretches of one length and up to eight bytes never agree. Very long ones are hashed one by one.
    """
    padded = np.append(data, np.zeros(8, dtype=np.uint8))
    eights = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    out = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    left = np.flatnonzero((length > 0) & (length <= LONG_WORD))
    step = 0
    while len(left):
        rest = length[left] - 8 * step
        bits = np.uint64(8) * np.minimum(rest, 8).astype(np.uint64)
        part = eights[start[left] + 8 * step] << (np.uint64(64) - bits)  # drops the bytes behind the stretch
        out[left] = mix(out[left] ^ part) + np.uint64(seed)
        left, step = left[rest > 8], step + 1
    for i in np.flatnonzero(length > LONG_WORD):
        whole = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(4, "little"))
        out[i] = np.frombuffer(whole.digest(), dtype="<u8")[0]
    return out


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of about ``size`` bytes of a column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def words(data: np.ndarray, offsets: np.ndarray, parting: frozenset[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, end) of every word: longest runs of bytes that do not part words."""
    table = np.ones(256, dtype=bool)
    table[list(parting)] = False
    inside = np.zeros(len(data) + 1, dtype=bool)
    inside[:-1] = table[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside[:-1]
    before[offsets[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def first_of(docs: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each text's words in a sequence ordered by text: n + 1 positions."""
    return np.searchsorted(docs, np.arange(n + 1))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least value of each ``width`` neighbours; the first of equal ones.

    Values compare by their upper 32 bits, whatever the length of the sequence, so equal
    neighbours have the same minimum everywhere.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(32)
    least = ((values >> bits) << bits) | np.arange(n, dtype=np.uint64)
    reach = 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: n - width + 1], least[width - reach : n - reach + 1])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's long."""
    return x.view(np.int64)


def union_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for the positions that any of the stretches covers."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0

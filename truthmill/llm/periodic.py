"""Runs of words that repeat with a period, found by block convolution at doubling scales."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

EXPONENT = 4
LEAST_WORDS = 6
#: Words that are worked on at once; a longer text is worked on by itself.
WORDS_AT_ONCE = 1 << 18
#: Numbers in the transforms of one call.
CELLS = 1 << 17
# --- fixed value: prime of the number-theoretic transform, 15 * 2**27 + 1, and a generator -----
PRIME, GENERATOR = 2_013_265_921, 31
# ------------------------------------------------------------------------------------------------
_P = np.uint64(PRIME)


@cache
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(size // 2, dtype=np.uint64)
    step = 1
    while step < len(out):
        out[step : 2 * step] = out[:step][: len(out) - step] * np.uint64(pow(root, step, PRIME)) % _P
        step *= 2
    return out


def _forward(x: np.ndarray) -> np.ndarray:
    """Transforms of the columns, in bit-reversed order, in place."""
    size, n = x.shape
    half = size // 2
    while half:
        pairs = x.reshape(-1, 2, half, n)
        a, b = pairs[:, 0], pairs[:, 1]
        turn = _twiddles(2 * half, False)[None, :, None]
        total = a + b
        b[...] = (a + (_P - b)) * turn % _P
        a[...] = np.minimum(total, total - _P)  # below the prime the difference wraps to a large number
        half //= 2
    return x


def _backward(x: np.ndarray) -> np.ndarray:
    """The columns whose transforms these are, times their size, in place."""
    size, n = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(-1, 2, half, n)
        a, b = pairs[:, 0], pairs[:, 1]
        turned = b * _twiddles(2 * half, True)[None, :, None] % _P
        rest, total = a + (_P - turned), a + turned
        b[...] = np.minimum(rest, rest - _P)
        a[...] = np.minimum(total, total - _P)
        half *= 2
    return x


def mismatches(values: np.ndarray, block: int, first: int, n: int) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of n blocks with the stretches after them.

    Cell (d, i) compares block ``first + i`` with the words ``block + d`` further on, for all d
    below ``block``. Words that all agree give 0, which stands as the prime; a 0 of words that do not is possible but rare.
    The sum is that of both squares, from running totals, less twice the product, which is the convolution of the
    reversed block with the following window of two blocks.
    """
    at = (first + np.arange(n)) * block
    places = np.arange(block)[:, None]
    x = np.zeros((2 * block, n), dtype=np.uint64)
    x[:block] = values[at + block - 1 - places]
    y = values[at + block + np.arange(2 * block)[:, None]]
    both = _backward(_forward(x) * _forward(y) % _P)[block - 1 : 2 * block - 1]
    twice = both * np.uint64(2 * pow(2 * block, -1, PRIME) % PRIME) % _P
    stretch = values[first * block : (first + n + 3) * block]
    total = np.zeros(len(stretch) + 1, dtype=np.uint64)
    np.cumsum(stretch * stretch % _P, out=total[1:])
    at = np.arange(n) * block
    own = total[at + block] - total[at]
    its = total[at + 2 * block + places] - total[at + block + places]
    out = (own + its) % _P + (_P - twice)
    return np.where(out > _P, out - _P, out)  # the prime itself where all agree


def _leading(values: np.ndarray, at: np.ndarray, period: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many words from ``at`` on, in steps of 1 or -1, equal the word a period further, up to ``most``."""
    out = np.zeros(len(at), dtype=np.int64)
    rows = max(1, CELLS // max(most, 1))
    for lo in range(0, len(at) if most else 0, rows):
        part = slice(lo, lo + rows)
        place = at[part, None] + step * np.arange(most)[None, :]
        inside = place >= 0
        place = np.maximum(place, 0)
        differ = ~(inside & (values[place] == values[place + period[part, None]]))
        out[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
    return out


def find_runs(texts: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST_WORDS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all maximal runs of the texts' words, given as numbers from 0.

    At scale B the periods from B to 2B - 1 are found: a run of three periods and more holds a whole block of B words (blocks start
    at multiples of B) that stands again one period further on, in the window of two blocks after it. Such places are
    compared word by word, those of neighbouring blocks with the same distance put together, and extended by
    less than a block on both sides. A place inside a run of a smaller period is one of its multiples and is passed over, so
    what is left has its smallest period.
    """
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if len(sizes) else sizes
    words = int(max((t.max() for t in texts if len(t)), default=-1)) + 1
    whole = np.empty(int((sizes + 1).sum()), dtype=np.uint64)
    for i, (text, at) in enumerate(zip(texts, starts)):
        whole[at : at + len(text)] = text
        whole[at + len(text)] = words + i  # a word of its own after every text, so no run goes on into the next
    reach = np.zeros(len(whole), dtype=np.int64)
    runs: list[np.ndarray] = []
    block = 1
    while True:
        taken = np.flatnonzero(sizes >= max(least, exponent * block))
        if not len(taken):
            break
        length = sizes[taken] + 1
        offset = np.cumsum(length) - length
        origin = np.repeat(starts[taken] - offset, length)
        origin += np.arange(len(origin))  # place in ``whole`` of every word at this scale
        longest = np.repeat(sizes[taken] // exponent, length)
        n_blocks = -(-len(origin) // block)
        values = np.full((n_blocks + 3) * block, words + len(texts), dtype=np.uint64)
        values[: len(origin)] = whole[origin]
        at, period = _places(values, block, n_blocks)
        known = (period <= longest[at]) & (reach[origin[at]] < origin[at] + period + block)
        at, period = at[known], period[known]
        true = _leading(values, at, period, 1, block) == block
        at, period = at[true], period[true]
        if len(at):
            order = np.lexsort((at, period))
            at, period = at[order], period[order]
            joint = (np.diff(at) == block) & (np.diff(period) == 0)
            first, last = np.concatenate([[True], ~joint]), np.concatenate([~joint, [True]])
            period, end = period[first], at[last] + block
            at = at[first]
            begin = at - _leading(values, at - 1, period, -1, block - 1)
            end = end + _leading(values, end, period, 1, block - 1) + period
            enough = end - begin >= np.maximum(least, exponent * period)
            begin, size = origin[begin[enough]], (end - begin)[enough]
            runs.append(np.stack([begin, size, period[enough]]))
            np.maximum.at(reach, begin, begin + size)
            reach = np.maximum.accumulate(reach)
        block *= 2
    begin, size, period = np.concatenate(runs, axis=1) if runs else np.zeros((3, 0), dtype=np.int64)
    text = np.searchsorted(starts, begin, side="right") - 1
    order = np.lexsort((period, begin))
    return text[order], (begin - starts[text])[order], size[order], period[order]


def _places(values: np.ndarray, block: int, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the blocks that seem to stand again, at distances from B to 2B - 1."""
    step = max(1, CELLS // (2 * block))
    found = []
    for first in range(0, n_blocks, step):
        distance, i = np.nonzero(mismatches(values, block, first, min(step, n_blocks - first)) == _P)
        found.append(((first + i) * block, distance + block))
    at, period = (np.concatenate(x) for x in zip(*found))
    return at, period


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Each text's words as numbers, equal for equal words."""
    seen: dict[bytes, int] = {}
    number = lambda w: seen.setdefault(w, len(seen))
    return [np.fromiter(map(number, text), dtype=np.int64, count=len(text)) for text in texts]


def _collapsed(exponent: int, least: int) -> Callable:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batches_of(column: pa.Array) -> Iterator[list[list[bytes]]]:
        group, n = [], 0
        for text in column:
            words = (text.as_py() or "").encode().split()  # blanks are those of bytes.split: space and 09 to 0D
            if group and n + len(words) > WORDS_AT_ONCE:
                yield group
                group, n = [], 0
            group.append(words)
            n += len(words)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in batches_of(batch.column("_text")):
                text, start, length, period = find_runs(_numbered(texts), exponent, least)
                bounds = np.searchsorted(text, np.arange(len(texts) + 1))
                kept = []
                for i, words in enumerate(texts):
                    own = slice(bounds[i], bounds[i + 1])
                    if own.start < own.stop:
                        steps = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(steps, start[own] + period[own], 1)
                        np.add.at(steps, start[own] + length[own], -1)
                        words = [words[j] for j in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]
                    kept.append(b" ".join(words).decode())
                fields = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), fields).cast(kind)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").slice(lo, n), pa.array([len(w) for w in texts], pa.int64()), runs, pa.array(kept, pa.string())],
                    names=["_key", "n_words", "runs", "kept_text"],
                )
                lo += n

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST_WORDS) -> DataFrame:
    """Every stretch of words that repeats with a smallest period, at least ``exponent`` times and ``least`` words long.

    Words are parted by space and the characters 09 to 0D. A run is as long as its period holds; runs of different periods may
    overlap. Returns key, n_words, runs (start, length and period, sorted by start, then period) and kept_text: the words, joined
    by one space, less all that a run holds after its first period. One row per input row, without a shuffle. A null or empty text has no
    words and no runs; repeated rows are rows of their own; an empty table gives no rows. Other columns are
    not read. Memory follows the longest text. ``exponent`` is a whole number, 3 at least: the blocks that seed a run need
    three periods.
    """
    if exponent < 3:
        raise ValueError("blocks seed only runs of three periods and more")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string"
    return rows.mapInArrow(_collapsed(exponent, least), schema).withColumnRenamed("_key", key)

"""Deletion of byte strings that start anywhere else too, by distributed prefix doubling.

Positions are ranked by growing stretches of the text until they are unique or the stretch
has the full length; each round is a Spark sort of pairs of ranks and names.

1. Equal windows have equal minimisers: the ``k`` bytes in them with the least hash. Neighbouring
   windows of one minimiser are one slice. Minimisers are counted, and the positions under those that stand once leave.
2. Equal slices are one class; all windows of a class of two or more repeat. Minimisers with one class end here.
3. The other classes enter the rounds with one slice each. A window's place is told by the
   distance of its start from the minimiser, and neighbouring distances that share a cell travel as one row. The stretch
   that all windows of a cell have in common holds the minimiser's neighbourhood and grows as the cells
   shrink: of 400 bytes, 145 in cells of 256 places, then 337, 385, 397 and 400.
4. A round pairs the row's rank (what it shares so far) with the name of the longer stretch.
   Pairs that stand once leave: none of their windows repeats. Rows that agree in all bytes of their windows repeat; one of
   them stays for the others to meet. What is left is sorted by range, and its place in the order is its next rank.

Names are two independent 64-bit hashes. Rows are counted before they travel, so a frequent
minimiser arrives once per task and class, and no step gathers a group in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from truthmill.llm.repeats import Units, flat_spans, keyed, super_windows, with_spans
from truthmill.llm.textarrays import pieces, signed, union_mask
from truthmill.operators.shared import dense_index, stored

WINDOW = 400
MINIMISER = 100
#: A cell is dealt to so many smaller ones after each round.
SHRINK = 4
#: Bytes of text worked on at once: every byte is a position with several 64-bit numbers, and as many at a time as fit a core's cache are also faster.
PIECE = 1 << 18


def _slices(window: int, k: int) -> Callable:
    """Every slice: its minimiser, place, number of windows, place of the minimiser in it, and name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(by_words=False)
        for batch in batches:
            for lo, _, data, offsets in pieces(batch.column("_text"), PIECE):
                units.read(data, offsets)
                found, first, count, anchor = super_windows(units, window, k)
                names = [signed(units.hashes(i, units.sums(i), first, count + window - 1)) for i in (0, 1)]
                row = pa.array(lo + units.doc[first])
                numbers = (first - units.first[units.doc[first]], count, anchor - first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(found)), batch.column("_key").take(row), batch.column("_mark").take(row), *map(pa.array, numbers), *map(pa.array, names)],
                    names=["h", "_key", "_mark", "first", "n", "anchor", "s1", "s2"],
                )

    return run


def _bytes_of(window: int) -> Callable:
    """The bytes of the slices listed beside a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_list")
            for lo, hi, data, offsets in pieces(batch.column("_text"), PIECE):
                part = lists.slice(lo, hi - lo)
                row = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                sid, first, n, anchor = (part.flatten().field(i) for i in range(4))
                start = offsets[row] + first.to_numpy(zero_copy_only=False)
                end = start + n.to_numpy(zero_copy_only=False) + window - 1
                raw = data.tobytes()
                packed = pa.array([raw[a:b] for a, b in zip(start.tolist(), end.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([sid, anchor, packed], names=["sid", "anchor", "packed"])

    return run


def _cells(window: int, furthest: int, width: int) -> Callable:
    """The open places of a slice in cells of ``width``, with the names of what their windows share and of all their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(by_words=False)
        for batch in batches:
            anchors = batch.column("anchor").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in pieces(batch.column("packed"), PIECE):
                units.read(data, offsets)
                part = batch.column("_open").slice(lo, hi - lo)
                row = np.repeat(np.arange(lo, hi), part.value_lengths().to_numpy(zero_copy_only=False))
                rank, known, near, far = (part.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(4))
                count = far // width - near // width + 1
                i = np.repeat(np.arange(len(row)), count)
                cell = near[i] // width + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
                least, most = cell * width, np.minimum(cell * width + width - 1, furthest)
                near, far = np.maximum(near[i], least), np.minimum(far[i], most)
                zero = offsets[row[i] - lo] + anchors[row[i]]
                names = []
                for a, b in ((least, most), (far, near)):
                    names += [signed(units.rolls[w].stretch(units.sums(w), zero - a, zero - b + window)) for w in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("sid").take(pa.array(row[i])), *map(pa.array, (rank[i], known[i], cell, near, far, *names))],
                    names=["sid", "rank", "known", "cell", "near", "far", "c1", "c2", "u1", "u2"],
                )

    return run


def _repeated_slices(docs: DataFrame, key: str, text: str, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all slices of repeated minimisers, their classes, one slice of each class that meets others)."""
    rows = keyed(docs, key, text).select("_key", "_mark", "_text")
    every = rows.mapInArrow(_slices(window, k), "h long, _key long, _mark long, first long, n long, anchor long, s1 long, s2 long")
    every = stored(every.withColumn("sid", F.monotonically_increasing_id()))
    again = stored(every.groupBy("h").count().filter("count > 1").select("h"))  # stored: both sides of the join are then shuffles, which split if skewed
    some = stored(every.join(again, "h"))
    classes = some.groupBy(*_SLICE).agg(F.min("sid").alias("sid"), (F.count("*") > 1).alias("known"))
    classes = stored(classes)
    mixed = classes.groupBy("h").agg(F.count("*").alias("classes"), F.min("known").alias("settled")).filter("classes > 1 and not settled")
    return some, classes, stored(classes.join(stored(mixed.select("h")), "h").select("sid", "known"))


_SLICE = ("h", "s1", "s2", "n", "anchor")
_PAIR = ("rank", "cell", "c1", "c2")
_ALIKE = (*_PAIR, "u1", "u2", "near", "far")


def _rounds(slices: DataFrame, open_: DataFrame, window: int, k: int) -> list[DataFrame]:
    """(sid, near, far) of the places found to repeat, one table for each round."""
    width = 1
    while width * SHRINK <= window - k:
        width *= SHRINK
    found = []
    while True:
        lists = open_.groupBy("sid").agg(F.collect_list(F.struct("rank", "known", "near", "far")).alias("_open"))
        cells = slices.join(lists, "sid").select("sid", "anchor", "packed", "_open").mapInArrow(
            _cells(window, window - k, width),
            "sid long, rank long, known boolean, cell long, near long, far long, c1 long, c2 long, u1 long, u2 long",
        )
        rows = stored(cells)
        alike = rows.groupBy(*_ALIKE).agg(F.min("sid").alias("sid"), F.max("known").alias("known"), (F.count("*") > 1).alias("repeats"))
        alike = stored(alike)
        found.append(rows.filter("not known").join(alike.filter("repeats").select(*_ALIKE), [*_ALIKE]).select("sid", "near", "far"))
        if width == 1:
            return found
        alike = alike.withColumn("known", F.col("known") | F.col("repeats"))
        pairs = alike.groupBy(*_PAIR).agg(F.count("*").alias("n"), F.min("known").alias("settled")).filter("n > 1 and not settled")
        ranks = stored(dense_index(pairs.select(*_PAIR), *_PAIR, name="next"))
        open_ = stored(alike.join(ranks, [*_PAIR]).select("sid", F.col("next").alias("rank"), "known", "near", "far"))
        if open_.isEmpty():
            return found
        width //= SHRINK


def repeated_strings(docs: DataFrame, key: str, text: str, window: int = WINDOW, k: int = MINIMISER) -> DataFrame:
    """(_key, _mark, _starts, _ends) of the documents with strings of ``window`` bytes that start anywhere else too."""
    some, classes, mixed = _repeated_slices(docs, key, text, window, k)
    whole = some.join(classes.filter("known").select(*_SLICE), [*_SLICE])
    spans = whole.select("_key", "_mark", F.col("first").alias("start"), (F.col("first") + F.col("n") - 1 + window).alias("end"))

    place = F.struct("sid", "first", "n", "anchor")
    ones = stored(some.join(mixed, "sid"))
    lists = ones.groupBy("_key", "_mark").agg(F.collect_list(place).alias("_list")).withColumnsRenamed({"_key": "_k", "_mark": "_m"})
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m"))
    texts = keyed(docs, key, text).join(lists.hint("shuffle_hash"), same).select("_text", "_list")
    # rows of one key and text are the same document read twice
    slices = stored(texts.mapInArrow(_bytes_of(window), "sid long, anchor long, packed binary").dropDuplicates(["sid"]))
    near = F.col("anchor") - F.col("n") + 1
    open_ = ones.select("sid", F.col("h").alias("rank"), "known", near.alias("near"), F.col("anchor").alias("far"))
    for places in _rounds(slices, open_, window, k):
        start, end = F.col("first") + F.col("anchor") - F.col("far"), F.col("first") + F.col("anchor") - F.col("near") + window
        spans = spans.unionByName(places.join(ones, "sid").select("_key", "_mark", start.alias("start"), end.alias("end")))
    return spans.groupBy("_key", "_mark").agg(F.collect_list("start").alias("_starts"), F.collect_list("end").alias("_ends"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in pieces(batch.column("_text"), PIECE):
            row, a, b = flat_spans(batch.column("_starts").slice(lo, hi - lo), batch.column("_ends").slice(lo, hi - lo))
            gone = union_mask(len(data), offsets[row] + a, offsets[row] + b)
            doc = np.repeat(np.arange(hi - lo), np.diff(offsets))
            starts = gone.copy()
            starts[1:] &= ~gone[:-1] | (doc[1:] != doc[:-1])
            left = np.append(0, np.cumsum(~gone))[offsets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").slice(lo, hi - lo),
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(offsets) - np.diff(left)),
                    pa.array(np.bincount(doc[starts], minlength=hi - lo)),
                    pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary()),
                ],
                names=["_key", "n_bytes", "n_removed", "n_spans", "kept"],
            )


def drop_repeated_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = MINIMISER) -> DataFrame:
    """Each text without the bytes in strings of ``window`` bytes that start anywhere else too.

    Returns key, n_bytes, n_removed, n_spans (longest removed stretches) and kept (the
    remaining bytes), one row per input row. A null text is empty. Strings are judged on the
    input and do not cross texts; repeated rows are copies of each other. A null key stays
    null; other columns are not read.
    """
    found = repeated_strings(docs, key, text, window, k)
    cut = with_spans(docs, key, text, found).mapInArrow(_cut, "_key long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select(F.col("_key").alias(key), "n_bytes", "n_removed", "n_spans", "kept")

"""Deletion of passages of words that an earlier document holds too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from truthmill.llm.repeats import HOT, flat_spans, repeated_stretches, with_spans
from truthmill.llm.textarrays import BLANKS, pieces, union_mask, words

WINDOW = 50
MINIMISER = 12


def joined_words(data: np.ndarray, offsets: np.ndarray, doc, start, end, kept) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each text's kept words, joined by one blank."""
    doc, start, end = doc[kept], start[kept], end[kept]
    followed = np.zeros(len(doc), dtype=bool)
    followed[:-1] = doc[1:] == doc[:-1]
    data = np.append(data, np.uint8(0))
    steps = np.zeros(len(data) + 1, dtype=np.int8)
    steps[start] += 1
    data[end[followed]] = 0x20
    np.add.at(steps, end + followed, -1)  # the blank behind a followed word stays with it
    taken = np.cumsum(steps[:-1], dtype=np.int8) > 0
    return data[taken], np.append(0, np.cumsum(taken))[offsets]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in pieces(batch.column("_text")):
            doc, start, end = words(data, offsets, BLANKS)
            first = np.searchsorted(doc, np.arange(hi - lo + 1))
            row, a, b = flat_spans(batch.column("_starts").slice(lo, hi - lo), batch.column("_ends").slice(lo, hi - lo))
            gone = union_mask(len(doc), first[row] + a, first[row] + b)
            kept, at = joined_words(data, offsets, doc, start, end, ~gone)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_key").slice(lo, hi - lo),
                    pa.array(np.diff(first)),
                    pa.array(np.bincount(doc[gone], minlength=hi - lo)),
                    pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(kept)).cast(pa.string()),
                ],
                names=["_key", "n_words", "n_removed", "kept_text"],
            )


def drop_repeated_passages(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = MINIMISER, hot: int = HOT
) -> DataFrame:
    """Each text without the words in windows that also start in a document of a smaller key.

    Super-k-mers: neighbouring windows of words that share their least-hashed ``k`` words
    travel as one packed slice to the bucket of that minimiser, where sorting counts the
    windows exactly. See ``repeats`` for the steps.

    Returns key, n_words, n_removed and kept_text (kept words joined by one blank), one row
    per input row. Windows are judged on the input. Null and empty texts, and texts shorter
    than a window, keep all their words. Rows of one key do not count against each other;
    a null key counts as the smallest. Other columns are not read.
    """
    found = repeated_stretches(docs, key, text, window, k, by_words=True, later=True, hot=hot)
    cut = with_spans(docs, key, text, found).mapInArrow(_cut, "_key long, n_words long, n_removed long, kept_text string")
    return cut.select(F.col("_key").alias(key), "n_words", "n_removed", "kept_text")

"""Best-fit packing of token sequences, planned on the histogram of their lengths."""

from __future__ import annotations

import bisect
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from truthmill.operators.shared import stored

CAPACITY = 2048
#: Up to so many counts (one for each task and length) travel to every task; more are joined by a shuffle.
SENT_COUNTS = 500_000
_SPREAD = 1 << 48


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: rows (length, first rank, first bin, each bin's share, offset).

    Bins of the same free space are one group, so a step places all items of one length
    that a group can take. Each row uses up a group or is one of the last two of its length, so
    there are at most a few rows for every length and free space, whatever the counts.
    """
    rows: list[tuple[int, int, int, int, int]] = []
    free: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def opened(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in groups:
                bisect.insort(free, space)
                groups[space] = []
            groups[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, n = groups[space].pop()
                if not groups[space]:
                    del groups[space], free[at]
            else:
                space, first, n = capacity, bins, -(-left // (capacity // length))
                bins += n
            each = space // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - space))
                opened(space - each * length, first, full)
                left, rank, first, n = left - full * each, rank + full * each, first + full, n - full
            if left and n:  # fewer than a bin's share: only at the end of a length
                rows.append((length, rank, first, left, capacity - space))
                opened(space - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            opened(space, first, n)
    return rows


def byte_alphabet() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others above 255."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    With the pattern by which a byte-level tokenizer cuts texts, Latin texts are encoded by the
    same vocabulary as byte ranks, which gives the same ids (the tests compare them) in a third of the time. Texts with
    other letters, whose classes differ between Unicode versions, and texts that hold an added token's string go
    through the tokenizer, and all texts do without a pattern.
    """

    def __init__(self, path: str, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = None
        if pattern:
            import tiktoken

            letters = byte_alphabet()
            vocabulary = json.loads(self.tokenizer.to_str())["model"]["vocab"]
            ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocabulary.items() if token not in self.special}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.not_latin = re.compile("[^\x00-\u024f\u2000-\u206f]").search

    def __call__(self, text: str) -> bytes:
        if self.ranks is None or self.not_latin(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def _tokenised(path: str, pattern: str | None, end: int, capacity: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(path, pattern), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        last = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                texts = [text or "" for text in batch.column("_text").slice(lo, 256).to_pylist()]
                for i, ids in enumerate(map(encode, texts), lo):
                    ids += last
                    n = len(ids) // 4
                    start, length = 0, n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        rows.append((i, piece, start, length, seen[length], ids[4 * start : 4 * (start + length)]))
                        seen[length] += 1
                        start, length = start + length, capacity
                at, *columns = zip(*rows)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_key").take(pa.array(at)), pa.array([part] * len(rows), pa.int32()), *map(pa.array, columns, kinds)],
                    names=["_key", "part", "piece", "start", "length", "nth", "ids"],
                )

    return run


def pack(
    docs: DataFrame, tokenizer: str, pattern: str | None = None, key: str = "doc_id", text: str = "text",
    end: int = 0, capacity: int = CAPACITY,
) -> DataFrame:
    """Texts as token ids, packed into as few sequences of at most ``capacity`` tokens as best fit finds.

    A text's ids are followed by ``end``. Longer texts are cut into pieces of the capacity, the
    first piece taking what is over. The plan is made on the driver from the number of
    pieces of each length (at most ``capacity`` numbers); a piece then takes the planned slot of
    its rank among the pieces of its length. Ranks are a piece's number in its task plus
    the number of such pieces in earlier tasks, so no length meets in one task.

    ``tokenizer`` is the path of a vocabulary file that every executor has. Returns key,
    piece, start, length, ids (little-endian 32-bit), sequence_id and offset, one row for each
    piece. A null or empty text is its end token alone. Repeated rows are packed each; an
    empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    schema = f"_key {kind}, part int, piece int, start long, length long, nth long, ids binary"
    rows = stored(rows.mapInArrow(_tokenised(tokenizer, pattern, end, capacity), schema))
    counts = stored(rows.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = dict(counts.groupBy("length").agg(F.sum("n")).collect())
    table = np.array(sorted(plan(histogram, capacity)), dtype=np.int64).reshape(-1, 5)
    starts = table[:, 0] * _SPREAD + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        of = table[np.searchsorted(starts, (length * _SPREAD + rank).to_numpy(), side="right") - 1]
        number = rank.to_numpy() - of[:, 1]
        return pd.DataFrame({"sequence_id": of[:, 2] + number // of[:, 3], "offset": of[:, 4] + number % of[:, 3] * of[:, 0]})

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    if counts.count() <= SENT_COUNTS:
        before = F.broadcast(before)
    ranked = rows.join(before, ["part", "length"]).withColumn("slot", slot("length", F.col("nth") + F.col("before")))
    return ranked.select(F.col("_key").alias(key), "piece", "start", "length", "ids", "slot.sequence_id", "slot.offset")

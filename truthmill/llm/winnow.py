"""Words of documents that stand in a benchmark, by winnowed fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from truthmill.llm.textarrays import NON_WORD, Rolling, lowered, pieces, signed, window_minima, word_hashes, words
from truthmill.operators.shared import stored

WINDOW = 10
GRAM = 5
#: Up to so many benchmark fingerprints (8 bytes each) travel to every task; more are joined by a shuffle.
SENT_FINGERPRINTS = 2_000_000

_HITS = "_row long, n_words long, f long, length int, start int, w1 long, w2 long"


class Windows:
    """Fingerprints and hashes of the word windows of a piece of texts."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.word_rolls = Rolling(3), Rolling(4)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = lowered(data)
        self.doc, start, end = words(data, offsets, NON_WORD)
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.sums = [roll.sums(word_hashes(data, start, end, seed)) for seed, roll in enumerate(self.word_rolls, 1)]

    def hashes(self, at: np.ndarray, length: int | np.ndarray) -> list[np.ndarray]:
        return [roll.stretch(s, at, at + length) for roll, s in zip(self.word_rolls, self.sums)]

    def full(self) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every full window: its gram with the least hash."""
        n = len(self.doc)
        if n < self.window:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        grams = self.hashes(np.arange(n - self.gram + 1), self.gram)[0]
        least = window_minima(grams, self.window - self.gram + 1)
        at = np.flatnonzero(self.doc[: n - self.window + 1] == self.doc[self.window - 1 :])
        return at, grams[least[at]]

    def grams(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``length`` words of one text."""
        n = len(self.doc)
        if n < length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[: n - length + 1] == self.doc[length - 1 :])
        return at, self.hashes(at, length)[0]


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(len(x), dtype=bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _items(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Windows(window, gram)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("_text")):
                made.read(data, offsets)
                at, prints = made.full()
                size = np.diff(made.first)
                short = np.flatnonzero((size > 0) & (size < window))
                owner = np.concatenate([made.doc[at], short])
                length = np.concatenate([np.full(len(at), window), size[short]])
                one, two = made.hashes(np.concatenate([at, made.first[short]]), length)
                prints = np.concatenate([prints, one[len(at) :]])  # a short item is its own fingerprint
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_item").take(pa.array(lo + owner)), pa.array(length.astype(np.int32)),
                        pa.array(signed(prints)), pa.array(signed(one)), pa.array(signed(two)),
                    ],
                    names=["item", "length", "f", "w1", "w2"],
                )

    return run


def _hits(window: int, gram: int, lengths: list[int], sent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Windows(window, gram)
        known = None if sent is None else sent.value
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("_text")):
                made.read(data, offsets)
                rows = np.asarray(batch.column("_row").slice(lo, hi - lo))
                parts = []
                for length in lengths:
                    at, prints = made.full() if length == window else made.grams(length)
                    if known is not None:
                        hit = _among(prints, known.get(length, np.zeros(0, dtype=np.uint64)))
                        at, prints = at[hit], prints[hit]
                    parts.append((np.full(len(at), length, dtype=np.int32), at, prints, *made.hashes(at, length)))
                length, at, prints, one, two = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 4)
                n, m = hi - lo, len(at)
                none = np.arange(n + m) < n
                pad = lambda x, kind: pa.array(np.concatenate([np.zeros(n, kind), x.astype(kind, copy=False)]), mask=none)
                long = lambda x: x.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([batch.column("_key").slice(lo, n), pa.nulls(m, batch.column("_key").type)]),
                        pa.array(np.concatenate([rows, rows[made.doc[at]]])),
                        pa.array(np.concatenate([np.diff(made.first), np.zeros(m, np.int64)]), mask=~none),
                        pad(long(prints), np.int64), pad(length, np.int32), pad(at - made.first[made.doc[at]], np.int32),
                        pad(long(one), np.int64), pad(long(two), np.int64),
                    ],
                    names=["_key", "_row", "n_words", "f", "length", "start", "w1", "w2"],
                )

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a column ``_row`` that names each; only good until it is stored."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def benchmark_overlap(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, gram: int = GRAM, sent_fingerprints: int = SENT_FINGERPRINTS,
) -> DataFrame:
    """The words of each document inside benchmark windows, and the items they come from.

    Winnowing: of the word grams in each window of ``window`` words the one with the least hash
    is its fingerprint, so a shared window always shares its fingerprint. Document windows
    whose fingerprint stands in the benchmark are extended to the whole window (two 64-bit hashes) and
    joined with the items'. An item shorter than a window is one window of its own length and
    its own fingerprint. Fingerprints of the benchmark are sent to all tasks if they are few
    enough, else document windows are joined with them by a shuffle.

    Returns key, n_words, hits (sorted places of hit words) and items (sorted ids as strings),
    one row per input row. Words are lower-cased in A-Z. A null or empty text has no words; an
    empty benchmark hits nothing; items without words or without an id are left out. Rows of
    the benchmark that repeat count once. Other columns are not read.
    """
    value = lambda c: F.coalesce(F.col(c), F.lit(""))
    items = benchmark.filter(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("_item"), value(item_text).alias("_text"))
    items = stored(items.mapInArrow(_items(window, gram), "item string, length int, f long, w1 long, w2 long").distinct())
    prints = items.select("length", "f").distinct()
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most one for each length up to the window's
    sent = None
    if prints.limit(sent_fingerprints + 1).count() <= sent_fingerprints:
        known = prints.toPandas()
        known = {n: np.sort(g.to_numpy(np.int64).view(np.uint64)) for n, g in known.groupby("length")["f"]}
        sent = docs.sparkSession.sparkContext.broadcast(known)
    rows = numbered(docs.select(F.col(key).alias("_key"), value(text).alias("_text")))
    keys = rows.select("_row", "_key", "_text")
    kind = docs.schema[key].dataType.simpleString()
    found = stored(keys.mapInArrow(_hits(window, gram, lengths, sent), f"_key {kind}, {_HITS}"))
    hits = found.filter("f is not null").select("_row", "length", "start", "f", "w1", "w2")
    if sent is None:
        hits = hits.join(prints, ["length", "f"], "left_semi")
    hits = hits.join(items.select("item", "length", "w1", "w2"), ["length", "w1", "w2"])
    hits = hits.groupBy("_row").agg(F.collect_set(F.struct("start", "length")).alias("at"), F.array_sort(F.collect_set("item")).alias("items"))
    place = F.transform("at", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1))
    hits = hits.select("_row", F.array_sort(F.array_distinct(F.flatten(place))).alias("hits"), "items")
    return (
        found.filter("f is null").select("_row", "_key", "n_words")
        .join(hits, "_row", "left")
        .select(
            F.col("_key").alias(key), "n_words",
            F.coalesce("hits", F.array().cast("array<int>")).alias("hits"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


"""Groups of near copies by one-permutation MinHash, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from truthmill.llm.textarrays import BLANKS, Rolling, lowered, mix, pieces, signed, word_hashes, words
from truthmill.operators.shared import stored

SHINGLE = 5
#: Links need 100 * intersection >= SIMILAR * union.
SIMILAR = 75
BINS = 128
#: Classes, and shingles of all of them, that are compared in one task.
COMPARED, BLOCK_SHINGLES = 1024, 1 << 22
#: Shingles of up to so many classes are counted pair by pair; the others as matrices of so many columns.
RARE, COLUMNS = 8, 2048
#: Larger ones are dealt to new buckets by four more values, in so many ways: 95 % of the pairs at the threshold stay together.
REFINED = 8
#: After so many dealings, what is still large is compared block by block.
LEVELS = 2
#: Values in a band; 32 bands of 4 miss a pair at the threshold once in 200,000.
BAND = 4
#: Settings whose bands would miss a larger share of the pairs at the threshold are refused.
MISSED = 1e-5


class Sets:
    """Sorted distinct shingle hashes of the texts of a piece."""

    def __init__(self, size: int):
        self.size = size
        self.by_word = Rolling(3)

    def read(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = lowered(data)
        n = len(offsets) - 1
        doc, start, end = words(data, offsets, BLANKS)
        sums = self.by_word.sums(word_hashes(data, start, end, 1))
        first = np.searchsorted(doc, np.arange(n + 1))
        count = np.diff(first)
        at = np.arange(max(0, len(doc) - self.size + 1))
        at = at[doc[at] == doc[at + self.size - 1]]
        short = np.flatnonzero((count > 0) & (count < self.size))
        whole = self.by_word.stretch(sums, first[short], first[short] + count[short])
        values = np.concatenate([self.by_word.stretch(sums, at, at + self.size), whole])
        owner = np.concatenate([doc[at], short])
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(owner), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
        self.values, self.owner = values[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(n + 1))


def densified(filled: np.ndarray, minima: np.ndarray) -> np.ndarray:
    """Optimal densification: an empty bin takes the minimum of the first filled bin of its own random sequence."""
    out, step = minima.copy(), 0
    row, bin_ = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    while len(row):
        step += 1
        probe = (mix(np.arange(filled.shape[1], dtype=np.uint64) + np.uint64(step * 1_000_003)) % np.uint64(filled.shape[1])).astype(np.int64)
        at = probe[bin_]
        hit = filled[row, at]
        out[row[hit], bin_[hit]] = minima[row[hit], at[hit]]
        row, bin_ = row[~hit], bin_[~hit]
    return out


def band_keys(sets: Sets, bins: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """One row of band hashes for each text, and 16 bits of each of its values.

    The upper bits of a shingle's hash are its bin; the least hash of a bin is the bin's value.
    """
    n = len(sets.first) - 1
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    cell = sets.owner * bins + (sets.values >> shift).astype(np.int64)
    lead = np.ones(len(cell), dtype=bool)
    lead[1:] = cell[1:] != cell[:-1]  # values are sorted, so the first of a bin is its least
    filled, minima = np.zeros(n * bins, dtype=bool), np.zeros(n * bins, dtype=np.uint64)
    filled[cell[lead]] = True
    minima[cell[lead]] = sets.values[lead]
    values = densified(filled.reshape(n, bins), minima.reshape(n, bins)).reshape(n, bins // band, band)
    key = np.broadcast_to(mix(np.arange(bins // band, dtype=np.uint64) + np.uint64(77)), (n, bins // band))
    for i in range(band):
        key = mix(key ^ values[:, :, i]) + np.uint64(i)
    return key, mix(values.reshape(n, bins)).astype("<u2")


def _signatures(size: int, bins: int, band: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("_text")):
                sets.read(data, offsets)
                n = hi - lo
                count = np.diff(sets.first)
                total = [np.append(np.uint64(0), np.cumsum(x)) for x in (mix(sets.values), mix(sets.values ^ np.uint64(0x5BD1E995)))]
                keys, values = band_keys(sets, bins, band)
                values = pa.array([row.tobytes() for row in values], pa.binary())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (bins // band)), pa.array(signed(np.ascontiguousarray(keys).ravel())))
                part = batch.slice(lo, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_row"), part.column("_key"), part.column("_mark"), pa.array(count),
                        *[pa.array(signed(t[sets.first[1:]] - t[sets.first[:-1]])) for t in total], keys, values,
                    ],
                    names=["_row", "_key", "_mark", "n", "s1", "s2", "bands", "sig"],
                )

    return run


def _whole_sets(size: int) -> Callable:
    """Full sets of texts, as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(size)
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("_text")):
                sets.read(data, offsets)
                bounds = pa.py_buffer((8 * sets.first).astype(np.int32))
                whole = pa.Array.from_buffers(pa.binary(), hi - lo, [None, bounds, pa.py_buffer(sets.values.astype("<u8"))])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("c"), part.column("again"), whole], names=["c", "again", "whole"])

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets: rare shingles pair by pair, frequent ones as a product of matrices."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    lead = np.append(True, values[1:] != values[:-1])
    number = np.cumsum(lead) - 1
    count = np.bincount(number)[number] if len(number) else number
    out = np.zeros((m, m))
    rare = (count > 1) & (count <= RARE)
    held, which = owner[rare], number[rare]
    for step in range(1, RARE):
        same = np.flatnonzero(which[step:] == which[:-step])
        if not len(same):
            break
        out += np.bincount(held[same] * m + held[same + step], minlength=m * m).reshape(m, m)
    out += out.T
    often = count > RARE
    held, which = owner[often], number[often]
    _, column = np.unique(which, return_inverse=True)
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        inside = (column >= lo) & (column < lo + COLUMNS)
        x = np.zeros((m, COLUMNS), dtype=np.float32)
        x[held[inside], column[inside] - lo] = 1
        out += x @ x.T
    return out


def _forest(link: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links enough to connect what the given ones connect, when classes of equal label are connected already."""
    found, seen = [], np.zeros(len(label), dtype=bool)
    for start in range(len(label)):
        if seen[start]:
            continue
        front = np.flatnonzero(label == label[start]).tolist()
        seen[front] = True
        while front:
            at = front.pop()
            for new in np.flatnonzero(link[at] & ~seen):
                if not seen[new]:  # not yet by another class of its label
                    found.append((at, int(new)))
                    group = np.flatnonzero(label == label[new])
                    seen[group] = True
                    front += group.tolist()
    return found


def _linked(similar: int) -> Callable:
    """Links between classes of different groups in a block or between two, judged on their full sets.

    All pairs are judged, but only links that join two groups leave the task: fewer than there are classes.
    """

    def run(table: pa.Table) -> pa.Table:
        c, n, label, own = (table.column(name).to_numpy() for name in ("c", "n", "label", "own"))
        shared = _intersections([np.frombuffer(x, "<u8") for x in table.column("whole").to_pylist()])
        link = (shared > 0) & (100 * shared >= similar * (n[:, None] + n[None, :] - shared))
        link &= (own[:, None] != own[None, :]) if table.column("i")[0] != table.column("j")[0] else True
        pairs = np.array(_forest(link, label), dtype=np.int64).reshape(-1, 2)
        a, b = c[pairs[:, 0]], c[pairs[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _compared(members: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) between groups in each bucket; a bucket beyond the bounds is compared by pairs of blocks."""
    blocks = F.greatest(F.ceil(F.col("size") / COMPARED), F.ceil(F.col("heft") / BLOCK_SHINGLES))
    own = F.pmod(F.xxhash64("c"), blocks)
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    placed = members.select("*", own.alias("own"), other.alias("other"))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return placed.groupBy("bucket", "i", "j").applyInArrow(_linked(similar), "a long, b long").distinct()


def _refined(band: int) -> Callable:
    """Members of a large bucket under new keys: the old one with some more values of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(x, "<u2") for x in batch.column("sig").to_pylist()]).astype(np.uint64)
            old = batch.column("bucket").to_numpy().view(np.uint64)
            for way in range(REFINED):
                key = mix(old + np.uint64(way + 1))
                for i in range(band):
                    at = mix(mix(old + np.uint64(way)) + np.uint64(i)) % np.uint64(sig.shape[1])
                    key = mix(key ^ sig[np.arange(len(old)), at.astype(np.int64)])
                yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), pa.array(signed(key))], names=["c", "n", "bucket"])

    return run


def _confirmed(similar: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, (one, two) in enumerate(zip(batch.column("one"), batch.column("two"))):
                both = np.concatenate([np.frombuffer(one.as_buffer(), "<u8"), np.frombuffer(two.as_buffer(), "<u8")])
                n = len(both)
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if shared and 100 * shared >= similar * (n - shared):
                    kept.append(i)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that can be reached from each node of the links (a, b).

    Each round takes the least label of the neighbours, then the label of that label, so
    chains shrink by halves; the labels are stored after each round.
    """
    edges = stored(links.unionByName(links.select(F.col("a").alias("b"), F.col("b").alias("a"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = stored(labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was")))
        of = step.select(F.col("node").alias("label"), F.col("label").alias("root"))
        labels = stored(step.join(of, "label").select("node", F.col("root").alias("label"), "was"))
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")


def _shared(placed: DataFrame) -> DataFrame:
    """(bucket, c, n, size, first) of the buckets with more than one class.

    ``first``, the centre of a bucket's star, is the class that meets most others in all its buckets: of an original
    and its edited copies, which are less like each other, that is the original.
    """
    placed = stored(placed)
    sizes = stored(placed.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("heft")).filter("size > 1"))
    placed = stored(placed.join(sizes, "bucket"))
    met = stored(placed.groupBy("c").agg(F.sum("size").alias("met")))
    first = placed.join(met, "c").groupBy("bucket").agg((-F.max(F.struct("met", (-F.col("c")).alias("least")))["least"]).alias("first"))
    return stored(placed.join(stored(first), "bucket"))


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR, bins: int = BINS, band: int = BAND
) -> DataFrame:
    """The group of near copies of each document.

    Texts of equal shingle sets are one class and go on as one row. One permutation of the shingles
    is cut into bins; empty bins are filled by optimal densification; bands of values are bucket
    keys. In each bucket all classes are paired with one centre, and pairs are confirmed on the
    full sets. Where a bucket then still holds several groups, all its classes of different groups are
    compared on their full sets inside the task, and only links that join two groups leave it.
    A bucket of several groups that is too large for that is dealt to smaller ones by more values
    of the signature, so a common passage does not bring all its documents together; what is
    still large after two dealings is compared block by block.

    Returns key, n_shingles, component_id (the smallest key of the group), kept (whether
    that is the row's own key) and text_hash (``xxhash64`` of the text), one row per input row. Words are lower-cased in A-Z and parted
    by blanks; a text of fewer words than a shingle is one shingle; a text without words, or
    null, is a group of its own. Null keys are ignored in the smallest key, and a group without any
    other has a null id. Repeated rows are copies of each other. Other columns are not read.
    """
    missed = (1 - (similar / 100) ** band) ** (bins // band)
    if missed > MISSED:
        raise ValueError(f"bands of {band} in {bins} values miss {missed:.3g} of the pairs at {similar} of 100")
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.xxhash64(value).alias("_mark"), value.alias("_text"))
    signed_rows = rows.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_key", "_mark", "_text")
    base = stored(
        signed_rows.mapInArrow(_signatures(shingle, bins, band), "_row long, _key long, _mark long, n long, s1 long, s2 long, bands array<long>, sig binary")
    )
    classes = base.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("_row").alias("c"), F.min("_key").alias("least"))
    classes = stored(classes)
    one_each = base.join(classes.select(F.col("c").alias("_row")), "_row")
    one_each = stored(one_each.select(F.col("_row").alias("c"), "_key", "_mark", "n", "sig", "bands"))
    members = _shared(one_each.select("c", "n", F.explode("bands").alias("bucket")))
    # Rows that repeat key and text cannot be told apart when the texts are read again: of these one set is kept.
    repeated = stored(base.groupBy("_key", "_mark").agg(F.count("*").alias("k")).filter("k > 1").select("_key", "_mark", F.lit(True).alias("again")))
    asked = one_each.join(members.select("c").distinct(), "c").select("c", F.col("_key").alias("_k"), F.col("_mark").alias("_m"))
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m"))
    asked = stored(asked.join(repeated, same, "left").select("c", "_k", "_m", F.coalesce("again", F.lit(False)).alias("again")))
    found = rows.join(asked.hint("shuffle_hash"), same).select("c", "again", "_text")
    found = stored(found.mapInArrow(_whole_sets(shingle), "c long, again boolean, whole binary"))
    sets = found.filter(~F.col("again")).unionByName(found.filter("again").dropDuplicates(["c"])).select("c", "whole")
    sized = 100 * F.least("an", "n") >= similar * F.greatest("an", "n")  # sets of other sizes cannot be similar

    def links_among(pairs: DataFrame) -> DataFrame:
        left = pairs.join(sets.select(F.col("c").alias("b"), F.col("whole").alias("two")), "b")
        both = left.join(sets.select(F.col("c").alias("a"), F.col("whole").alias("one")), "a")
        return stored(both.select("a", "b", "one", "two").mapInArrow(_confirmed(similar), "a long, b long").distinct())

    links = tested = spark.createDataFrame([], "a long, b long")
    for level in range(LEVELS + 1):
        first = members.filter("c = first").select("bucket", F.col("c").alias("a"), F.col("n").alias("an"))
        stars = members.filter("c <> first").select("bucket", F.col("first").alias("a"), F.col("c").alias("b"), "n")
        pairs = stars.join(first, ["bucket", "a"]).filter(sized)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti"))
        links, tested = links.unionByName(links_among(pairs)), tested.unionByName(pairs)
        labels = components(links)
        named = members.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        mixed = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("bucket")
        open_ = named.join(stored(mixed), "bucket").filter("size > 2").join(one_each.select("c", "sig"), "c")
        open_ = stored(open_.select("bucket", "size", "heft", "c", "n", "label", "sig"))
        large = F.col("size") > COMPARED
        last = level == LEVELS or open_.filter(large).isEmpty()
        near = open_ if last else open_.filter(~large)
        found = stored(_compared(near.drop("sig").join(sets, "c"), similar))
        if not found.isEmpty():
            links = links.unionByName(found)
            labels = components(links)
        if last:
            break
        members = _shared(open_.filter(large).select("bucket", "c", "n", "sig").mapInArrow(_refined(band), "c long, n long, bucket long"))
    group = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    group = stored(group)
    smallest = group.groupBy("label").agg(F.min("least").alias("smallest"))
    group = stored(group.join(smallest, "label").select("s1", "s2", "n", "smallest"))
    alone = F.col("n") == 0
    out = base.select("_key", "_mark", "n", "s1", "s2").join(group, ["s1", "s2", "n"], "left")
    component = F.when(alone, F.col("_key")).otherwise(F.col("smallest"))
    return out.select(
        F.col("_key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"),
        F.col("_mark").alias("text_hash"),
    )

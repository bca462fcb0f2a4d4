"""Hard negatives of anchor vectors, from exact whole-number scores against every vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from truthmill.operators.shared import is_small, stored

POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
WINDOW = (30, 90)
SCALE = 256
#: Vectors that one task holds, anchors that meet them there, and the sides of one product.
STRIPE, LEAST_STRIPE, BLOCK, TILE = 131_072, 4_096, 4_096, (1_024, 2_048)
#: A product with a side of so few rows or columns is made directly.
LEAF = 8
_NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by seven half-sized products a level.

    Sides are padded with zeros to a multiple of the number of parts. Sums wrap at 64 bits, so the
    result is exact whenever the product itself fits, whatever the parts come to.
    """
    n, m = a.shape[0], b.shape[1]
    parts = 1
    while min(n, a.shape[1], m) > leaf * parts:
        parts *= 2
    if parts == 1:
        return a @ b
    pad = lambda x: np.pad(x, [(0, -s % parts) for s in x.shape])
    return _halves(pad(a), pad(b), parts)[:n, :m]


def _halves(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    if parts == 1:
        return np.ascontiguousarray(a) @ np.ascontiguousarray(b)
    n, k, m = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    both = _halves(a11 + a22, b11 + b22, parts // 2)
    low = _halves(a21 + a22, b11, parts // 2)
    right = _halves(a11, b12 - b22, parts // 2)
    left = _halves(a22, b21 - b11, parts // 2)
    high = _halves(a11 + a12, b22, parts // 2)
    out = np.empty((2 * n, 2 * m), dtype=np.int64)
    out[:n, :m] = both + left - high + _halves(a12 - a22, b21 + b22, parts // 2)
    out[:n, m:] = right + high
    out[n:, :m] = low + left
    out[n:, m:] = both - low + right + _halves(a21 - a11, b11 + b12, parts // 2)
    return out


class Heaps:
    """For each of n rows the k best columns offered so far: higher scores first, then earlier columns."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _NONE, dtype=np.int64)
        self.at = np.full((n, k), -1, dtype=np.int64)

    def offer(self, scores: np.ndarray, among: np.ndarray, first: int) -> None:
        """Take in the marked scores of a tile whose columns start at ``first``; tiles come in column order."""
        n, k = self.score.shape
        among = among & (scores > self.score[:, -1:])  # an equal score in a later column comes after
        if np.count_nonzero(among) > 4 * n * k and scores.shape[1] > k:
            marked = np.where(among, scores, _NONE)
            among &= scores >= np.partition(marked, marked.shape[1] - k, axis=1)[:, -k][:, None]
        row, column = np.nonzero(among)
        if not len(row):
            return
        held, place = np.nonzero(self.at >= 0)
        rows = np.concatenate([held, row])
        score = np.concatenate([self.score[held, place], scores[row, column]])
        at = np.concatenate([self.at[held, place], column + first])
        order = np.lexsort((at, -score, rows))
        rows, score, at = rows[order], score[order], at[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = rank < k
        self.score[rows[best], rank[best]], self.at[rows[best], rank[best]] = score[best], at[best]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of int64, shorter ones padded with zeros."""
    out = np.zeros((len(column), width), dtype=np.int64)
    size = pc.list_value_length(column).to_numpy()
    values = pc.list_flatten(column).to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _tiles(anchors: pa.Table, others: pa.Table, width: int):
    """(rows of anchors, columns of others, scores) of every tile, columns in order."""
    left, right = _matrix(anchors["q"], width), _matrix(others["q"], width)
    for i in range(0, len(left), TILE[0]):
        rows = slice(i, i + TILE[0])
        for j in range(0, len(right), TILE[1]):
            columns = slice(j, j + TILE[1])
            yield rows, columns, strassen(left[rows], np.ascontiguousarray(right[columns].T))


def _best_positives(width: int, k: int) -> Callable:
    def run(anchors: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by([("_id", "ascending")])
        row, label = (anchors[c].to_numpy() for c in ("_row", "_label"))
        other, its_label, its_id = (others[c].to_numpy() for c in ("_row", "_label", "_id"))
        heaps = Heaps(len(row), k)
        for i, j, scores in _tiles(anchors, others, width):
            part = Heaps(0, k)
            part.score, part.at = heaps.score[i], heaps.at[i]  # views: the tile's rows of the heaps
            part.offer(scores, (label[i, None] == its_label[None, j]) & (row[i, None] != other[None, j]), j.start)
        a, place = np.nonzero(heaps.at >= 0)
        return pa.table({"_row": row[a], "positive_id": its_id[heaps.at[a, place]], "positive_score": heaps.score[a, place]})

    return run


def _best_negatives(width: int, k: int, low: int, high: int) -> Callable:
    def run(anchors: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by([("_id", "ascending")])
        row, label = (anchors[c].to_numpy() for c in ("_row", "_label"))
        its_label, its_id = (others[c].to_numpy() for c in ("_label", "_id"))
        size = pc.list_value_length(anchors["scores"]).to_numpy()
        targets = _matrix(anchors["scores"], int(size.max(initial=0)))
        slots = [Heaps(len(row), k) for _ in range(targets.shape[1])]
        for i, j, scores in _tiles(anchors, others, width):
            other_label = label[i, None] != its_label[None, j]
            for slot, heaps in enumerate(slots):
                target = targets[i, slot, None]
                inside = other_label & (low * target <= 100 * scores) & (100 * scores <= high * target)
                part = Heaps(0, k)
                part.score, part.at = heaps.score[i], heaps.at[i]
                part.offer(scores, inside & (size[i, None] > slot), j.start)
        found = []
        for slot, heaps in enumerate(slots):
            a, place = np.nonzero(heaps.at >= 0)
            found.append((row[a], np.full(len(a), slot, dtype=np.int32), its_id[heaps.at[a, place]], heaps.score[a, place]))
        kinds = (np.int64, np.int32, its_id.dtype, np.int64)
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, kind) for kind in kinds]
        return pa.table(dict(zip(("_row", "slot", "negative_id", "negative_score"), columns)))

    return run


def _numbers(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


def _meeting(left: DataFrame, right: DataFrame, keys: list[str], task: Callable, schema: str) -> DataFrame:
    """What a task makes of the rows of both tables with equal keys; the tables may come from one."""
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, schema)


def _dealt(parts: Column) -> Column:
    """One of ``parts`` numbers for each row, whatever the ids: repeated ids are dealt too."""
    return F.pmod(F.xxhash64("_row"), parts).cast("int")


def hard_negatives(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, stripe: int = STRIPE, block: int = BLOCK,
) -> DataFrame:
    """For the rows that ``anchor`` marks: their best positives, and the best negatives within each one's window.

    Components become floor(scale * x); a row's score is the whole-number inner product with the anchor's.
    Higher scores come first, ties by smaller key. Positives are the other rows of the anchor's label;
    negatives have another label and between ``window`` hundredths of the positive's score.

    Blocks of anchors meet stripes of the rows, tile by tile, by Strassen's product. A task lets out only a bounded
    heap for each anchor (and positive); heaps of different stripes are merged. Positives come first, and need only the
    rows of the anchor's own label: a label of more than a stripe is dealt over several, smaller labels share
    one. Then the windows are known, and all rows are read once for each block of anchors.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score. Rows
    with a null label, vector or key take no part, nor do those with a null or non-finite component. Labels are whole numbers.
    Shorter vectors count as padded with zeros. Rows that repeat a key are rows of their own, each an anchor if it is
    marked and each a positive of the other. An empty table, or one without anchors, gives no rows. Other columns are not read. Components so
    large that a hundredfold score might not fit 64 bits are refused.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(
        F.col(key).alias("_id"), F.col(label).cast("long").alias("_label"), F.coalesce(anchor, F.lit(False)).alias("_anchor"),
        F.col(vector).cast("array<double>").alias("_v"),
    )
    rows = rows.filter("_id is not null and _label is not null and _v is not null").filter(~F.exists("_v", odd))
    whole = F.transform("_v", lambda x: F.floor(x * scale))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("_row"), "_id", "_label", "_anchor", whole.alias("q")))
    largest = F.greatest(F.abs(F.array_max("q").cast("double")), F.abs(F.array_min("q").cast("double")))
    n, n_anchors, width, most = rows.agg(F.count("*"), F.count_if("_anchor"), F.max(F.size("q")), F.max(largest)).first()
    width, most = width or 0, most or 0.0
    if max(width, 1) * most * most * 100 >= 2.0**63 or most >= 2.0**31:
        raise ValueError(f"components of up to {most:.0f} over {width} places may give scores beyond 64 bits")
    rows = rows.withColumn("q", F.col("q").cast("array<int>"))
    spark = vectors.sparkSession
    stripe = min(stripe, max(LEAST_STRIPE, -(-n // int(spark.conf.get("spark.sql.shuffle.partitions")))))
    stripes, blocks = max(1, -(-n // stripe)), max(1, -(-n_anchors // block))
    kind = vectors.schema[key].dataType.simpleString()

    # At most n / stripe labels hold more than a stripe.
    large = rows.groupBy("_label").agg(F.count("*").alias("n"), F.count_if("_anchor").alias("a")).filter(F.col("n") > stripe)
    large = stored(large.select("_label", F.ceil(F.col("n") / stripe).alias("_parts"), F.ceil(F.greatest(F.col("a"), F.lit(1)) / block).alias("_blocks")))
    placed = rows.join(F.broadcast(large) if is_small(large) else large, "_label", "left").select(
        *rows.columns, F.pmod(F.xxhash64("_label"), F.lit(stripes)).cast("int").alias("home"),
        F.coalesce("_parts", F.lit(1)).cast("int").alias("_parts"), F.coalesce("_blocks", F.lit(1)).cast("int").alias("_blocks"),
    )
    own = placed.filter("_anchor").select("home", _numbers(F.col("_parts")).alias("part"), _dealt(F.col("_blocks")).alias("block"), "_row", "_label", "q")
    same = placed.select("home", _dealt(F.col("_parts")).alias("part"), _numbers(F.col("_blocks")).alias("block"), "_row", "_id", "_label", "q")
    schema = f"_row long, positive_id {kind}, positive_score long"
    found = _meeting(own, same, ["home", "part", "block"], _best_positives(width, positives), schema)
    order = Window.partitionBy("_row").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("slot", F.row_number().over(order) - 1).filter(F.col("slot") < positives)
    best = stored(best)

    targets = best.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("s"))
    targets = targets.select("_row", F.col("s.positive_score").alias("scores"))
    marked = rows.filter("_anchor").select("_row", "_label", "q").join(targets, "_row")
    left = marked.select(_numbers(F.lit(stripes)).alias("stripe"), _dealt(F.lit(blocks)).alias("block"), "_row", "_label", "q", "scores")
    right = rows.select(_dealt(F.lit(stripes)).alias("stripe"), _numbers(F.lit(blocks)).alias("block"), "_id", "_label", "q")
    schema = f"_row long, slot int, negative_id {kind}, negative_score long"
    near = _meeting(left, right, ["stripe", "block"], _best_negatives(width, negatives, *window), schema)
    order = Window.partitionBy("_row", "slot").orderBy(F.desc("negative_score"), "negative_id")
    near = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = best.join(rows.filter("_anchor").select("_row", F.col("_id").alias("anchor_id")), "_row")
    return near.join(named, ["_row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

"""A linear classifier by hinge loss with an L1 penalty: gradient steps with soft thresholding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from truthmill.operators.shared import stored

# --- fixed values: settings of the fit ------------------------------------------------
STEPS = 100
REG = 0.1
STEP_SIZE = 1.0
TOLERANCE = 0.001
# --------------------------------------------------------------------------------------
#: Entries of a stored block, and weights whose sums travel as one row.
BLOCK_ENTRIES, SLAB = 1 << 20, 1 << 16


@dataclass(frozen=True)
class HingeModel:
    """Weights of a fitted classifier, and how many steps it took. There is no intercept."""

    weights: np.ndarray
    steps: int

    def score(self, df: DataFrame, *keys: str, features: str = "features") -> DataFrame:
        """(keys, label, prediction, score): the score is the margin; above 0 the prediction is 1."""
        rows = sparse_rows(df, *keys, features=features)
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (*keys, "label"))
        out = rows.mapInArrow(_margins(self.weights, [*keys, "label"]), f"{kinds}, score double")
        return out.select(*keys, "label", (F.col("score") > 0).cast("double").alias("prediction"), "score")


def sparse_rows(df: DataFrame, *keys: str, features: str = "features") -> DataFrame:
    """(keys, label, indices, values) of vector rows; a dense vector lists all places, a null one none. Rows without a label stay."""
    parts = F.unwrap_udt(features)
    size = F.size(vector_to_array(features))
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return df.select(
        *keys, F.col("label").cast("double").alias("label"),
        F.when(F.col(features).isNull(), none("int")).when(parts["type"] == 0, parts["indices"]).otherwise(every).alias("indices"),
        F.when(F.col(features).isNull(), none("double")).otherwise(parts["values"]).alias("values"),
    )


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all entries of a batch."""
    size = np.diff(np.asarray(batch.column("indices").offsets))
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), size), flat("indices"), flat("values")


def _margin(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    row, place, value = _flat(batch)
    known = place < len(weights)
    row, place, value = row[known], place[known], value[known]
    return np.bincount(row, weights[place] * value, minlength=batch.num_rows).astype(float), row, place, value


def _margins(weights: np.ndarray, keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = _margin(batch, weights)[0]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(margin)], names=[*keys, "score"])

    return run


def _blocks(entries: int) -> Callable:
    """Labelled rows as blocks of their entries: one row of four arrays of bytes for many rows, so that a step reads them as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, value = _flat(batch)
            side = 2.0 * batch.column("label").to_numpy(zero_copy_only=False) - 1.0
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + entries, side="right")) - 1)
                part = slice(ends[lo], ends[hi])
                block = ((row[part] - lo).astype(np.int32), place[part].astype(np.int32), value[part].astype(float), side[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in block], names=["row", "place", "value", "side"])
                lo = hi

    return run


def packed(rows: DataFrame) -> DataFrame:
    """Blocks of the rows of ``sparse_rows`` that have a label."""
    return rows.select("label", "indices", "values").mapInArrow(_blocks(BLOCK_ENTRIES), "row binary, place binary, value binary, side binary")


def _partial_sums(weights: np.ndarray) -> Callable:
    """A task's sum of the loss's gradients, in slabs of neighbouring places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights))
        for batch in batches:
            for block in batch.to_pylist():
                row, place = (np.frombuffer(block[c], dtype=np.int32) for c in ("row", "place"))
                value, side = (np.frombuffer(block[c]) for c in ("value", "side"))
                known = place < len(weights)
                if not known.all():
                    row, place, value = row[known], place[known], value[known]
                margin = np.bincount(row, weights[place] * value, minlength=len(side)).astype(float)
                pull = np.where(side * margin < 1.0, -side, 0.0)
                total += np.bincount(place, pull[row] * value, minlength=len(weights))
        for slab, lo in enumerate(range(0, len(weights), SLAB)):
            part = total[lo : lo + SLAB]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([part.tobytes()], pa.binary())], names=["slab", "pull"])

    return run


def _slab_sum(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one slab over all tasks, a part at a time."""
    slab, total = None, np.zeros(0)
    for batch in rows:
        for slab, pull in zip(batch.column("slab").to_pylist(), batch.column("pull").to_pylist()):
            pull = np.frombuffer(pull)
            total = total + pull if len(total) else pull
    if slab is not None:
        yield pa.RecordBatch.from_arrays([pa.array([slab]), pa.array([total.tobytes()], pa.binary())], names=["slab", "pull"])


def gradient(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Sum of the gradients of the hinge loss over all rows.

    Every task adds up its own rows and lets out one number for each place; these are added by place over
    the cluster, so what the driver takes is one vector of the weights' size, whatever the number of tasks.
    """
    return _gradient(packed(rows), weights)


def _gradient(blocks: DataFrame, weights: np.ndarray) -> np.ndarray:
    kinds = "slab long, pull binary"
    sums = blocks.mapInArrow(_partial_sums(weights), kinds).groupBy("slab").applyInArrow(_slab_sum, kinds).toArrow()
    out = np.zeros(len(weights))
    for slab, pull in zip(sums["slab"].to_pylist(), sums["pull"].to_pylist()):
        out[slab * SLAB : (slab + 1) * SLAB] = np.frombuffer(pull)
    return out


def soft_threshold(weights: np.ndarray, by: float) -> np.ndarray:
    """Each weight nearer to 0, and 0 if it was no further away: what keeps an L1-penalised model sparse."""
    return np.sign(weights) * np.maximum(np.abs(weights) - by, 0.0)


def fit_hinge_l1(
    df: DataFrame, size: int, features: str = "features", steps: int = STEPS, reg: float = REG, step_size: float = STEP_SIZE,
    tolerance: float = TOLERANCE,
) -> HingeModel:
    """Weights by full-batch gradient descent on the mean hinge loss with an L1 penalty.

    Step i goes ``step_size / sqrt(i)`` against the mean gradient and then thresholds softly by ``reg`` times
    that. It ends after ``steps`` steps or when the weights move by less than ``tolerance`` of their length (of 1, if that is more). The driver holds
    one vector of ``size`` numbers; the rows are stored once as blocks of their entries. Labels are 0 and 1; rows without
    a label are left out; without any row all weights are 0.
    """
    rows = sparse_rows(df, features=features).filter("label is not null")
    n = rows.count()
    blocks = stored(packed(rows))
    weights = np.zeros(size)
    for i in range(1, steps + 1 if n else 0):
        step = step_size / np.sqrt(i)
        new = soft_threshold(weights - step * _gradient(blocks, weights) / n, reg * step)
        moved = np.linalg.norm(new - weights)
        weights = new
        if moved < tolerance * max(np.linalg.norm(weights), 1.0):
            return HingeModel(weights, i)
    return HingeModel(weights, steps if n else 0)

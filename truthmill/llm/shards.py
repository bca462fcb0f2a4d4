"""Shards of nearly equal bytes by histogram sort."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from truthmill.operators.shared import stored

SHARDS = 40
#: How far a boundary may lie from its place, as a share of a shard's bytes.
TOLERANCE = 0.002
PROBES = 16
#: A shard larger than this is dealt to several tasks.
TASK_BYTES = 128 << 20
#: Lower bits of the sort key, which part the rows of one group.
ROW_BITS = 24
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _below(probes: np.ndarray) -> Callable:
    """Bytes and rows of a batch between neighbouring probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(probes, batch.column("_at").to_numpy(), side="right")
            size = np.zeros(len(probes) + 1, dtype=np.int64)
            np.add.at(size, at, batch.column("_size").to_numpy())
            rows = np.bincount(at, minlength=len(probes) + 1)
            full = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(size[full]), pa.array(rows[full])], names=["at", "bytes", "n"])

    return run


def histogram(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows in each gap between the sorted probes; one more gap than probes."""
    parts = keys.select("_at", "_size").mapInArrow(_below(np.array(probes, dtype=np.int64)), "at long, bytes long, n long")
    size, rows = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in parts.groupBy("at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect():
        size[r["at"]], rows[r["at"]] = r["bytes"], r["n"]
    return size, rows


def splitters(keys: DataFrame, total: int, targets: list[tuple[float, float]], probes: int = PROBES) -> list[int]:
    """A key for each (bytes below, tolerance): the rows below it have so many bytes, or as near as rows allow.

    Every round counts the exact bytes below some candidates in the interval left for each
    boundary and narrows it to two neighbours. Candidates lie between groups until an
    interval holds a single group, then between its rows.
    """
    whole = 1 << ROW_BITS
    found: dict[int, int] = {}
    open_ = {i: (_LOW, _HIGH, 0, total) for i in range(len(targets))}
    while open_:
        wanted = {}
        for i, (lo, hi, under, upto) in open_.items():
            unit = whole if hi - lo > whole else 1
            share = (targets[i][0] - under) / max(1, upto - under)
            middle = lo + int((hi - lo) * min(max(share, 0), 1))
            near = max(unit, (hi - lo) >> 8)  # half of the candidates close to where an even spread would put the boundary
            at = {lo + (hi - lo) * j // probes for j in range(1, probes)} | {middle + j * near // 4 for j in range(-probes // 2, probes // 2)}
            wanted[i] = {x for x in (x // unit * unit for x in at) if lo < x < hi} or {lo + (hi - lo) // 2} - {lo}
        asked = sorted(set().union(*wanted.values()))
        below = dict(zip(asked, np.cumsum(histogram(keys, asked)[0]).tolist())) if asked else {}
        for i, (lo, hi, under, upto) in list(open_.items()):
            target, slack = targets[i]
            for x in sorted(wanted[i]):
                if below[x] <= target and x > lo:
                    lo, under = x, below[x]
                elif below[x] > target and x < hi:
                    hi, upto = x, below[x]
            nearest = lo if target - under <= upto - target else hi
            if abs((under if nearest == lo else upto) - target) <= slack or hi - lo <= 1 or under == upto:
                found[i] = nearest
                del open_[i]
            else:
                open_[i] = (lo, hi, under, upto)
    return [found[i] for i in range(len(targets))]


def shard(
    rows: DataFrame, size: str, group: str, shards: int = SHARDS, tolerance: float = TOLERANCE, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """The rows with ``shard`` and ``slot`` (gapless from 0 in a shard); shards have nearly equal bytes.

    Histogram sort: rows are ordered by a hash of their group, then by one of the row. The
    exact bytes below candidate keys are counted and the candidates refined until every
    boundary is within the tolerance; then the rows are exchanged once. Groups of equal
    rows stay together unless a boundary falls into a group that is larger than the
    tolerance; such a group is cut between its rows. A shard too large for a task is dealt
    to several, by further boundaries.

    All columns are kept (``shard`` and ``slot`` are replaced if there). A null size counts as 0. With fewer
    rows than shards some shards are empty; an empty table gives no rows. Rows that repeat are rows.
    """
    spread = F.xxhash64(group, F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    at = F.xxhash64(group).bitwiseAND(F.lit(-(1 << ROW_BITS))).bitwiseOR(spread)
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row")  # one column, so that names of the input cannot clash with those used here
    keys = stored(rows.select(whole, at.alias("_at"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")))
    total = keys.agg(F.coalesce(F.sum("_size"), F.lit(0))).first()[0]
    each = max(1, -(-total // (shards * task_bytes)))
    targets = [
        (total * i / (shards * each), total / shards * (tolerance if i % each == 0 else 0.25 / each)) for i in range(1, shards * each)
    ]
    bounds = np.maximum.accumulate(np.array(splitters(keys, total, targets) if total else [_HIGH] * len(targets), dtype=np.int64))
    cuts = bounds.tolist()
    counts = histogram(keys, cuts)[1]
    first = [sum(counts[i // each * each : i]) for i in range(len(counts))]

    @F.pandas_udf("int")
    def part_of(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, at.to_numpy(), side="right").astype(np.int32))

    spark = rows.sparkSession
    bases = spark.createDataFrame(list(enumerate(first)), "_part int, _base long")
    dealt = keys.withColumn("_part", part_of("_at")).repartition(len(counts), "_part")
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_at", "_size")) - 1
    return (
        dealt.withColumn("_place", place)
        .join(F.broadcast(bases), "_part")
        .select("_row.*", F.floor(F.col("_part") / each).cast("int").alias("shard"), (F.col("_base") + F.col("_place")).alias("slot"))
    )

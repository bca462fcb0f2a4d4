"""Stored intermediate tables, size-checked joins and ordered running sums."""

from __future__ import annotations

import atexit
import uuid
from collections import defaultdict
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BROADCAST_ROWS = 200_000
#: Folders of the stored tables that are not released yet, by application.
_STORED: dict[str, list[str]] = defaultdict(list)
#: What ``made_once`` keeps, by application.
_MADE: dict[str, dict[tuple, Any]] = defaultdict(dict)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else one in the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_truthmill"
    return folder.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder, removed by ``release``."""
    path = f"{shared_folder(spark)}/truthmill/{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _STORED:
        atexit.register(_release_at_end, spark, app)
    _STORED[app].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them from there on.

    Cuts the lineage and computes the rows once, whatever is derived from them. Unlike
    ``checkpoint()``, which runs the plan a second time to write it, the table is
    columnar, so later steps read only the columns they use, and its size is known. It
    stays until ``release``.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_alone(df: DataFrame) -> DataFrame:
    """``stored``, and what the write has shuffled is removed as soon as it ends, not when the driver happens to collect its garbage."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return stored(df)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def made_once(spark: SparkSession, key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` returns, made at the first call with this key and kept by the driver until ``release``.

    For fits that several queries share. The key must tell inputs apart, so it should hold ``table_state`` of each.
    """
    kept = _MADE[spark.sparkContext.applicationId]
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table_state(df: DataFrame) -> tuple:
    """What tells one content of a table's files from another: their number, their last change and their size."""
    files = df.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    row = files.agg(F.count("*"), F.max("file_modification_time"), F.sum("file_size")).first()
    return tuple(row)


def release(spark: SparkSession) -> int:
    """Remove the tables this application has stored; results are lazy, so call it once they are written."""
    _MADE.pop(spark.sparkContext.applicationId, None)
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    return len(paths)


def _release_at_end(spark: SparkSession, app: str) -> None:
    if app in _STORED and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        release(spark)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Row count checked up to the bound. Call it on stored tables, where counting is cheap."""
    return df.limit(rows + 1).count() <= rows


def join_words(bag: DataFrame, words: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a large table on a skewed word key with one row per word.

    Up to the bound the word table is broadcast. Beyond it both sides are shuffled
    by word, and adaptive execution splits the rows of a frequent word over tasks; the words
    must be a stored table, so that their side of the join is a plain shuffle too.
    """
    if is_small(words, broadcast_rows):
        return bag.join(F.broadcast(words), key)
    return bag.join(words, key)


def ordered(df: DataFrame, *order: Column | str) -> DataFrame:
    """Range-sorted copy with ``_part`` (range number) and ``_pos`` (row number in it).

    The range bounds are sampled, so the copy is stored before anything is derived from
    it; a recomputed sort could cut elsewhere.
    """
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df = stored(df.withColumn("_at", F.monotonically_increasing_id()))
    return df.withColumns(
        {
            "_part": F.shiftright("_at", 33).cast("int"),
            "_pos": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    ).drop("_at")


def _offsets(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Totals of all earlier ranges and of all ranges: one row per range, a few in all."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = df.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return totals.select(
        "_part",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
        *[F.sum(n).over(every).alias(f"{n}_total") for n in sums],
    )


def dense_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Consecutive numbers from 0 in the given order, without a one-task window."""
    rows = ordered(df, *order)
    offsets = _offsets(rows, {"n": F.lit(1)})
    numbered = rows.join(F.broadcast(offsets), "_part").withColumn(
        name, F.col("_pos") + F.col("_before_n")
    )
    return numbered.drop("_part", "_pos", "_before_n", "n_total")


def running_sums(df: DataFrame, *order: Column | str, **columns: str) -> DataFrame:
    """Inclusive running sums over a total order, ``out="column"`` for each, and ``out_total``.

    The order should be by distinct keys, so that every range stays small.
    """
    rows = ordered(df, *order)
    offsets = _offsets(rows, {out: F.col(c) for out, c in columns.items()})
    local = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(offsets), "_part")
    rows = rows.withColumns(
        {out: F.sum(c).over(local) + F.col(f"_before_{out}") for out, c in columns.items()}
    )
    return rows.drop("_part", "_pos", *[f"_before_{out}" for out in columns])

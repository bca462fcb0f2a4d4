"""Labelled sets: filters, labels, latest-k, repeatable splits and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from truthmill.operators.shared import dense_index, stored

# --- fixed values: labels, split weights, seed and sizes --------------------------
CREDIBLE = 1.0
UNRELIABLE = 0.0
SEED = 11
FOLD_SEED = 12
UNRELIABLE_WEIGHTS = (0.7, 0.3)
CREDIBLE_WEIGHTS = (0.6, 0.3, 0.1)
LATEST_CREDIBLE = 7061
CORPUS_ROWS = 101444
# ---------------------------------------------------------------------------------


def non_blank(df: DataFrame, body: str) -> DataFrame:
    return df.filter(F.trim(F.coalesce(body, F.lit(""))) != "")


def labelled(df: DataFrame, body: str, label: Column | float, key: str = "doc_id") -> DataFrame:
    """(key, content, label) of the rows with a body."""
    label = label if isinstance(label, Column) else F.lit(label)
    return non_blank(df, body).select(
        F.col(key), F.col(body).alias("content"), label.cast("double").alias("label")
    )


def without_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows of all other values; a null is no value."""
    return df.filter(F.col(column) != value)


def category_label(category: Column, credible_category: str) -> Column:
    return F.when(category == credible_category, CREDIBLE).otherwise(UNRELIABLE)


def content_key(content: Column) -> Column:
    """A repeatable row key for text without one."""
    return F.xxhash64(content)


def token_length(tokens: Column) -> Column:
    return F.greatest(F.size(tokens), F.lit(1)).cast("double")


def first_k(df: DataFrame, k: int, by: str, tie: str, descending: bool = False) -> DataFrame:
    """First k rows by (by, tie); nulls come last.

    A quantile of ``by`` gives a cut behind the k-th row; a count proves that enough rows
    lie before it, or the cut moves on. The wide rows are then read up to the cut, a plain comparison that
    the scan takes, so little more than k rows are sorted.
    """
    order = [F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), F.asc(tie)]
    total = df.filter(F.col(by).isNotNull()).count()
    share = k / total if total else 1.0
    while share < 1:
        share = min(1.0, 1.02 * share + 10 / total)
        cut = df.select(F.percentile_approx(by, F.lit(1 - share if descending else share), 100_000)).first()[0]
        within = F.col(by) >= F.lit(cut) if descending else F.col(by) <= F.lit(cut)
        if df.filter(within).count() >= k:
            df = df.filter(within)
            break
    return df.orderBy(*order).limit(k)


def latest_k(df: DataFrame, k: int, date: str, tie: str) -> DataFrame:
    return first_k(df, k, date, tie, descending=True)


def hash_fraction(key: Column, seed: int = SEED) -> Column:
    """A fixed number in [0, 1) per key: the same row lands in the same split every time."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def split_number(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """Which of the weighted splits a row falls in, weights normalised to sum 1."""
    total = float(sum(weights))
    u = hash_fraction(key, seed)
    out, upto = None, 0.0
    for i, w in enumerate(weights[:-1]):
        upto += w / total
        cond = u < F.lit(upto)
        out = F.when(cond, i) if out is None else out.when(cond, i)
    last = len(weights) - 1
    return (F.lit(last) if out is None else out.otherwise(last)).cast("int")


def random_splits(df: DataFrame, weights: Sequence[float], seed: int = SEED) -> list[DataFrame]:
    """Spark's own sampling split; repeatable only for a fixed row layout."""
    return df.randomSplit(list(weights), seed)


def fold_number(key: Column, folds: int, seed: int = FOLD_SEED) -> Column:
    """Fold of a row. Not the split's seed: within one split those numbers are not uniform."""
    return F.floor(hash_fraction(key, seed) * folds).cast("int")


def build_sets(
    news: DataFrame,
    validation: DataFrame,
    extra_unreliable: DataFrame,
    key: str = "doc_id",
    unreliable_weights: Sequence[float] = UNRELIABLE_WEIGHTS,
    credible_weights: Sequence[float] = CREDIBLE_WEIGHTS,
) -> DataFrame:
    """(dataset, key, content, label) of the train, test, validation and held-out sets.

    Each class of the news has its own split; the third credible part joins the extra
    unreliable source in the held-out set. Every source is read once: the split number
    names the set of a row, and ``one_set`` is a filter on that name.
    """

    def named(df: DataFrame, dataset: Column) -> DataFrame:
        return df.select(dataset.alias("dataset"), key, "content", "label")

    def by_split(weights: Sequence[float]) -> Column:
        names = F.array(*[F.lit(n) for n in ("train", "test", "held_out")[: len(weights)]])
        return F.get(names, split_number(F.col(key), weights))

    split = F.when(F.col("label") == CREDIBLE, by_split(credible_weights)).otherwise(
        by_split(unreliable_weights)
    )
    return (
        named(news, split)
        .unionByName(named(validation, F.lit("validation")))
        .unionByName(named(extra_unreliable, F.lit("held_out")))
    )


def one_set(sets: DataFrame, name: str) -> DataFrame:
    return sets.filter(F.col("dataset") == name).drop("dataset")


def sorted_by_content(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Delivery order. The key follows the text, so copies of one text can be cut apart."""
    return df.orderBy("content", key)


def delivered_ranges(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """(range, first, last, n, in_order) of the delivery order, as it was written.

    The rows are sorted by ranges and written; each range of ``rows`` rows of what was written then tells its first and last
    key, its length, and whether every row stands behind the one before it, the last row of the earlier range included. No task sorts more than its own range.
    """
    numbered = dense_index(df.select("content", key), "content", key)
    place = F.struct("content", key)
    part = numbered.select("content", key, "idx", F.floor(F.col("idx") / rows).alias("range"))
    inside = Window.partitionBy("range").orderBy("idx")
    part = stored(part.withColumn("_behind", F.coalesce(place >= F.lag(place).over(inside), F.lit(True))))
    ends = part.groupBy("range").agg(
        F.min_by(key, "idx").alias("first"), F.max_by(key, "idx").alias("last"), F.count("*").alias("n"), F.bool_and("_behind").alias("_sorted"),
        F.min_by(place, "idx").alias("_first"), F.max_by(place, "idx").alias("_last"),
    )
    before = ends.select((F.col("range") + 1).alias("range"), F.col("_last").alias("_before"))
    joined = ends.join(before, "range", "left")
    return joined.select("range", "first", "last", "n", (F.col("_sorted") & F.coalesce(F.col("_first") >= F.col("_before"), F.lit(True))).alias("in_order"))

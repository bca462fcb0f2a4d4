"""Sums and similarities over a table of vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from truthmill.functions.vectors import cosine, l2_normalise
from truthmill.operators.shared import join_words, stored

# A label row holds a whole vector, so the bound is lower than for words.
LABELS_TO_BROADCAST = 10_000


def as_double(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, F.col(column).cast("array<double>"))


def label_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(label, label_sum): element-wise sums, kept as one vector per label in every task."""
    vector = array_to_vector(F.col(column))
    sums = df.groupBy("label").agg(Summarizer.sum(vector).alias("s"))
    return sums.select("label", vector_to_array("s").alias("label_sum"))


def sum_by_label(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(label, pos, total)"""
    return label_vectors(df, column).select("label", F.posexplode("label_sum").alias("pos", "total"))


def similarity_to_label(df: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Cosine of each vector with the sum of its label's vectors."""
    sums = stored(label_vectors(df, column))
    joined = join_words(df, sums, "label", LABELS_TO_BROADCAST)
    return joined.withColumn("cosine", cosine(F.col(column), F.col("label_sum")))


def most_similar(df: DataFrame, k: int, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k vectors of each label closest to the label's sum.

    The rank filter lets Spark keep only k rows per label in every task before the shuffle.
    """
    order = Window.partitionBy("label").orderBy(F.desc("cosine"), key)
    ranked = similarity_to_label(df, column, key).select(
        "label", key, "cosine", F.row_number().over(order).alias("rank")
    )
    return ranked.filter(F.col("rank") <= k)


def normalised(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, l2_normalise(F.col(column)))

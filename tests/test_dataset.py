from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from truthmill.operators import dataset

SF = "/root/testdata/sf0.001"


def test_non_blank_drops_null_and_blank(spark):
    rows = [(1, "a"), (2, " "), (3, ""), (4, None), (5, " x ")]
    df = spark.createDataFrame(rows, "doc_id long, body string")
    out = dataset.labelled(df, "body", dataset.UNRELIABLE)
    assert sorted((r.doc_id, r.content, r.label) for r in out.collect()) == [(1, "a", 0.0), (5, " x ", 0.0)]


def test_category_label(spark):
    df = spark.createDataFrame([("Лайфстайл",), ("Спорт",), (None,)], "c string")
    labels = [r[0] for r in df.select(dataset.category_label(F.col("c"), "Лайфстайл")).collect()]
    assert labels == [1.0, 0.0, 0.0]


def test_splits_are_disjoint_and_cover(spark):
    docs = spark.range(20_000).withColumn("s", dataset.split_number(F.col("id"), (0.6, 0.3, 0.1)))
    counts = {r.s: r["count"] for r in docs.groupBy("s").count().collect()}
    assert sum(counts.values()) == 20_000 and set(counts) == {0, 1, 2}
    for part, weight in zip((0, 1, 2), (0.6, 0.3, 0.1)):
        assert abs(counts[part] / 20_000 - weight) < 0.02


def test_weights_are_normalised_and_a_zero_weight_takes_nothing(spark):
    docs = spark.range(2_000)
    same = docs.select(
        dataset.split_number(F.col("id"), (7.0, 3.0)).alias("a"), dataset.split_number(F.col("id"), (0.7, 0.3)).alias("b"),
        dataset.split_number(F.col("id"), (0.7, 0.0)).alias("z"),
    )
    assert same.filter("a <> b").count() == 0 and same.filter("z <> 0").count() == 0


def test_split_does_not_depend_on_the_layout(spark):
    split = dataset.split_number(F.col("id"), (0.7, 0.3))
    a = spark.range(500).select("id", split.alias("s")).collect()
    b = spark.range(500).repartition(7).select("id", split.alias("s")).collect()
    assert sorted(a) == sorted(b)


def test_folds_of_one_split_are_all_filled(spark):
    part = spark.range(2_000).filter(dataset.split_number(F.col("id"), (0.7, 0.3)) == 0)
    assert part.select(dataset.fold_number(F.col("id"), 10).alias("f")).distinct().count() == 10


@pytest.mark.parametrize("k", [1, 3, 6, 9, 20])
@pytest.mark.parametrize("descending", [True, False])
def test_first_k_against_sorting(spark, k, descending):
    start = datetime(2024, 1, 1)
    dates = [3, 1, None, 3, 2, 3, None, 1]
    rows = [(i, None if d is None else start + timedelta(days=d), "wide" * 3) for i, d in enumerate(dates)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, body string")
    out = [r.id for r in dataset.first_k(df, k, "ts", "id", descending).collect()]
    known = [r for r in rows if r[1] is not None]
    known.sort(key=lambda r: (r[1], -r[0]) if descending else (r[1], r[0]), reverse=descending)
    assert out == [r[0] for r in known + [r for r in rows if r[1] is None]][:k]


def test_build_sets(spark):
    news = spark.read.parquet(f"{SF}/documents.parquet").select(
        "doc_id", F.col("text").alias("content"), (F.col("doc_id") % 2).cast("double").alias("label")
    )
    other = news.limit(0)
    sets = dataset.build_sets(news, other, other)
    assert sets.count() == news.count()
    assert dataset.one_set(sets, "held_out").filter("label = 0").count() == 0
    train, test = dataset.one_set(sets, "train"), dataset.one_set(sets, "test")
    assert train.join(test, "doc_id").count() == 0


def test_sampling_split_and_content_key(spark):
    a, b = dataset.random_splits(spark.range(1000), [0.5, 0.5])
    assert a.count() + b.count() == 1000
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "c string")
    assert df.select(dataset.content_key(F.col("c")).alias("k")).distinct().count() == 2

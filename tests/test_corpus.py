import math
from collections import Counter

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from truthmill.functions import vectors
from truthmill.operators import corpus, embedding, shared

DOCS = [(1, 0.0, "a b a c"), (2, 1.0, "a d"), (3, 1.0, ""), (4, 0.0, "b b b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, label double, content string")


def terms():
    return F.filter(F.split("content", " "), lambda t: t != "")


def test_bag_of_words(docs):
    out = {(r.doc_id, r.word): r.tf for r in corpus.bag_of_words(docs, terms(), "doc_id").collect()}
    expected = {(i, w): n for i, _, t in DOCS for w, n in Counter(t.split()).items()}
    assert out == expected


def test_word_count_and_top(docs):
    counts = corpus.word_count(docs, terms())
    assert {r.word: r.cnt for r in counts.collect()} == Counter(" ".join(d[2] for d in DOCS).split())
    assert [tuple(r) for r in corpus.top_words(counts, 2).collect()] == [("b", 4), ("a", 3)]


def test_three_ways_to_the_class_counts_agree(docs):
    def rows(df):
        return sorted(tuple(r) for r in df.select("word", "cnt0", "cnt1", "cnt").collect())

    by_class = [corpus.class_word_count(docs.filter(F.col("label") == c), terms()).drop("label") for c in (0.0, 1.0)]
    expected = [("a", 2, 1, 3), ("b", 4, 0, 4), ("c", 1, 0, 1), ("d", 0, 1, 1)]
    assert rows(corpus.join_class_counts(*by_class)) == expected
    assert rows(corpus.class_counts(docs, terms())) == expected
    assert rows(corpus.bag_class_counts(corpus.bag_of_words(docs, terms(), "doc_id", "label"))) == expected


def test_vocabulary_is_dense_and_ordered(spark):
    counts = spark.range(5_000).select(F.md5(F.col("id").cast("string")).alias("word"), (F.col("id") % 30).alias("cnt"))
    vocab = corpus.vocabulary(counts).orderBy("idx").collect()
    assert [r.idx for r in vocab] == list(range(len(vocab)))
    assert [r.word for r in vocab] == sorted(r.word for r in vocab)
    assert min(r.cnt for r in vocab) == 11


def test_running_sums_with_one_hot_value(spark):
    values = [(i, 1 if i % 3 else 100) for i in range(3_000)]
    df = spark.createDataFrame(values, "k long, v long")
    out = shared.running_sums(df, F.desc("k"), upto="v").orderBy(F.desc("k")).collect()
    total = 0
    for row, (k, v) in zip(out, sorted(values, reverse=True)):
        total += v
        assert (row.k, row.upto) == (k, total)
    assert {r.upto_total for r in out} == {total}


def test_shuffled_join_equals_broadcast_join(spark):
    """A third of the rows on one word, with the bound forcing the shuffle."""
    bag = spark.range(3_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 50).cast("string"))).alias("word"),
    )
    words = bag.select("word").distinct().withColumn("x", F.length("word"))
    a = shared.join_words(bag, words, "word")
    b = shared.join_words(bag, words, "word", broadcast_rows=5)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))
    assert a.count() == 3_000


def test_tfidf(docs):
    bag = corpus.bag_of_words(docs, terms(), "doc_id", "label")
    vocab = corpus.vocabulary(corpus.bag_class_counts(bag), min_count=1)
    weights = corpus.tfidf(bag, vocab, F.lit(4), "doc_id")
    out = {(r.doc_id, r.word): r.weight for r in weights.collect()}
    assert set(out) == {(1, "a"), (1, "b"), (2, "a"), (4, "b")}
    assert out[(4, "b")] == pytest.approx(math.sqrt(3) * (math.log(4 / 5) + 1))
    rows = {r.doc_id: r.features for r in corpus.tfidf_vectors(weights, docs.select("doc_id"), F.lit(2)).collect()}
    assert rows[3] == SparseVector(2, {})
    assert rows[1].indices.tolist() == [0, 1]
    assert rows[4][1] == pytest.approx(out[(4, "b")])


def test_idf_forms(spark):
    row = spark.range(1).select(
        corpus.idf_plain(F.lit(10), F.lit(4)).alias("p"), corpus.idf_smoothed(F.lit(10), F.lit(4)).alias("s")
    ).first()
    assert row.p == pytest.approx(math.log(3.5)) and row.s == pytest.approx(math.log(11 / 5))


def test_class_similarity_against_brute_force(spark, docs):
    out = {r.doc_id: (r.to_unreliable, r.to_credible) for r in corpus.class_similarity(docs, terms()).collect()}
    sums = {c: Counter() for c in (0.0, 1.0)}
    for _, label, text in DOCS:
        sums[label].update(text.split())

    def cosine(a, b):
        dot = sum(a[w] * b[w] for w in a)
        return dot / math.sqrt(sum(v * v for v in a.values())) / math.sqrt(sum(v * v for v in b.values()))

    for key, _, text in DOCS:
        if text:
            expected = tuple(cosine(Counter(text.split()), sums[c]) for c in (0.0, 1.0))
            assert out[key] == pytest.approx(expected)
    assert 3 not in out


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    a, z = F.col("a"), F.col("z")
    row = df.select(
        vectors.cosine(a, a).alias("self"), vectors.cosine(a, z).alias("zero"), vectors.add(a, a).alias("sum"),
        vectors.l2_normalise(a).alias("unit"), vectors.l2_normalise(z).alias("zeros"),
    ).first()
    assert (row.self, row.zero, row.sum) == (1.0, None, [6.0, 8.0])
    assert row.unit == [0.6, 0.8] and row.zeros == [0.0, 0.0]


def test_most_similar_per_label(spark):
    rows = [(i, [1.0, float(i)], i % 2) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = embedding.most_similar(df, 2).collect()
    assert len(out) == 4 and {r.rank for r in out} == {1, 2}
    assert embedding.sum_by_label(df).filter("label = 1 and pos = 1").first().total == 16.0


def test_shared_folder_is_the_session_setting(spark):
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_release_removes_stored_tables(spark):
    shared.release(spark)
    spark_rows = shared.stored(spark.range(5).toDF("id"))
    assert spark_rows.count() == 5
    assert shared.release(spark) == 1
    assert shared.release(spark) == 0


def test_only_rare_words_of_a_long_list_are_shuffled(spark):
    """A list beyond the bound gives the same sums, with a word in every document taken before any shuffle."""
    texts = [(i, f"hot hot w{i % 40} only{i} none{i}") for i in range(400)] + [(500, "nothing"), (501, None)]
    docs = spark.createDataFrame(texts, "doc_id long, content string").repartition(4)
    bag = corpus.bag_of_words(docs, F.split("content", " "), "doc_id")
    words = [("hot", 1.0), *[(f"w{i}", -0.5) for i in range(40)], *[(f"only{i}", 2.0) for i in range(0, 400, 2)], ("zero", 0.0)]
    scored = spark.createDataFrame(words, "word string, score double").localCheckpoint()
    whole = corpus.score_words(bag, scored)
    want = {i: (2.0 + 2.0 * (i % 2 == 0), 0.5, 3 + (i % 2 == 0)) for i in range(400)}
    for bound in (1, 3, 60, 1_000):
        out = corpus.score_words(bag, scored, broadcast_rows=bound)
        assert {r.doc_id: (r.positive_score, r.negative_score, r.scored_tokens) for r in out.collect()} == want
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out.collect()))
    frequent = {r.word for r in corpus._frequent_words(bag, "doc_id", 1).collect()}
    assert frequent == {"hot"} and corpus._frequent_words(bag.limit(0), "doc_id", 5).count() == 0

"""Corpus statistics: bags of words, counts, vocabulary, TF-IDF and class similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from truthmill.functions.arrays import run_lengths
from truthmill.functions.vectors import sparse_vector
from truthmill.operators.shared import BROADCAST_ROWS, dense_index, is_small, join_words, stored

# --- fixed value: words are kept above this count -----------------------------------
MIN_COUNT = 10
# ------------------------------------------------------------------------------------
#: Of so many documents one is looked at to find the words that most rows hold.
FREQUENT_SHARE = 64


def bag_of_words(df: DataFrame, terms: Column, *keys: str) -> DataFrame:
    """(keys, word, tf), counted inside each row, so nothing is shuffled."""
    return df.select(*keys, F.inline(run_lengths(terms)))


def word_count(df: DataFrame, terms: Column) -> DataFrame:
    """Occurrences of every word in the corpus."""
    words = df.select(F.explode(terms).alias("word")).filter(F.col("word") != "")
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def top_words(counts: DataFrame, k: int, *first: str) -> DataFrame:
    """The k most frequent words; equal counts go by word."""
    return counts.orderBy(F.desc("cnt"), "word").limit(k)


def class_word_count(df: DataFrame, terms: Column) -> DataFrame:
    """Total occurrences by class and word."""
    return df.select("label", F.explode(terms).alias("word")).groupBy("label", "word").agg(
        F.count("*").alias("cnt")
    )


def join_class_counts(class0: DataFrame, class1: DataFrame) -> DataFrame:
    """Full outer join of two (word, cnt) tables, a missing count being zero."""
    left = class0.select("word", F.col("cnt").alias("cnt0"))
    right = class1.select("word", F.col("cnt").alias("cnt1"))
    none = F.lit(0).cast("long")
    return left.join(right, "word", "full_outer").select(
        "word",
        F.coalesce("cnt0", none).alias("cnt0"),
        F.coalesce("cnt1", none).alias("cnt1"),
        (F.coalesce("cnt0", none) + F.coalesce("cnt1", none)).alias("cnt"),
    )


def class_counts(df: DataFrame, terms: Column) -> DataFrame:
    """(word, cnt0, cnt1, cnt) in one pass: the joined counts as conditional sums."""
    words = df.select("label", F.explode(terms).alias("word"))
    return words.groupBy("word").agg(
        F.count_if(F.col("label") == 0.0).alias("cnt0"),
        F.count_if(F.col("label") == 1.0).alias("cnt1"),
        F.count("*").alias("cnt"),
    )


def bag_class_counts(bag: DataFrame) -> DataFrame:
    """The same counts from a stored (label, word, tf) bag, without tokenising again."""
    tf, zero = F.col("tf"), F.lit(0).cast("long")
    return bag.groupBy("word").agg(
        F.sum(F.when(F.col("label") == 0.0, tf).otherwise(zero)).alias("cnt0"),
        F.sum(F.when(F.col("label") == 1.0, tf).otherwise(zero)).alias("cnt1"),
        F.sum("tf").alias("cnt"),
    )


def vocabulary(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Words above the count, numbered from 0 in word order."""
    return dense_index(counts.filter(F.col("cnt") > min_count), "word")


def vocabulary_stats(counts: DataFrame) -> DataFrame:
    return counts.agg(
        F.count("*").alias("words"),
        F.avg("cnt").alias("mean"),
        F.stddev_pop("cnt").alias("stdev"),
        F.max("cnt").alias("max"),
        F.min("cnt").alias("min"),
    )


def idf_plain(documents: Column, count: Column) -> Column:
    """ln(1 + N / count)"""
    return F.log(F.lit(1.0) + documents / count)


def idf_smoothed(documents: Column, frequency: Column) -> Column:
    """ln((m + 1) / (df + 1)), the smoothing of the ML stage."""
    return F.log((documents + 1.0) / (frequency + 1.0))


def tfidf_weight(tf: Column, frequency: Column, documents: Column) -> Column:
    """sqrt(tf) * (ln(N / (df + 1)) + 1)"""
    return F.sqrt(tf.cast("double")) * (F.log(documents / (frequency + 1.0)) + 1.0)


def document_frequency(df: DataFrame, terms: Column) -> DataFrame:
    words = df.select(F.explode(F.array_distinct(terms)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("df"))


def document_idf(df: DataFrame, terms: Column) -> DataFrame:
    """(word, df, idf) over all documents of the table."""
    documents = df.select(F.count("*")).scalar()
    return document_frequency(df, terms).withColumn("idf", idf_smoothed(documents, F.col("df")))


def tfidf(
    bag: DataFrame, vocab: DataFrame, documents: Column, *keys: str, frequency: str = "cnt"
) -> DataFrame:
    """(keys, word, idx, tf, weight) of a bag of words, for the words of a stored vocabulary.

    ``frequency`` names the vocabulary column that stands for the document frequency;
    the default is the stored number of occurrences.
    """
    words = vocab.select("word", "idx", F.col(frequency).alias("_df"))
    joined = join_words(bag.select(*keys, "word", "tf"), words, "word")
    return joined.select(
        *keys, "word", "idx", "tf", tfidf_weight(F.col("tf"), F.col("_df"), documents).alias("weight")
    )


def tfidf_vectors(weights: DataFrame, documents: DataFrame, size: Column, key: str = "doc_id") -> DataFrame:
    """One sparse ML vector per document; a document without known words gets an empty one.

    A group is one document's distinct words, so it is as large as one text.
    """
    entries = F.sort_array(F.collect_list(F.struct("idx", "weight")))
    grouped = weights.groupBy(key).agg(entries.alias("e"))
    joined = documents.join(grouped, key, "left")
    empty = F.array().cast("array<struct<idx:bigint,weight:double>>")
    e = F.coalesce(F.col("e"), empty)
    return joined.select(
        *documents.columns, sparse_vector(size, e["idx"], e["weight"]).alias("features")
    )


def score_words(bag: DataFrame, scored: DataFrame, key: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Positive and negative score sums of every document against a stored (word, score) table.

    Every word of a document counts. A list beyond the bound is taken in two parts, so that few of the documents' words are
    shuffled: the frequent words are broadcast, and only the rest of the bag meets the rest of the list by word.
    """
    if is_small(scored, broadcast_rows):
        hits = bag.join(F.broadcast(scored), "word")
    else:
        frequent = F.broadcast(_frequent_words(bag, key, broadcast_rows))
        near = bag.join(F.broadcast(stored(scored.join(frequent, "word", "left_semi"))), "word")
        far = bag.join(frequent, "word", "left_anti").join(scored.join(frequent, "word", "left_anti"), "word")
        hits = near.unionByName(far)
    score = F.col("tf") * F.col("score")
    return hits.groupBy(key).agg(
        F.sum(F.when(F.col("score") > 0, score).otherwise(0.0)).alias("positive_score"),
        F.sum(F.when(F.col("score") < 0, -score).otherwise(0.0)).alias("negative_score"),
        F.sum("tf").alias("scored_tokens"),
    )


def _frequent_words(bag: DataFrame, key: str, most: int) -> DataFrame:
    """A stored table of up to ``most`` words that stand in many documents, as one document in ``FREQUENT_SHARE`` shows.

    It only says which way a word's rows go, as the bounds of a sort by ranges do.
    """
    some = bag.filter(F.pmod(F.xxhash64(key), F.lit(FREQUENT_SHARE)) == 0)
    counts = stored(some.groupBy("word").agg(F.count("*").alias("n")))
    least = 1
    while not is_small(counts.filter(F.col("n") >= least), most):
        least += 1
    return stored(counts.filter(F.col("n") >= least).select("word"))


def class_similarity(df: DataFrame, terms: Column, key: str = "doc_id") -> DataFrame:
    """Cosine of every document's word counts with the summed counts of each class.

    Finds which side an article resembles without pairing articles: the class sums are
    one row per word, so the work is one join of the bags with them.
    """
    bag = stored(bag_of_words(df, terms, key, "label"))
    sums = stored(bag_class_counts(bag).select("word", "cnt0", "cnt1"))
    squared = sums.agg(
        F.sum(F.col("cnt0").cast("double") * F.col("cnt0")).alias("n0"),
        F.sum(F.col("cnt1").cast("double") * F.col("cnt1")).alias("n1"),
    )
    hits = join_words(bag.select(key, "word", "tf"), sums, "word")
    tf = F.col("tf").cast("double")
    dots = hits.groupBy(key).agg(
        F.sum(tf * F.col("cnt0")).alias("d0"),
        F.sum(tf * F.col("cnt1")).alias("d1"),
        F.sum(tf * tf).alias("n"),
    )
    n0, n1 = squared.select("n0").scalar(), squared.select("n1").scalar()
    return dots.select(
        key,
        F.try_divide(F.col("d0"), F.sqrt("n") * F.sqrt(n0)).alias("to_unreliable"),
        F.try_divide(F.col("d1"), F.sqrt("n") * F.sqrt(n1)).alias("to_credible"),
    )


def naive_bayes_theta(counts: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Log word probabilities by class from a (word, cnt0, cnt1) vocabulary."""
    totals = counts.agg(
        F.sum("cnt0").alias("t0"), F.sum("cnt1").alias("t1"), F.count("*").alias("v")
    )
    v = totals.select("v").scalar()
    by_class = [
        counts.select(
            F.lit(float(c)).alias("label"),
            "word",
            F.log(
                (F.col(f"cnt{c}") + smoothing)
                / (totals.select(f"t{c}").scalar() + v * smoothing)
            ).alias("theta"),
        )
        for c in (0, 1)
    ]
    return by_class[0].unionByName(by_class[1])

"""Every query of the engine over the given tables, by name.

Each takes (spark, folder of parquet tables) and returns a DataFrame. Column names
match the SQL in ``truthmill.plans.oracles``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import HashingTF, Word2VecModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from truthmill.functions import credibility as cred
from truthmill.functions import tokens as tok
from truthmill.functions.arrays import blank_out, keep
from truthmill.lexicon import MULTILINGUAL as LEX
from truthmill.operators import cooccurrence, corpus, dataset, embedding, evaluation, features, hinge, neighbours, pages, pairs
from truthmill.operators.shared import made_once, new_path, stored, table_state
from truthmill.plans import models
from truthmill.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CREDIBLE_CATEGORY = "en"
SCORE_CUT = 0.11
SIMILAR_ARTICLES = 0.2
SITE_ARTICLE = r"^https?://[^/]+/(en|fr)/[0-9]+([/?#.].*)?$"
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абцдефгхийклмнопярстувътез"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- base tables -----------------------------------------------------------------------


def table(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return readers.read_table(spark, f"{d}/{name}.parquet", *columns)


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    df = table(spark, d, "documents", "doc_id", *columns)
    return readers.spread(df, "doc_id")


def events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return readers.spread(table(spark, d, "events", "event_id", *columns), "event_id")


def news(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """(doc_id, content, label, …): documents with a quality mark, 1 credible and 0 not."""
    docs = documents(spark, d, "text", *more)
    marks = table(spark, d, "labels", "doc_id", "quality")
    return docs.join(marks, "doc_id").select(
        "doc_id", F.col("text").alias("content"), F.col("quality").cast("double").alias("label"), *more
    )


def all_sets(spark: SparkSession, d: str) -> DataFrame:
    """The four sets: marked documents, conversation turns, and the extra unreliable source.

    Keys are text, and those of the other sources are prefixed, so no two rows share one.
    """
    turns = readers.spread(table(spark, d, "conversations", "conv_id", "turn", "role", "text"), "conv_id", "turn")
    turns = turns.withColumn("doc_id", F.concat_ws(":", F.lit("turn"), "conv_id", "turn"))
    extra = table(spark, d, "benchmark", F.concat(F.lit("item:"), F.col("item_id").cast("string")).alias("doc_id"), "text")
    return dataset.build_sets(
        news(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")),
        dataset.labelled(turns, "text", dataset.category_label(F.col("role"), "user")),
        dataset.labelled(extra, "text", dataset.UNRELIABLE),
    )


def scored(df: DataFrame) -> DataFrame:
    """A fixed rule in place of a model, so that the metrics have exact expected values."""
    out = features.credibility_features(df, "content", LEX)
    score = F.col("first_upper_ratio")
    return out.withColumn("score", score).withColumn(
        "prediction", F.when(score < SCORE_CUT, 1.0).otherwise(0.0)
    )


def joined(tokens, sep: str = "|"):
    return F.array_join(tokens, sep)


def terms(content: str = "content"):
    return tok.analyzer_terms(F.col(content), LEX)


def news_bag(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, label, word, tf) of the marked documents, tokenised once and stored."""
    return stored(corpus.bag_of_words(news(spark, d), terms(), "doc_id", "label"))


# ---- sources and sinks -----------------------------------------------------------------


@query
def page_scan(spark, d):
    return readers.read_pages(spark, f"{d}/pages.parquet")


@query
def lexicon_dedup(spark, d):
    words = news(spark, d).select(
        "doc_id", "label", F.posexplode(tok.letter_tokens(F.col("content"))).alias("pos", "word")
    )
    lines = words.select(
        F.struct("doc_id", "pos").alias("at"),
        F.concat_ws(",", F.lower("word"), F.col("label").cast("string")).alias("line"),
    )
    return readers.parse_scored_words(lines)


@query
def page_to_json(spark, d):
    return pages.record_json(page_records(spark, d))


@query
def export_features(spark, d):
    """All marked documents, the validation set and the held-out set, which holds some of the marked ones again."""
    marked = F.col("dataset").isin("train", "test", "held_out") & ~F.col("doc_id").contains(":")
    times = F.when(marked, 1).otherwise(0) + F.when(F.col("dataset").isin("held_out", "validation"), 1).otherwise(0)
    rows = all_sets(spark, d).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), times))).drop("_copy", "dataset")
    return features.credibility_features(rows).select("label", "doc_id", *cred.FEATURES)


@query
def word_count_lines(spark, d):
    counts = corpus.class_counts(news(spark, d), terms()).filter(F.col("cnt") > corpus.MIN_COUNT)
    return writers.word_count_lines(counts)


@query
def jsonl_repair(spark, d):
    """Event properties, those of the larger values cut short so that they do not parse."""
    cut = F.when(F.col("value") > 20, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    lines = events(spark, d, "value", "event_type", "props").select(
        "event_type", cut.alias("value")
    )
    flagged = readers.repair_json_lines(lines)
    return flagged.groupBy("event_type").agg(
        F.count_if("parses").alias("kept"), F.count_if(~F.col("parses")).alias("skipped")
    )


@query
def jsonl_repaired_lines(spark, d):
    """The lines that parse, as they were written next to the others and read back."""
    cut = F.when(F.col("value") > 20, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    lines = events(spark, d, "value", "props").select(F.concat(F.lit('{"id":'), "event_id", F.lit(',"p":'), cut, F.lit("}")).alias("value"))
    kept, _ = readers.route_json_lines(lines, new_path(spark))
    return kept.withColumnRenamed("value", "line")


# ---- page extraction -------------------------------------------------------------------


def page_table(spark: SparkSession, d: str) -> DataFrame:
    return readers.spread(readers.read_pages(spark, f"{d}/pages.parquet"), "page_id")


def page_records(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return pages.extract_records(page_table(spark, d), fields=fields or tuple(pages.FIELDS))


@query
def page_url_parts(spark, d):
    url = F.col("url")
    return table(spark, d, "pages", "page_id", "url").select(
        "page_id",
        *[pages.url_part(url, part).alias(part.lower()) for part in ("PROTOCOL", "HOST", "PATH", "QUERY", "REF")],
    )


@query
def page_extract(spark, d):
    return page_records(spark, d, "key", "title", "content")


@query
def page_link_list(spark, d):
    return page_records(spark, d, "key", "category")


@query
def page_article_filter(spark, d):
    content = pages.article_content(F.col("url"), F.col("content"), SITE_ARTICLE)
    return page_records(spark, d, "key", "url", "content").select(
        "key", pages.is_article(F.col("url"), SITE_ARTICLE).alias("is_article"), content.alias("content")
    )


def broken_pages(spark: SparkSession, d: str) -> DataFrame:
    """Records of pages of which some have no address that parses and some are no articles."""
    site = pages.SiteProfile(
        host=".", title="title", content="article", article=SITE_ARTICLE
    )
    broken = F.replace("url", F.lit("#"), F.lit(" #"))
    return pages.extract_records(page_table(spark, d).withColumn("url", broken), (site,))


@query
def page_reject_counts(spark, d):
    return pages.reject_counts(broken_pages(spark, d))


def _counted(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


@query
def page_write_counts(spark, d):
    """Pages of each outcome, counted by the write that puts the records as JSON lines into a folder for each."""
    return _counted(spark, pages.write_records(broken_pages(writers.own_session(spark), d), new_path(spark)))


@query
def publish_date_parse(spark, d):
    """Order dates written in the two layouts, and for one status in none."""
    date, status = F.col("o_orderdate"), F.col("o_orderstatus")
    text = (
        F.when(status == "O", F.date_format(date, "dd.MM.yyyy HH:mm"))
        .when(status == "F", F.date_format(date, "dd MMM yyyy"))
        .otherwise(F.date_format(date, "yyyy/MM/dd"))
    )
    rows = readers.spread(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate"), "o_orderkey")
    parsed = pages.parse_date(text)
    return rows.select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("published"))


@query
def view_count_split(spark, d):
    before, after = pages.VIEW_PHRASES
    views = F.when(F.col("event_type") == "error", "-").otherwise(F.floor("value").cast("string"))
    text = F.concat(
        F.date_format("ts", "dd.MM.yyyy HH:mm"), F.lit(" " + before), views, F.lit(after)
    )
    date, count = pages.dated_view_parts(F.col("field"))
    return events(spark, d, "ts", "event_type", "value").select(
        "event_id", text.alias("field")
    ).select(
        "event_id",
        F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias("published"),
        pages.count_or_zero(count).alias("view_count"),
        pages.count_or_zero(F.lit("")).alias("comment_count"),
    )


# ---- dataset preparation ---------------------------------------------------------------


@query
def nonblank_docs(spark, d):
    return dataset.non_blank(table(spark, d, "documents", "doc_id", "text"), "text")


@query
def labelled_docs(spark, d):
    return dataset.labelled(news(spark, d).withColumnRenamed("label", "l"), "content", F.col("l"))


@query
def category_to_label(spark, d):
    docs = table(spark, d, "documents", "doc_id", "lang")
    return docs.select(
        "doc_id",
        F.col("lang").alias("category"),
        dataset.category_label(F.col("lang"), CREDIBLE_CATEGORY).alias("label"),
    )


@query
def without_source(spark, d):
    return dataset.without_value(table(spark, d, "documents", "doc_id", "source"), "source", "src0")


@query
def latest_k(spark, d):
    rows = dataset.latest_k(table(spark, d, "events"), dataset.LATEST_CREDIBLE, "ts", "event_id")
    return rows.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "user_id", "props")


@query
def corpus_sample(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").isNotNull())
    return dataset.first_k(docs, dataset.CORPUS_ROWS, "doc_id", "doc_id").withColumnRenamed("text", "content")


@query
def weighted_split(spark, d):
    key = F.col("doc_id")
    return table(spark, d, "documents", "doc_id").select(
        "doc_id",
        dataset.split_number(key, dataset.UNRELIABLE_WEIGHTS).alias("two_way"),
        dataset.split_number(key, dataset.CREDIBLE_WEIGHTS).alias("three_way"),
    )


@query
def train_test_union(spark, d):
    return all_sets(spark, d).select("dataset", "doc_id", "label", F.length("content").alias("chars"))


@query
def sorted_corpus(spark, d):
    docs = table(spark, d, "documents", "doc_id", F.col("text").alias("content"))
    return dataset.sorted_by_content(docs)


@query
def delivered_ranges(spark, d):
    """The sorted corpus as it was written, a thousand rows a range: first and last document, length, and proof of the order."""
    return dataset.delivered_ranges(table(spark, d, "documents", "doc_id", F.col("text").alias("content")), 1000)


@query
def token_length(spark, d):
    docs = documents(spark, d, "text")
    return docs.select("doc_id", dataset.token_length(tok.split_tokens(F.col("text"))).alias("length"))


# ---- tokens ----------------------------------------------------------------------------


def _tokens(spark: SparkSession, d: str, tokens) -> DataFrame:
    return documents(spark, d, "text").withColumn("t", tokens).select(
        "doc_id", F.size("t").alias("n"), joined(F.col("t")).alias("tokens")
    )


@query
def regex_tokens(spark, d):
    return _tokens(spark, d, tok.split_tokens(F.col("text")))


@query
def stopword_filter(spark, d):
    return _tokens(spark, d, tok.drop_stop_words(tok.split_tokens(F.col("text")), LEX.stop))


@query
def bigrams(spark, d):
    kept = tok.drop_stop_words(tok.split_tokens(F.col("text")), LEX.stop)
    docs = documents(spark, d, "text").withColumn("k", kept)
    return docs.withColumn("t", tok.ngrams(F.col("k"), 2)).select(
        "doc_id", F.size("t").alias("n"), joined(F.col("t")).alias("tokens")
    )


@query
def letter_tokens(spark, d):
    return _tokens(spark, d, tok.letter_tokens(F.col("text")))


@query
def letter_tokens_stop(spark, d):
    return _tokens(spark, d, tok.feature_tokens(F.col("text"), LEX))


@query
def word_tokens(spark, d):
    return _tokens(spark, d, tok.word_tokens(F.col("text")))


@query
def number_filter(spark, d):
    text = F.concat_ws(
        " ", "event_type", F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")), "props"
    )
    words = F.split(text, r"[\s:{}]+")
    return events(spark, d, "event_type", "value", "props").withColumn("t", words).select(
        "event_id",
        joined(keep(F.col("t"), lambda t: ~tok.is_number(t) & (t != ""))).alias("kept"),
        F.size(keep(F.col("t"), tok.is_number)).cast("long").alias("numbers"),
    )


@query
def stem_tokens(spark, d):
    """The documents spelt with Cyrillic letters, so that the endings occur."""
    cyrillic = F.translate(F.lower("text"), LATIN, CYRILLIC)
    tokens = keep(tok.letter_tokens(cyrillic), lambda t: F.length(t).between(*tok.ANALYZER_TOKEN_LENGTH))
    docs = documents(spark, d, "text").withColumn("t", tokens)
    return docs.withColumn("s", tok.stem_tokens(F.col("t"))).select("doc_id", joined(F.col("s")).alias("tokens"))


@query
def gap_aware_shingles(spark, d):
    stop = list(LEX.stop)
    gaps = blank_out(tok.split_tokens(F.col("text")), lambda t: ~t.isin(stop))
    return _tokens(spark, d, tok.gap_aware_shingles(gaps, 3))


@query
def analyzer_chain(spark, d):
    docs = news(spark, d).withColumn("t", terms())
    return docs.select("doc_id", F.size("t").alias("n"), joined(F.col("t")).alias("tokens"))


@query
def word_normalise(spark, d):
    return _tokens(spark, d, tok.normalised_words(F.col("text"), LEX.word_count_stop))


@query
def bag_of_words(spark, d):
    docs = documents(spark, d, "text")
    return corpus.bag_of_words(docs, tok.split_tokens(F.col("text")), "doc_id")


# ---- credibility features --------------------------------------------------------------


@query
def credibility_features(spark, d):
    return features.credibility_features(news(spark, d))


@query
def credibility_features_extra(spark, d):
    return features.credibility_features(news(spark, d), extras=True)


@query
def substring_counts(spark, d):
    text = F.col("text")
    needles = {
        "exclamations": "!", "quotes": '"', "open_quotes": "„", "close_quotes": "“",
        "links": "http", "hashes": "#", "apostrophes": "'", "questions": "?",
    }
    return documents(spark, d, "text").select(
        "doc_id", *[cred.substring_count(text, n).alias(name) for name, n in needles.items()]
    )


@query
def sentiment_scores(spark, d):
    """Word scores from a scored list that grows with the data: 1 or -0.5 by first mark."""
    scores = stored(lexicon_dedup(spark, d)).select(
        "word", F.when(F.col("score") > 0, 1.0).otherwise(-0.5).alias("score")
    )
    words = F.transform(tok.letter_tokens(F.col("text")), F.lower)
    bag = corpus.bag_of_words(documents(spark, d, "text"), words, "doc_id")
    return corpus.score_words(bag, scores)


# ---- corpus statistics -----------------------------------------------------------------


def normalised_words(column: str = "text"):
    return tok.normalised_words(F.col(column), LEX.word_count_stop)


@query
def corpus_word_count(spark, d):
    return corpus.word_count(documents(spark, d, "text"), normalised_words())


@query
def top_word(spark, d):
    return corpus.top_words(corpus_word_count(spark, d), 1)


@query
def topk_words(spark, d):
    return corpus.top_words(corpus_word_count(spark, d), 50)


@query
def class_word_count(spark, d):
    return corpus.class_word_count(news(spark, d), terms())


@query
def class_count_outer_join(spark, d):
    counts = stored(corpus.class_word_count(news(spark, d), terms()).filter(F.col("word") != ""))
    return corpus.join_class_counts(*[counts.filter(F.col("label") == c) for c in (0.0, 1.0)])


@query
def vocabulary_index(spark, d):
    counts = corpus.class_counts(news(spark, d), terms())
    return corpus.vocabulary(counts).select("word", "cnt", "idx")


@query
def vocab_stats(spark, d):
    counts = corpus.class_counts(news(spark, d), terms()).filter(F.col("cnt") > corpus.MIN_COUNT)
    out = corpus.vocabulary_stats(counts)
    return out.withColumns({"mean": F.round("mean", 6), "stdev": F.round("stdev", 6)})


@query
def tfidf_weights(spark, d):
    n = table(spark, d, "labels").select(F.count("*")).scalar()
    bag = news_bag(spark, d)
    vocab = corpus.vocabulary(corpus.bag_class_counts(bag))
    weights = corpus.tfidf(bag, vocab, n, "doc_id")
    return weights.withColumn("weight", F.round("weight", 6))


@query
def idf_alt(spark, d):
    n = table(spark, d, "labels").select(F.count("*")).scalar()
    counts = corpus.class_counts(news(spark, d), terms()).filter(F.col("cnt") > corpus.MIN_COUNT)
    return counts.select("word", "cnt", F.round(corpus.idf_plain(n, F.col("cnt")), 6).alias("idf"))


@query
def ml_idf(spark, d):
    out = corpus.document_idf(documents(spark, d, "text"), tok.split_tokens(F.col("text")))
    return out.withColumn("idf", F.round("idf", 6))


@query
def similar_news(spark, d):
    out = corpus.class_similarity(news(spark, d), normalised_words("content"))
    return out.select(
        "doc_id", F.round("to_unreliable", 6).alias("to_unreliable"), F.round("to_credible", 6).alias("to_credible")
    )


@query
def similar_pairs(spark, d):
    """Unreliable and credible articles of similar wording, copies as one; every article's class is in ``article_classes``."""
    return pairs.similar_articles(news(spark, d), normalised_words("content"), SIMILAR_ARTICLES)


@query
def article_classes(spark, d):
    return pairs.class_members(news(spark, d), normalised_words("content"), "doc_id", "label")


# ---- vectors ---------------------------------------------------------------------------


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return embedding.as_double(readers.spread(table(spark, d, "embeddings"), "vec_id"))


@query
def l2_normalise(spark, d):
    cells = embedding.normalised(vectors(spark, d)).select(
        "vec_id", F.posexplode("embedding").alias("pos", "value")
    )
    return cells.withColumn("value", F.round("value", 6))


@query
def vector_sum_by_label(spark, d):
    return embedding.sum_by_label(vectors(spark, d)).withColumn("total", F.round("total", 6))


@query
def cosine_similarity(spark, d):
    out = embedding.similarity_to_label(vectors(spark, d))
    return out.select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


@query
def cosine_topk(spark, d):
    return embedding.most_similar(vectors(spark, d), 5).withColumn("cosine", F.round("cosine", 6))


def asked_vectors():
    return F.col("vec_id") % 20 == 0


@query
def nearest_vectors(spark, d):
    """The five vectors nearest to each vector with an id divisible by 20, among all."""
    return neighbours.nearest(table(spark, d, "embeddings"), asked_vectors(), 5)


@query
def nearest_vectors_index(spark, d):
    """The same from an index of random hyperplanes; about 97 of 100 are found, with exact cosines."""
    return neighbours.nearest_by_index(table(spark, d, "embeddings"), asked_vectors(), 5)


@query
def hashing_tf(spark, d):
    """Documents and occurrences of every hash bucket over the bigrams."""
    kept = tok.drop_stop_words(tok.split_tokens(F.col("text")), LEX.stop)
    docs = documents(spark, d, "text").withColumn("k", kept).select(tok.ngrams(F.col("k"), 2).alias("ngrams"))
    hashed = HashingTF(inputCol="ngrams", outputCol="tf", numFeatures=1 << 18).transform(docs)
    cells = hashed.select(F.unwrap_udt("tf").alias("v")).select(F.inline(F.arrays_zip("v.indices", "v.values")))
    return cells.groupBy(F.col("indices").alias("bucket")).agg(F.count("*").alias("docs"), F.sum("values").alias("total"))


def corpus_tokens(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d, "text").select("doc_id", tok.split_tokens(F.col("text")).alias("tokens"))


def corpus_vectors(spark: SparkSession, d: str):
    """Word vectors learnt from all documents, with the standard settings: fitted once for all queries that use them."""

    def fit():
        kept = stored(corpus_tokens(spark, d))
        return kept, models.train_word_vectors(kept)

    return made_once(spark, ("corpus_vectors", d, table_state(table(spark, d, "documents"))), fit)


@query
def word2vec_docs(spark, d):
    kept, model = corpus_vectors(spark, d)
    return models.mean_vectors(model, kept, "doc_id")


@query
def w2v_synonyms(spark, d):
    _, model = corpus_vectors(spark, d)
    return model.findSynonyms("the", 10)


@query
def w2v_nearest_words(spark, d):
    """The five nearest words of every tenth word by a hash, all at once."""
    _, model = corpus_vectors(spark, d)
    return models.nearest_words(models.word_table(model), F.pmod(F.xxhash64("word"), F.lit(10)) == 0, 5)


@query
def word2vec_saved(spark, d):
    """The word vectors' table from a model that was saved and loaded again."""
    _, model = corpus_vectors(spark, d)
    path = new_path(spark)
    writers.save_model(model, path)
    return models.word_table(Word2VecModel.load(path))


@query
def cooccurrence_counts(spark, d):
    """Pairs of words up to five tokens apart, over the whole corpus."""
    return cooccurrence.cooccurrences(documents(spark, d, "text"), tok.split_tokens(F.col("text")))


@query
def cooccurrence_docs(spark, d):
    """Mean word vectors of all documents, from the factorised co-occurrences: no vocabulary on the driver."""
    docs, tokens = documents(spark, d, "text"), tok.split_tokens(F.col("text"))
    weights = cooccurrence.positive_information(cooccurrence.cooccurrences(docs, tokens))
    return cooccurrence.mean_word_vectors(docs, tokens, cooccurrence.factorise(weights, size=50).words, "doc_id")


@query
def word2vec_train_set(spark, d):
    """Word vectors with the library's own settings, learnt from the training set and given to its documents."""
    train = dataset.one_set(all_sets(spark, d), "train")
    kept = stored(train.select("doc_id", tok.split_tokens(F.col("content")).alias("tokens")))
    return models.mean_vectors(models.train_word_vectors(kept, standard=False), kept, "doc_id")


# ---- models ----------------------------------------------------------------------------


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """All sets with ``tokens`` and the vector of the ten ratios."""
    rows = all_sets(spark, d)
    rows = rows.withColumn("tokens", tok.split_tokens(F.col("content")))
    return features.CredibilityFeatures().transform(rows).drop("content")


def tfidf_rows(spark: SparkSession, d: str, least: float | None = None) -> DataFrame:
    """Marked documents as TF-IDF vectors, with their part; words, counts and the number of documents are those of part 0.

    A word with more occurrences than three times the documents weighs less than 0; ``least`` lifts such weights.
    """
    part = dataset.split_number(F.col("doc_id"), dataset.UNRELIABLE_WEIGHTS)
    bag = news_bag(spark, d)
    vocab = corpus.vocabulary(corpus.bag_class_counts(bag.filter(part == 0)))
    marks = news(spark, d).select("doc_id", "label", part.alias("part"))
    n = marks.filter("part = 0").select(F.count("*")).scalar()
    weights = corpus.tfidf(bag, vocab, n, "doc_id")
    if least is not None:
        weights = weights.withColumn("weight", F.greatest("weight", F.lit(least)))
    return corpus.tfidf_vectors(weights, marks, F.lit(vocab.count()))


def _model_scores(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = stored(tfidf_rows(spark, d, 0.0 if name == "nb" else None))  # naive Bayes takes no weight below 0
    model = models.fit_persisted(models.estimator(name), rows.filter("part = 0"))
    return models.score(model, rows.filter("part = 1"), "doc_id")


@query
def model_lr(spark, d):
    return _model_scores(spark, d, "lg")


@query
def model_nb(spark, d):
    return _model_scores(spark, d, "nb")


@query
def model_svm(spark, d):
    return _model_scores(spark, d, "svm")


def hinge_rows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """Stored TF-IDF vectors with their part, and the length of the vectors."""
    rows = stored(tfidf_rows(spark, d))
    size = rows.select(F.coalesce(F.max(F.unwrap_udt("features")["size"]), F.lit(0))).first()[0]
    return rows, size


@query
def model_svm_l1(spark, d):
    """Scores of the L1-penalised hinge classifier on the held-back part."""
    rows, size = hinge_rows(spark, d)
    return hinge.fit_hinge_l1(rows.filter("part = 0"), size).score(rows.filter("part = 1"), "doc_id")


@query
def svm_l1_weights(spark, d):
    """Weights that are not 0 after three steps, by place in the vocabulary."""
    rows, size = hinge_rows(spark, d)
    model = hinge.fit_hinge_l1(rows.filter("part = 0"), size, steps=3, reg=0.02, tolerance=0.0)
    at = model.weights.nonzero()[0]
    weights = [(int(i), float(model.weights[i])) for i in at]
    return spark.createDataFrame(weights, "idx long, weight double").withColumn("weight", F.round("weight", 6))


@query
def nb_theta(spark, d):
    counts = corpus.class_counts(news(spark, d), terms()).filter(F.col("cnt") > corpus.MIN_COUNT)
    out = corpus.naive_bayes_theta(stored(counts))
    return out.withColumn("theta", F.round("theta", 6))


@query
def credibility_model(spark, d):
    """Word vectors from the corpus and the ten ratios into the tuned pipeline, scored on all sets."""
    _, word_vectors = corpus_vectors(spark, d)
    rows = stored(feature_rows(spark, d))
    pipeline = models.credibility_pipeline(word_vectors)
    best, _ = models.tune_by_split(pipeline, models.parameter_grid(pipeline), dataset.one_set(rows, "train"))
    return models.score(best, rows, "dataset", "doc_id")


@query
def model_mlp(spark, d):
    """The perceptron over the ten ratios and the word vector."""
    _, word_vectors = corpus_vectors(spark, d)
    rows = stored(models.assembled(word_vectors, feature_rows(spark, d)))
    inputs = len(cred.FEATURES) + word_vectors.getVectorSize()
    model = models.fit_persisted(models.perceptron(inputs), dataset.one_set(rows, "train"))
    return models.score(model, dataset.one_set(rows, "test"), "doc_id")


def _average_areas(spark: SparkSession, metrics: list[float]) -> DataFrame:
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(metrics)], "grid_point int, area_under_roc double")


def tuning_rows(spark: SparkSession, d: str):
    """The pipeline with its word vectors, and the training set."""
    _, word_vectors = corpus_vectors(spark, d)
    return models.credibility_pipeline(word_vectors), stored(dataset.one_set(feature_rows(spark, d), "train"))


@query
def tune_tvs(spark, d):
    pipeline, rows = tuning_rows(spark, d)
    _, metrics = models.tune_by_split(pipeline, models.parameter_grid(pipeline, (10, 20)), rows)
    return _average_areas(spark, metrics)


@query
def tune_cv(spark, d):
    pipeline, rows = tuning_rows(spark, d)
    tuned = models.tune_by_folds(pipeline, models.parameter_grid(pipeline), rows)
    return _average_areas(spark, tuned.avgMetrics)


@query
def tune_stages(spark, d):
    """Vector size, n, number of hashed features and elastic net as axes of one grid; equal beginnings are fitted once."""
    train = dataset.one_set(all_sets(spark, d), "train")
    rows = train.select("doc_id", "label", tok.split_tokens(F.col("content")).alias("tokens"))
    stages, axes = models.text_tuning_stages(models.fit_partitions(train))
    grid, points = models.stage_grid(**axes)
    areas = models.tune_stages(stages, grid, rows).areas
    shown = [(i, *point.values(), float(area)) for i, (point, area) in enumerate(zip(points, areas))]
    schema = "grid_point int, vector_size int, min_count int, n int, num_features int, elastic_net double, area_under_roc double"
    return spark.createDataFrame(shown, schema)


@query
def fold_assignment(spark, d):
    return table(spark, d, "documents", "doc_id").select(
        "doc_id", dataset.fold_number(F.col("doc_id"), models.FOLDS).alias("fold")
    )


# ---- evaluation ------------------------------------------------------------------------


def scored_news(spark: SparkSession, d: str) -> DataFrame:
    return scored(news(spark, d)).select("doc_id", "label", "score", "prediction")


@query
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(scored_news(spark, d))


@query
def per_label_metrics(spark, d):
    return evaluation.per_label_metrics(evaluation.confusion_counts(scored_news(spark, d)))


@query
def binary_metrics(spark, d):
    return evaluation.binary_metrics(evaluation.confusion_counts(scored_news(spark, d)))


@query
def scored_write_counts(spark, d):
    """The confusion cells and the rows given to class 0, counted by the write of the scored rows."""
    return _counted(spark, evaluation.write_scored(scored_news(writers.own_session(spark), d), new_path(spark)))


@query
def eval_by_dataset(spark, d):
    counts = evaluation.confusion_counts(scored(all_sets(spark, d)), "dataset")
    return evaluation.binary_metrics(counts, "dataset")


@query
def eval_report(spark, d):
    return evaluation.evaluation_report(scored(all_sets(spark, d)))


@query
def threshold_metrics(spark, d):
    return evaluation.threshold_metrics(evaluation.score_curve(scored_news(spark, d)))


@query
def roc_curve(spark, d):
    return evaluation.roc_curve(evaluation.score_curve(scored_news(spark, d)))


@query
def pr_curve(spark, d):
    return evaluation.pr_curve(evaluation.score_curve(scored_news(spark, d)))


@query
def auc_metrics(spark, d):
    areas = evaluation.curve_areas(evaluation.score_curve(scored_news(spark, d)))
    return areas.select(*[F.round(c, 6).alias(c) for c in areas.columns])

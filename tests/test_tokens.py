from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from truthmill.functions import tokens as tok
from truthmill.functions.arrays import blank_out, run_lengths
from truthmill.lexicon import BULGARIAN, Lexicon, lexicon_for


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "c string").select(expression(F.col("c")).alias("r")).first().r


def test_split_tokens(spark):
    assert one(spark, "Една, две!  Three;four's \"x\"", tok.split_tokens) == ["една", "две", "three", "four", "s", "x"]
    assert one(spark, " ,.! ", tok.split_tokens) == []


def test_letter_tokens_keep_case_and_cut_at_255(spark):
    assert one(spark, "Но24 по-добре", tok.letter_tokens) == ["Но", "по", "добре"]
    assert [len(t) for t in one(spark, "х" * 600, tok.letter_tokens)] == [255, 255, 90]


def test_word_tokens_join_inside_letters_and_digits_only(spark):
    text = "др.Дулитъл, пада. 12345,2 и 1.5 a,b ще-не т.н. x:y 3:4"
    assert one(spark, text, tok.word_tokens) == [
        "др.Дулитъл", "пада", "12345,2", "и", "1.5", "a", "b", "ще", "не", "т.н", "x:y", "3", "4",
    ]
    assert one(spark, "a " + "b" * 256 + " c", tok.word_tokens) == ["a", None, "c"]


@pytest.mark.parametrize(
    "word, number",
    [("12345", True), ("12345.1", True), ("12345,2", True), ("0x1F", True), ("1e5", True), ("5L", True),
     ("1.5f", True), ("-3", True), ("+3", False), ("Но24", False), ("1.5L", False), ("abc", False), ("", False)],
)
def test_is_number(spark, word, number):
    assert one(spark, word, tok.is_number) is number


def test_bigrams_bridge_removed_words_but_shingles_do_not(spark):
    stop = ["на"]
    bridged = lambda c: tok.ngrams(tok.drop_stop_words(tok.split_tokens(c), stop), 2)
    gaps = lambda c: tok.gap_aware_shingles(blank_out(tok.split_tokens(c), lambda t: ~t.isin(stop)), 3)
    text = "тест на модел добър"
    assert one(spark, text, bridged) == ["тест модел", "модел добър"]
    assert one(spark, text, gaps) == ["тест", "модел", "модел добър", "добър"]
    assert one(spark, "а_б в", gaps) == ["в"]
    assert one(spark, "сам", bridged) == []


@pytest.mark.parametrize(
    "word, stem",
    [("книгата", "книг"), ("градове", "град"), ("училища", "учил"), ("ученици", "ученик"), ("столът", "стол"),
     ("героят", "гер"), ("мъжът", "мъжът"), ("вълци", "вълц"), ("бял", "бял"), ("ята", "ята"), ("приятелите", "приятял"), ("добрият", "добр"), ("стая", "ст")],
)
def test_stem(spark, word, stem):
    assert one(spark, word, tok.stem) == stem


def test_scratch_sentence(spark):
    text = (
        "Правя тест на класификатор и после др.Дулитъл, пада.br2n ще се оправя с данните! "
        "които,са много зле. Но това е по-добре. Но24"
    )
    lexicon = BULGARIAN.with_stop(["на", "и", "после", "ще", "се", "с", "които", "са", "много", "но", "това", "е", "по", "добре"])
    terms = one(spark, text, lambda c: tok.analyzer_terms(c, lexicon))
    assert "тест" in terms and "прав тест" in terms
    assert "тест класификатор" not in terms  # a stop word stood between them
    assert not any("br2n" in t or "_" in t for t in terms)


def test_normalised_words_drop_every_other_of_consecutive_numbers(spark):
    words = lambda c: tok.normalised_words(c, BULGARIAN.word_count_stop)
    assert one(spark, "цена 10 20 30 лева", words) == ["цена", "20", "лева"]
    assert one(spark, "Край br2n (зелен) - ред: \"х\" и ѝ", words) == ["край", "зелен", "ред", "х"]


def test_stop_list_keeps_pronouns_for_the_features():
    assert "аз" in BULGARIAN.stop and "аз" not in BULGARIAN.stop_keeping_pronouns
    assert "на" in BULGARIAN.stop_keeping_pronouns
    assert lexicon_for("bg", "en").stop[: len(BULGARIAN.stop)] == BULGARIAN.stop
    assert {c for c, _, _ in BULGARIAN.rows()} >= {"stop", "first", "months", "positive"}


def test_empty_lexicon_keeps_all_tokens(spark):
    assert one(spark, "A b", lambda c: tok.feature_tokens(c, Lexicon())) == ["A", "b"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["а", "б", "w", "zz", ""]), max_size=12), min_size=1, max_size=6))
def test_run_lengths_counts_like_a_counter(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "i int, t array<string>")
    out = {r.i: {x.word: x.tf for x in r.b or []} for r in df.select("i", run_lengths(F.col("t")).alias("b")).collect()}
    assert out == {i: dict(Counter(d)) for i, d in enumerate(docs)}

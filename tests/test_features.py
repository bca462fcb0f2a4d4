import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from truthmill.functions.credibility import FEATURES, substring_count
from truthmill.lexicon import BULGARIAN, MULTILINGUAL
from truthmill.operators import features

TEXT = "Аз и ТЕ видяхме Лош филм през май! Ние не сме сами!! \"Край\""


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT), (2, ""), (3, None), (4, "ABC def Éa")]
    return spark.createDataFrame(rows, "doc_id long, content string")


def test_bulgarian_ratios(spark, docs):
    row = features.credibility_features(docs, lexicon=BULGARIAN).filter("doc_id = 1").first()
    # kept: Аз ТЕ видяхме филм Ние сами Край (the others are stop words and no pronouns)
    n = 7.0
    assert row.negative_ratio == 0
    assert row.has_upper_ratio == 4 / n
    assert row.all_upper_ratio == 1 / n
    assert row.first_upper_ratio == 4 / n
    assert row.all_lower_ratio == 3 / n
    assert row.first_person_ratio == 2 / n
    assert row.second_person_ratio == 1 / n  # "те" is in three lists
    assert row.plural_pronoun_ratio == 2 / n
    assert row.exclamation_ratio == 3 / n
    assert row.quote_ratio == 2 / n


def test_extra_counters(docs):
    row = features.credibility_features(docs, lexicon=BULGARIAN, extras=True).filter("doc_id = 1").first()
    assert row.month_ratio == 0.0  # the month is a stop word too
    assert row.singular_pronoun_ratio == 2 / 7.0
    assert row.digit_ratio == 0.0


def test_stage_keeps_its_lexicon(spark, docs, tmp_path):
    own = BULGARIAN.with_stop(["филм"])
    stage = features.CredibilityFeatures(inputCol="content").setLexicon(own)
    stage.save(str(tmp_path / "stage"))
    again = features.CredibilityFeatures.load(str(tmp_path / "stage"))
    assert again.lexicon == own
    assert again.transform(docs).select("commonfeatures").collect() == stage.transform(docs).select("commonfeatures").collect()


def test_empty_and_null_texts_give_zeros(docs):
    rows = features.credibility_features(docs).filter("doc_id in (2, 3)").collect()
    assert len(rows) == 2
    assert all(row[f] == 0.0 for row in rows for f in FEATURES)


def test_accented_capitals_count_as_neither_case(docs):
    row = features.credibility_features(docs).filter("doc_id = 4").first()
    assert (row.has_upper_ratio, row.all_lower_ratio) == (1 / 3.0, 1 / 3.0)


def test_ratio_bounds_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumnRenamed("text", "content")
    out = features.credibility_features(docs.select("doc_id", "content"))
    assert out.filter("all_upper_ratio > first_upper_ratio or first_upper_ratio > has_upper_ratio").count() == 0
    for name in FEATURES[:8]:
        assert out.filter(f"{name} < 0 or {name} > 1").count() == 0


def test_substring_count_does_not_overlap(spark):
    df = spark.createDataFrame([("aaaa http http",)], "c string")
    assert df.select(substring_count(F.col("c"), "aa")).first()[0] == 2
    assert df.select(substring_count(F.col("c"), "http")).first()[0] == 2


def test_transformer_matches_columns_and_survives_saving(spark, docs, tmp_path):
    stage = features.CredibilityFeatures(inputCol="content", outputCol="f")
    assert stage.transformSchema(docs.schema).fieldNames() == ["doc_id", "content", "f"]
    stage.write().overwrite().save(str(tmp_path / "stage"))
    loaded = features.CredibilityFeatures.load(str(tmp_path / "stage"))
    assert loaded.getOutputCol() == "f"
    vectors = loaded.transform(docs).select("doc_id", vector_to_array("f").alias("v")).collect()
    expected = {r.doc_id: [r[f] for f in FEATURES] for r in features.credibility_features(docs, lexicon=MULTILINGUAL).collect()}
    assert {r.doc_id: r.v for r in vectors} == expected


def test_text_columns(docs):
    out = features.text_columns(docs.filter("doc_id = 1"), lexicon=BULGARIAN)
    assert out.columns == ["doc_id", "content", "tokens", "commonfeatures", "filtered", "ngrams"]
    row = out.first()
    assert "аз" not in row.filtered and row.ngrams[0].count(" ") == 1

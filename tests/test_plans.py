"""What the physical plans must and must not hold."""

import pytest

from truthmill.operators import dataset
from truthmill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["regex_tokens", "bag_of_words", "substring_counts", "analyzer_chain"])
def test_document_work_shuffles_no_rows_but_the_small_input_spread(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") <= 1


def test_scan_reads_only_the_needed_columns(spark):
    text = plan(QUERIES["token_length"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    text = plan(QUERIES["without_source"](spark, SF))
    assert "PushedFilters: [IsNotNull(source), Not(EqualTo(source,src0))]" in text
    assert "text" not in text.split("ReadSchema")[1]


def test_top_k_is_bounded_per_task(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["latest_k"](spark, SF))
    small = dataset.latest_k(spark.read.parquet(f"{SF}/events.parquet"), 50, "ts", "event_id")
    assert "GreaterThanOrEqual(ts," in plan(small)  # the cut reaches the scan
    assert "TakeOrderedAndProject" in plan(QUERIES["top_word"](spark, SF))
    assert "WindowGroupLimit" in plan(QUERIES["cosine_topk"](spark, SF))


def test_word_counts_combine_before_the_shuffle(spark):
    text = plan(QUERIES["corpus_word_count"](spark, SF))
    assert "partial_count(1)" in text

"""A training corpus from documents: rules, lines, near copies, benchmark passages, packed sequences.

Each stage takes (spark, docs, sf_dir); its result is written and read again as the next
one's docs. All but the last return the columns of ``documents``. Rows are told apart by
``doc_id`` and a hash of the text: rows that repeat both are one document read twice, of which
near_dedup keeps one; in the other stages they share its fate. Other columns of any name are carried through. An empty table gives an empty
table. A null text counts as empty, and so fails the quality rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from truthmill.llm import linedups, nearcopies, quality, queries, winnow
from truthmill.operators.shared import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _mark():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose document is not among ``gone`` (_key, _gone_mark)."""
    same = docs["doc_id"].eqNullSafe(gone["_key"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_gone_mark"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    """The text and other columns under one key that tells rows apart."""
    return docs.select(F.struct(F.col("doc_id").alias("id"), _mark().alias("mark"), *columns).alias("_id"), "text", *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows are judged with their own language and source."""
    judged = quality.quality_rules(_named(docs, "lang", "source"), key="_id").filter(~F.col("kept"))
    gone = stored(judged.select("_id.*").withColumnsRenamed({"lang": "_lang", "source": "_source"}).distinct())
    same = (
        docs["doc_id"].eqNullSafe(gone["id"])
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["mark"])
        & docs["lang"].eqNullSafe(gone["_lang"])
        & docs["source"].eqNullSafe(gone["_source"])
    )
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines. A document that loses all its lines with a word is dropped: nothing new is left of it."""
    rows = linedups.with_kept_text(docs, long_words=linedups.LONG_WORDS)
    rows = rows.filter(F.col("_gone").isNull() | linedups.has_word(F.col("_kept_text")))
    row = F.col("_row")
    new = {"text": F.when(F.col("_gone").isNull(), row["text"]).otherwise(F.col("_kept_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_gone").isNull(), row["n_chars"]).otherwise(F.length("_kept_text"))
    return rows.select(*[new.get(c, row.getField(c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, of equal ids that of the smallest text hash. Null ids come last."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("number"), F.struct("*").alias("row")))
    found = nearcopies.near_copies(rows.select("number", F.col("row.text").alias("text")), "number")
    id_ = F.col("row.doc_id")
    named = rows.select("number", F.struct(id_.isNull(), id_, F.xxhash64("row.text"), "number").alias("order"))
    least = named.join(found.select("number", "component_id"), "number").groupBy("component_id").agg(F.min("order").alias("first"))
    kept = stored(least.select("first.number"))
    return rows.join(kept, "number", "left_semi").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage."""
    found = winnow.benchmark_overlap(_named(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="_id")
    gone = found.filter(F.size("hits") > 0).select(F.col("_id.id").alias("_key"), F.col("_id.mark").alias("_gone_mark"))
    return _without(docs, stored(gone.distinct()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in the packed sequences."""
    return queries.packed_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Near copies and best-fit packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

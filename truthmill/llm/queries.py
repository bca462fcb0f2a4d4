"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from truthmill.functions.arrays import let
from truthmill.llm import (
    byte_pairs,
    hard_negatives,
    language_model,
    licenses,
    linedups,
    nearcopies,
    oracles,
    packing,
    periodic,
    quality,
    shards,
    substrings,
    suffixes,
    winnow,
)
from truthmill.llm.repeats import hash_of


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def op1_interpolated_model(spark: SparkSession, folder: str) -> DataFrame:
    return language_model.score_texts(_documents(spark, folder))


def op2_histogram_shards(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _documents(spark, folder).select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    return shards.shard(rows, "size", "text_hash").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_winnow_overlap(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.benchmark_overlap(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, folder)).drop("blocks")


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffixes.drop_repeated_strings(_documents(spark, folder))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", hash_of("kept").alias("kept_sha256"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The digest of best-fit packing, as the pipeline's last stage returns it too."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(_documents(spark, folder))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = linedups.drop_repeated_lines(_documents(spark, folder), long_words=linedups.LONG_WORDS)
    return cut.select("doc_id", "n_lines", "n_word_lines", "n_removed", hash_of("kept_text").alias("kept_sha256"))


def op8_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return nearcopies.near_copies(_documents(spark, folder))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, folder))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.drop_repeated_passages(_documents(spark, folder))
    return cut.select("doc_id", "n_words", "n_removed", hash_of("kept_text").alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the vectors with an id divisible by 100; every seventh id has the next label."""
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_pairs.encode(_documents(spark, folder), vocabulary, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return byte_pairs.decode(encoded, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256")
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): about a tenth of the texts go on with a period from some word, both by a hash of the id. A null id keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")

    def rewritten(words):
        n = F.size(words).cast("long")
        a = g % n
        p = F.expr("1L") + F.call_function("div", n - a, F.lit(3) + g % 8)
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    text = F.when(F.col("h") % 10 == 0, let(words, rewritten)).otherwise(F.col("text"))
    return docs.select("doc_id", "text", h.alias("h")).select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of the texts with planted periods, and the run of the greatest length over period."""
    found = periodic.periodic_runs(with_planted_periods(_documents(spark, folder)))
    by_exponent = F.array_sort(
        "runs", lambda a, b: F.signum(b["length"] * a["period"] - a["length"] * b["period"]).cast("int")
    )  # equal ones keep their order: by start, then period
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = F.get(by_exponent, F.lit(0))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "kept_text").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interpolated_model": op1_interpolated_model,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_winnow_overlap": op3_winnow_overlap,
    "op4_license_scan": op4_license_scan,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_near_copies": op8_near_copies,
    "op9_quality_rules": op9_quality_rules,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_byte_pairs": op12_byte_pairs,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES: dict[str, str] = {
    "op3_winnow_overlap": oracles.benchmark_overlap(),
    "op4_license_scan": oracles.license_scan(),
    "op7_line_dedup": oracles.line_dedup(),
    "op9_quality_rules": oracles.quality_rules(),
    "op11_hard_negatives": oracles.hard_negatives(),
}

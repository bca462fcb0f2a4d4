"""Sources: news records, page tables, word lists and JSON lines to repair."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from truthmill.operators.shared import stored


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Put a small input on all cores; a large one already has more splits and is left alone.

    The keys should be unique ones, so that no partition gets a hot group.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_news_json(
    spark: SparkSession, path: str, schema: StructType | str | None = None, view: str | None = None
) -> DataFrame:
    """JSON-lines news; give the schema to save the inference pass over the data."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.json(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page store rows: key, address and markup, and no other column of the table."""
    return read_table(spark, path, "page_id", "url", "html")


def parse_scored_words(lines: DataFrame, on_bad_number: str = "empty") -> DataFrame:
    """``line`` of ``word,score`` to one (word, score) row per word, the lowest ``at`` winning.

    A line whose score is no number empties the whole list, as an unreadable file does;
    ``on_bad_number="skip"`` drops only that line.
    """
    parts = F.split("line", ",")
    parsed = lines.select(
        F.get(parts, F.lit(0)).alias("word"),
        F.get(parts, F.lit(1)).try_cast("double").alias("score"),
        "at",
    )
    if on_bad_number == "skip":
        parsed = parsed.filter(F.col("score").isNotNull())
    words = stored(
        parsed.groupBy("word").agg(
            F.min_by("score", "at").alias("score"), F.count_if(F.col("score").isNull()).alias("_bad")
        )
    )
    if on_bad_number == "empty":
        bad = words.agg(F.coalesce(F.sum("_bad"), F.lit(0))).scalar()
        words = words.filter(bad == 0)
    return words.select("word", "score")


def read_scored_words(spark: SparkSession, path: str, on_bad_number: str = "empty") -> DataFrame:
    """Sentiment list file; a missing file gives an empty list."""
    try:
        lines = spark.read.text(path).select(
            F.col("value").alias("line"),
            F.monotonically_increasing_id().alias("at"),
        )
    except AnalysisException:
        return spark.createDataFrame([], "word string, score double")
    return parse_scored_words(lines, on_bad_number)


def read_word_list(spark: SparkSession, path: str, limit: int = 100_000) -> list[str]:
    """One word per line, for use as a literal set of at most ``limit`` words.

    Refuses a longer list: read it as a table and drop its words by an anti-join.
    """
    rows = spark.read.text(path).select(F.trim("value").alias("w")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"word list {path} holds more than {limit} words; join it as a table")
    return list(dict.fromkeys(r.w for r in rows if r.w))


def is_json_object(line: Column) -> Column:
    """The line parses and is an object; other JSON values are no records."""
    return F.try_parse_json(line).isNotNull() & F.ltrim(line).startswith("{")


def repair_json_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Every line with a ``parses`` flag; keep the true ones, count the false ones."""
    return lines.withColumn("parses", F.coalesce(is_json_object(F.col(column)), F.lit(False)))


def route_json_lines(lines: DataFrame, path: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) lines: one read, one write that puts good and bad lines into folders of their own, read back."""
    flagged = repair_json_lines(lines, column).select(F.col(column).alias("value"), "parses").filter("value is not null")
    flagged.write.partitionBy("parses").text(path)
    written = lines.sparkSession.read.schema("value string, parses boolean").text(path)
    return written.filter("parses").select("value"), written.filter(~F.col("parses")).select("value")

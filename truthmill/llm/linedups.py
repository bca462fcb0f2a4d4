"""Deletion of runs of lines that stand earlier too, by winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from truthmill.operators.shared import stored

#: Lines in the shortest run that counts: each such run holds a fingerprint of two lines.
RUN = 3
#: The query and the pipeline take a line, or two neighbouring ones, of so many words as a run too.
LONG_WORDS = 50
BLANKS = " \t\n\x0b\f\r"
_BLANK = r"[\x20\x09-\x0D]+"


def repeated_line_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """(_key, _mark, _gone) of the texts with runs of lines that stand earlier; _gone are line numbers.

    Lines without a word are passed over, others compare without blanks at their ends. Of
    the two pairs of neighbouring lines in every run of three, the one with the lesser
    hash is the fingerprint, so each shared run shares it. Fingerprints that stand in two places
    are joined back and extended to all runs of three that they stand for; of equal
    runs (two 64-bit hashes) the first in the order of key, text hash and line stays, and
    all lines of the later ones go. Longer repeated runs go as the union of their runs of three.

    With ``long_words``, a single line or a pair of neighbouring lines of so many words is a
    run as well and its own fingerprint, so repeated paragraphs of one or two lines go too.
    """
    lines = F.filter(
        F.transform(F.split("_text", "\n"), lambda x, i: F.struct(F.btrim(x, F.lit(BLANKS)).alias("line"), i.alias("at"))),
        lambda x: x["line"] != "",
    )
    texts = keyed(docs, key, text).select("_key", "_mark", lines.alias("lines"))
    rows = texts.filter(F.size("lines") >= RUN)
    rows = rows.withColumn("pairs", F.transform("lines", lambda x, i: F.xxhash64(x["line"], F.get("lines", i + 1)["line"])))

    def whole(line: list[Column]) -> list[Column]:
        return [
            F.xxhash64(*[x["line"] for x in line]).alias("w1"),
            F.xxhash64(F.lit(1), *[x["line"] for x in reversed(line)]).alias("w2"),
            F.array(*[x["at"] for x in line]).alias("at"),
        ]

    def run(i: Column) -> Column:
        a, b = F.get("pairs", i), F.get("pairs", i + 1)
        line = [F.get("lines", i + j) for j in range(RUN)]
        return F.struct(F.least(a, b).alias("print"), (i + (b < a).cast("int")).alias("pair"), *whole(line))

    runs = rows.select("_key", "_mark", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - RUN), run)).alias("run"))
    runs = stored(runs.select("_key", "_mark", "run.*"))
    prints = runs.select("_key", "_mark", "print", "pair").distinct().groupBy("print").count().filter("count > 1")
    near = runs.join(stored(prints.select("print")), "print")
    place = F.struct(F.col("_key").isNotNull(), "_key", "_mark", "at")
    near = near.select("_key", "_mark", "w1", "w2", "at")
    if long_words is not None:
        near = near.unionByName(_long_lines(texts, long_words, whole))
    near = stored(near)
    firsts = near.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    later = near.join(stored(firsts.drop("n")), ["w1", "w2"]).filter(place > F.col("first"))
    return later.groupBy("_key", "_mark").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("_gone"))


def _long_lines(texts: DataFrame, long_words: int, whole: Callable[[list[Column]], list[Column]]) -> DataFrame:
    """Single lines and pairs of neighbouring lines with at least so many words."""

    def of(n: int) -> Column:
        line = lambda i: [F.get("lines", i + j) for j in range(n)]
        words = lambda i: sum((F.size(F.split(x["line"], _BLANK)) for x in line(i)), F.lit(0))
        starts = F.filter(F.sequence(F.lit(0), F.size("lines") - n), lambda i: words(i) >= long_words)
        none = F.array().cast("array<struct<w1:long,w2:long,at:array<int>>>")
        return F.when(F.size("lines") >= n, F.transform(starts, lambda i: F.struct(*whole(line(i))))).otherwise(none)

    return texts.select("_key", "_mark", F.explode(F.concat(of(1), of(2))).alias("run")).select("_key", "_mark", "run.*")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The whole row as one column, whatever its names; the key, the text (null as empty) and a hash of the text to tell rows of one key apart."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), value.alias("_text"), F.xxhash64(value).alias("_mark"))


def with_kept_text(docs: DataFrame, key: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """All rows as ``_row``, with ``_key``, ``_text``, ``_lines``, ``_gone`` (line numbers, null if none) and ``_kept_text``."""
    found = repeated_line_runs(docs, key, text, long_words).withColumnsRenamed({"_key": "_k", "_mark": "_m"})
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_mark") == F.col("_m"))
    rows = keyed(docs, key, text).join(found.hint("shuffle_hash"), same, "left").withColumn("_lines", F.split("_text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return rows.withColumn("_kept_text", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(rest))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """Each text without the lines of repeated runs of three or more lines, but for their first occurrence.

    With ``long_words``, repeated single lines and pairs of lines of so many words go as well.

    Returns key, n_lines (parted by ``\\n``; a null or empty text has one empty line), n_word_lines
    (those with a word), n_removed and kept_text, one row per input row. Runs are judged on the
    input, within and across texts. Rows of the same key and text are one document read twice
    and keep the same lines; a null key comes before all others. Other columns are not read.
    """
    rows = with_kept_text(docs.select(key, text), key, text, long_words)
    return rows.select(
        F.col("_key").alias(key),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_lines", has_word)).cast("long").alias("n_word_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.col("_kept_text").alias("kept_text"),
    )


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) != ""

"""Pairs of similar articles: an exact join of weighted word vectors by cosine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from truthmill.functions.arrays import run_lengths
from truthmill.operators.corpus import idf_smoothed
from truthmill.operators.shared import join_words, stored, stored_alone

#: Vectors of one side that a block holds, how many it holds at least where there are enough tasks, and products made at once.
BLOCK_ROWS, LEAST_BLOCK, CHUNK = 8_192, 512, 1 << 20
#: How often all vectors may be shuffled at once; blocks of left vectors that would need more wait for a later wave.
COPIES = 4
#: Cosines are compared after rounding, so equal vectors compare equal whatever the order of their sums.
DIGITS = 6
_SLACK = 1e-9


def article_classes(articles: DataFrame, terms: Column, key: str = "doc_id", *within: str) -> DataFrame:
    """(id, articles, bag, within): articles of the same bag of words as one class, named by its smallest key.

    Copies are counted here, so that a text that stands a thousand times is compared once. Articles without a word
    are in no class. ``bag`` holds (word, tf) by word.
    """
    rows = articles.select(key, *within, run_lengths(terms).alias("bag")).filter(F.size("bag") > 0)
    same = rows.groupBy(*within, F.sha2(F.to_json("bag"), 256).alias("_same"))
    return same.agg(F.min(key).alias("id"), F.count("*").alias("articles"), F.any_value("bag").alias("bag")).drop("_same")


def class_members(articles: DataFrame, terms: Column, key: str = "doc_id", *within: str) -> DataFrame:
    """(key, id, within): the class of every article that has a word."""
    rows = articles.select(key, *within, run_lengths(terms).alias("bag")).filter(F.size("bag") > 0)
    rows = rows.select(key, *within, F.sha2(F.to_json("bag"), 256).alias("_same"))
    named = {"_same": "_text", **{c: f"_of_{c}" for c in within}}
    least = rows.groupBy(*within, "_same").agg(F.min(key).alias("id")).withColumnsRenamed(named)
    on = F.col("_same") == F.col("_text")
    for c in within:
        on &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return rows.join(least, on).select(key, "id", *within)


def inverse_frequency_weights(classes: DataFrame, *within: str) -> DataFrame:
    """(id, within, word, df, weight) of classes: tf times ln((N + 1) / (df + 1)); words of all articles weigh nothing and are left out.

    Copies count in N and df.
    """
    n = classes.agg(F.sum("articles")).scalar()
    words = classes.select("id", "articles", *within, F.inline("bag"))
    df = stored(words.groupBy("word").agg(F.sum("articles").alias("df")))
    weight = F.col("tf") * idf_smoothed(n, F.col("df"))
    return join_words(words, df, "word").select("id", *within, "word", "df", weight.alias("weight")).filter(F.col("weight") > 0)


def _vectors(weights: DataFrame, threshold: float, side: str) -> tuple[DataFrame, DataFrame]:
    """(entries of the unit vectors, their prefix words) of one side, in one shuffle by id.

    Words go by their frequency, the rarest first. ``rest`` is the length of a unit vector from the word on. Two vectors share no
    word before their first common one, so their product is at most the product of what is left of both there: neither
    is below the threshold. Words with less left are no prefix words.
    """
    every, onward = Window.partitionBy("id"), Window.partitionBy("id").orderBy(F.desc("df"), F.desc("word"))
    square = F.col("weight") * F.col("weight")
    rows = weights.select("id", "word", "df", "weight", F.sum(square).over(every).alias("s"), F.sum(square).over(onward).alias("r"))
    rest = F.sqrt(F.col("r") / F.col("s")).alias(f"{side}_rest")
    rows = stored(rows.select(F.col("id").alias(side), "word", (F.col("weight") / F.sqrt("s")).alias("unit"), rest))
    return rows, rows.filter(F.col(f"{side}_rest") >= threshold - _SLACK).select("word", side, f"{side}_rest")


def _entries(vectors: pa.Table) -> tuple[np.ndarray, ...]:
    """(row, place, unit, rest) of all entries of the vectors."""
    row = np.repeat(np.arange(vectors.num_rows), pc.list_value_length(vectors["at"]).to_numpy())
    return row, *(pc.list_flatten(vectors[c]).to_numpy() for c in ("at", "unit", "rest"))


def _near(threshold: float) -> Callable:
    """The pairs of a block's left and right vectors that come near the threshold; only these leave the task.

    The right vectors are listed by word. A left vector adds up its products with the lists of its words, so a block costs
    what its vectors share and holds no pairs but those it lets out. One without a prefix word in common with the block is passed over.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row, place, unit, rest = _entries(left)
        its_row, its_place, its_unit, its_rest = _entries(right)
        order = np.argsort(its_place, kind="stable")
        words, begin, size = np.unique(its_place[order], return_index=True, return_counts=True)
        its_row, its_unit = its_row[order], its_unit[order]
        widest = np.maximum.reduceat(its_rest[order], begin) if len(begin) else its_rest
        at = np.minimum(np.searchsorted(words, place), max(len(words) - 1, 0))
        known = words[at] == place if len(words) else np.zeros(len(place), dtype=bool)
        row, unit, rest, at = row[known], unit[known], rest[known], at[known]
        asked = np.unique(row[rest * widest[at] >= threshold - _SLACK])
        ends = np.searchsorted(row, np.arange(left.num_rows + 1))
        found: list[tuple[np.ndarray, ...]] = []
        for i in asked:
            score = np.zeros(right.num_rows)
            lists = at[ends[i] : ends[i + 1]]
            upto = np.cumsum(size[lists])
            lo = 0
            while lo < len(lists):  # lists of CHUNK products together, or one longer list
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHUNK, side="right")))
                n, first = size[lists[lo:hi]], begin[lists[lo:hi]]
                entry = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
                score += np.bincount(its_row[entry], np.repeat(unit[ends[i] + lo : ends[i] + hi], n) * its_unit[entry], minlength=len(score))
                lo = hi
            near = np.flatnonzero(score >= threshold - 10.0**-DIGITS)
            found.append((np.full(len(near), i), near, score[near]))
        i, j, score = map(np.concatenate, zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"left": left["left"].take(pa.array(i)), "right": right["right"].take(pa.array(j)), "cosine": score})

    return run


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(left, right, cosine): all pairs of weighted vectors whose cosine reaches the threshold.

    Both sides are (id, word, df, weight) with df the same for a word on both; weights may have any sign. Words that only one side
    has add nothing to a product and stay behind; the others are numbered. Each block of left vectors meets each
    block of right ones in a task of its own, where the products are added up word by word (``_near``): what is shuffled is vectors, each as
    often as the other side has blocks, and what is written is pairs at the threshold, however many share a word. Where that would be more than
    ``COPIES`` times all vectors, the left blocks come in waves, and a wave's pairs are stored and its shuffle is removed before the next,
    so the disk grows with the vectors and not with their square. The compute grows
    with the words that pairs share; groups of alike vectors are best made one class first.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0")
    sides = {name: _vectors(df, threshold, name)[0] for name, df in (("left", left), ("right", right))}
    common = sides["left"].select("word").distinct().join(sides["right"].select("word").distinct(), "word", "left_semi")
    common = stored(common.withColumn("at", F.monotonically_increasing_id()))
    vectors, parts, sizes = {}, {}, {}
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for name, rows in sides.items():
        entry = F.struct("at", "unit", F.col(f"{name}_rest").alias("rest"))
        held = join_words(rows, common, "word").groupBy(name).agg(F.collect_list(entry).alias("v"))
        vectors[name] = stored(held.select(name, "v.at", "v.unit", "v.rest"))
        n = sizes[name] = vectors[name].count()
        parts[name] = max(1, -(-n // min(block_rows, max(LEAST_BLOCK, -(-n // tasks)))) if name == "right" else -(-n // block_rows))
    dealt = lambda name: F.pmod(F.xxhash64(name), F.lit(parts[name])).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(parts[name] - 1)))
    kinds = ", ".join(f"{name} {vectors[name].schema[name].dataType.simpleString()}" for name in vectors)

    def met(lo: int, hi: int) -> DataFrame:
        """The pairs of the left blocks from ``lo`` to before ``hi``."""
        some = F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
        a = vectors["left"].withColumn("i", dealt("left")).filter(F.col("i").between(lo, hi - 1)).withColumn("j", every("right"))
        b = vectors["right"].withColumns({"i": some, "j": dealt("right")})
        near = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_near(threshold), f"{kinds}, cosine double")
        return near.withColumn("cosine", F.round("cosine", DIGITS)).filter(F.col("cosine") >= threshold)

    copied = sizes["right"] + -(-sizes["left"] // parts["left"]) * parts["right"]  # rows that one left block lets be shuffled
    wave = max(1, COPIES * sum(sizes.values()) // max(copied, 1))
    if wave >= parts["left"]:
        return met(0, parts["left"])
    return reduce(DataFrame.unionByName, [stored_alone(met(lo, min(lo + wave, parts["left"]))) for lo in range(0, parts["left"], wave)])


def similar_articles(
    articles: DataFrame, terms: Column, threshold: float, key: str = "doc_id", label: str = "label", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs of an unreliable and a credible article (label 0 and 1) of similar wording, by tf-idf cosine.

    Articles of one label and the same bag of words are one class: (unreliable_id, credible_id) are the smallest keys of two
    classes, unreliable_articles and credible_articles their sizes. ``class_members`` names the articles of a class.
    """
    classes = stored(article_classes(articles, terms, key, label))
    weights = stored(inverse_frequency_weights(classes, label))
    sides = [weights.filter(F.col(label) == c).drop(label) for c in (0.0, 1.0)]
    pairs = similar_pairs(*sides, threshold, block_rows)
    sizes = [
        classes.filter(F.col(label) == c).select(F.col("id").alias(f"{name}_id"), F.col("articles").alias(f"{name}_articles"))
        for c, name in ((0.0, "unreliable"), (1.0, "credible"))
    ]
    named = pairs.withColumnsRenamed({"left": "unreliable_id", "right": "credible_id"})
    out = named.join(sizes[0], "unreliable_id").join(sizes[1], "credible_id")
    return out.select("unreliable_id", "credible_id", "unreliable_articles", "credible_articles", "cosine")

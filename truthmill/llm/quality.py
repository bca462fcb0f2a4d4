"""Quality rules: fixed limits and robust multivariate outliers for each language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from truthmill.functions.arrays import let
from truthmill.operators.shared import stored

LEAST_WORDS = 10
#: Percent of words in repeated windows beyond which a text fails.
MOST_REPEATED = 20
WINDOW = 5
#: Statistics of a text, whole numbers so that their sums are exact whatever the order of rows.
FEATURES = ("symbols", "capitals", "repeats", "letters")
#: Least standard deviation of each statistic: many groups have texts without any symbol or repeat.
FLOORS = (25.0, 40.0, 60.0, 15.0)
SUPPORT = 0.75
STEPS = 3
#: The support that withstands most junk, with the factor that makes its covariance that of normal statistics.
HALF = 0.5
HALF_FACTOR = 2.110
#: Reweighting: the 97.5 % point of the squared distance of four normal statistics, and the factor for the rows within.
WITHIN = 11.143
WITHIN_FACTOR = 1.0644
#: Groups with fewer texts are judged with the other small groups of their language.
LEAST_ROWS = 100
#: Median of the squared distance of four normal statistics, and the squared distance that rejects.
MEDIAN_DISTANCE = 3.357
CUTOFF = 60.0

_BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def _repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that stand twice or more, from the hash of each window."""

    def places(s: Column) -> Column:
        same = lambda j, k: F.get(s, k)["h"].eqNullSafe(F.get(s, j)["h"])
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, j - 1) | same(j, j + 1))
        return F.array_sort(F.transform(twice, lambda j: F.get(s, j)["at"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    some = let(let(ordered, places), covered)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), some).otherwise(0)


def statistics(docs: DataFrame, *kept: Column, text: str = "text") -> DataFrame:
    """The kept columns with counts of each text: words, characters, symbols, capitals, repeated lines and words."""
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    bare = F.btrim("_text", F.lit(BLANKS))
    rows = rows.withColumn("_words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BLANK)))
    rows = rows.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    grams = F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)])
    )
    rows = rows.withColumn("_grams", F.when(F.size("_words") >= WINDOW, grams).otherwise(F.array().cast("array<long>")))
    names = [c for c in rows.columns if c not in ("_text", "_words", "_lines", "_grams")]
    count = lambda pattern: F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))
    return rows.select(
        *names,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        count("[A-ZÀ-ÖØ-Þ!]+").cast("long").alias("n_capitals"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_words"), F.col("_grams")).cast("long").alias("n_repeat_words"),
    )


# The formulas below are SQL text that Spark and the checking SQL read alike.
#: Shares by square root, which evens their spread; all are drawn towards the usual text of 50 words.
FEATURE_SQL = {
    "symbols": "CAST(round(1000 * sqrt(n_symbols / (word_chars + 250))) AS BIGINT)",
    "capitals": "CAST(round(1000 * sqrt((n_capitals + 10) / (word_chars + 250))) AS BIGINT)",
    "repeats": "CAST(round(1000 * sqrt(n_repeat_words / (n_words + 50))) AS BIGINT)",
    "letters": "CAST(round(250 * ln((word_chars + 250) / (n_words + 50))) AS BIGINT)",
}
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]


def level_sql(distance: str) -> str:
    """Squared distances in fine steps, so that a share of the rows can be cut off exactly."""
    return f"CAST(floor(64 * ln(1 + ({distance}))) AS BIGINT)"


def scale_sql(mid: str) -> str:
    """What squared distances are divided by, from their median level: never enlarged."""
    return f"greatest(1.0D, (exp(({mid} + 1) / 64) - 1) / {MEDIAN_DISTANCE})"


def first_distance_sql() -> str:
    parts = [f"pow(({f} - mid_{f}) / greatest(1.4826 * mad_{f}, {floor}), 2)" for f, floor in zip(FEATURES, FLOORS)]
    return " + ".join(parts)


def sums_sql() -> dict[str, str]:
    sums = {"m": "count(*)"} | {f"s_{f}": f"sum({f})" for f in FEATURES}
    return sums | {f"s_{i}_{j}": f"sum({FEATURES[i]} * {FEATURES[j]})" for i, j in _PAIRS}


def factor_sql(scale: float | None = None) -> list[dict[str, str]]:
    """Columns, step by step, from sums to the Cholesky factor of the covariance, times ``scale``, with its floors."""
    times = "" if scale is None else f"{scale} * "
    part = lambda sql: sql if scale is None else f"({sql})"
    means = {f"mean_{i}": f"CAST(s_{f} AS DOUBLE) / m" for i, f in enumerate(FEATURES)}
    spread = {
        f"c_{i}_{j}": times + part(f"CAST(s_{i}_{j} AS DOUBLE) / m - mean_{i} * mean_{j}") + (f" + {FLOORS[i] ** 2}" if i == j else "") for i, j in _PAIRS
    }
    steps = [means, spread]
    for i in range(len(FEATURES)):
        for j in range(i + 1):
            less = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            steps.append({f"l_{i}_{j}": f"sqrt(c_{i}_{i}{less})" if i == j else f"(c_{i}_{j}{less}) / l_{j}_{j}"})
    return steps


def distance_sql() -> list[dict[str, str]]:
    """Columns, step by step, to the squared Mahalanobis distance ``d2``."""
    steps = []
    for i, f in enumerate(FEATURES):
        less = "".join(f" - l_{i}_{k} * z_{k}" for k in range(i))
        steps.append({f"z_{i}": f"(({f} - mean_{i}){less}) / l_{i}_{i}"})
    return [*steps, {"d2": " + ".join(f"z_{i} * z_{i}" for i in range(len(FEATURES)))}]


def _added(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    for step in steps:
        df = df.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return df


def quality_rules(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_rows: int = LEAST_ROWS
) -> DataFrame:
    """Counts of each text and whether it is kept.

    A text fails outright with fewer than ten words, or with more than a fifth of its words in
    repeated windows. The others are judged by minimum covariance determinant: for
    each language and source, starting from distances to the medians, the three quarters of
    the texts that lie closest to the centre give a new mean and covariance, and so on for
    three concentration steps; a text is rejected if its squared Mahalanobis distance, scaled
    so that the median is that of normal statistics (never enlarged), passes the cutoff. The covariance has a floor on its
    diagonal, so statistics that are constant in a group have room.

    Three quarters of a group cannot be clean if more than a quarter is junk. So the estimate is
    also made on half of the texts, with its consistency factor, and once more on the texts
    within the 97.5 % point of it. Where this rejects more than a quarter of a group, its distances judge the group.

    Statistics are whole numbers and distances are cut in fine steps, so group sums, medians and
    shares are exact and combine before the shuffle; no group meets in one task.
    Small groups of a language are judged together, and are only held to the fixed limits if
    even together they are few. A null language or source is a value of its own. A
    null text has no words. Repeated rows are judged alike; other columns are not read.

    Returns key, the counts, distance (null where not judged), base_failed and kept, one row per input row.
    """
    rows = stored(statistics(docs, F.col(key).alias("_key"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), text=text))
    failed = F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    rows = rows.withColumns({f: F.expr(sql) for f, sql in FEATURE_SQL.items()}).withColumn("base_failed", failed)
    group = ["_lang", "_source", "_small"]
    null_safe = lambda a, b: a["_lang"].eqNullSafe(b["_lang"]) & a["_source"].eqNullSafe(b["_source"]) & (a["_small"] == b["_small"])

    def with_group(table: DataFrame, values: DataFrame, how: str = "inner") -> DataFrame:
        return table.join(values, null_safe(table, values), how).drop(*[values[c] for c in group])

    sizes = rows.filter("NOT base_failed").groupBy("_lang", "_source").agg(F.count("*").alias("size"))
    sizes = stored(sizes.select(F.col("_lang").alias("_l"), F.col("_source").alias("_s"), (F.col("size") < least_rows).alias("_few")))
    rows = rows.join(sizes, F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left")
    small = F.coalesce("_few", F.lit(True))
    names = [c for c in rows.columns if c not in ("_l", "_s", "_few", "_source")]
    rows = stored(rows.select(*names, F.when(~small, F.col("_source")).alias("_source"), small.alias("_small")))
    judged = rows.filter("NOT base_failed")

    middle = lambda c: F.percentile(c, F.lit(0.5))
    centre = stored(judged.groupBy(*group).agg(F.count("*").alias("size"), *[middle(f).alias(f"mid_{f}") for f in FEATURES]))
    centre = centre.filter(F.col("size") >= least_rows)
    off = with_group(judged, centre)
    mads = stored(off.groupBy(*group).agg(*[middle(F.abs(F.col(f) - F.col(f"mid_{f}"))).alias(f"mad_{f}") for f in FEATURES]))
    scale = with_group(centre, mads)
    start = with_group(judged, stored(scale)).withColumn("level", F.expr(level_sql(first_distance_sql())))
    fields = [*[f"mean_{i}" for i in range(len(FEATURES))], *[f"l_{i}_{j}" for i, j in _PAIRS]]

    def factored(close: DataFrame, times: float | None = None) -> DataFrame:
        sums = close.groupBy(*group).agg(*[F.expr(sql).alias(name) for name, sql in sums_sql().items()])
        return stored(_added(sums, factor_sql(times)).select(*group, *fields))

    def measured(factor: DataFrame) -> DataFrame:
        return _added(with_group(judged, factor), distance_sql()).withColumn("level", F.expr(level_sql("d2")))

    def concentrated(support: float, times: float | None = None) -> DataFrame:
        scored = start
        for _ in range(STEPS + 1):
            cut = stored(scored.groupBy(*group).agg(F.percentile("level", F.lit(support)).alias("cut")))
            factor = factored(with_group(scored.select(*group, "level", *FEATURES), cut).filter("level <= cut"), times)
            scored = measured(factor)
        return factor

    median = F.percentile("level", F.lit(0.5)).alias("mid")
    factor = concentrated(SUPPORT)
    medians = with_group(factor, measured(factor).groupBy(*group).agg(median))
    half = factored(measured(concentrated(HALF, HALF_FACTOR)).filter(F.col("d2") <= WITHIN), WITHIN_FACTOR)
    scored = measured(half)
    half = stored(with_group(half, scored.filter(F.col("d2") <= WITHIN).groupBy(*group).agg(median)))
    beyond = with_group(scored.select(*group, "d2"), half.select(*group, F.expr(scale_sql("mid")).alias("scale")))
    junk = beyond.groupBy(*group).agg(F.avg((F.col("d2") / F.col("scale") > CUTOFF).cast("int")).alias("junk"))
    junk = stored(junk.filter(F.col("junk") > 1 - SUPPORT).select(*group))
    clean = medians.join(junk, null_safe(medians, junk), "left_anti")
    medians = stored(clean.unionByName(with_group(half, junk)))
    scored = _added(with_group(rows, medians, "left"), distance_sql())
    distance = F.when(~F.col("base_failed"), F.col("d2") / F.expr(scale_sql("mid")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    scored = scored.withColumn("distance", distance)
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return scored.select(F.col("_key").alias(key), *counts, "distance", "base_failed", kept.alias("kept"))

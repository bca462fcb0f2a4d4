"""Evaluation of scored rows: confusion counts, rates, F-measures, threshold curves, report.

Rows carry ``label`` and ``prediction`` (class) or ``score`` (probability). As in the
confusion layout used here, class 0 is the positive one for the overall rates:
tp = (0,0), fp = (1,0), fn = (0,1), tn = (1,1) with rows actual and columns predicted.
The curves take class 1 as positive. A ratio over nothing is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from truthmill.operators.shared import running_sums
from truthmill.sources.writers import write_counted

CLASSES = (0.0, 1.0)


def confusion_counts(scored: DataFrame, *keys: str) -> DataFrame:
    """One row (per key) with the four cells; the pass all other counts derive from."""
    label, prediction = F.col("label"), F.col("prediction")

    def cell(actual: float, predicted: float) -> Column:
        return F.count_if((label == actual) & (prediction == predicted))

    return scored.groupBy(*keys).agg(
        cell(0.0, 0.0).alias("tp"),
        cell(1.0, 0.0).alias("fp"),
        cell(0.0, 1.0).alias("fn"),
        cell(1.0, 1.0).alias("tn"),
    )


def write_scored(scored: DataFrame, path: str) -> dict[str, int]:
    """Write scored rows and return ``confusion_counts``' cells and the rows given to class 0, counted while they are written."""
    label, prediction = F.col("label"), F.col("prediction")
    cells = {name: (label == a) & (prediction == p) for name, a, p in (("tp", 0.0, 0.0), ("fp", 1.0, 0.0), ("fn", 0.0, 1.0), ("tn", 1.0, 1.0))}
    return write_counted(scored, path, predicted_0=prediction == 0.0, predicted_0_correct=cells["tp"], **cells)


def confusion_matrix(scored: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, prediction, n): always the four cells, empty ones as 0."""
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("label"), F.lit(p).alias("prediction"), F.col(c).alias("n"))
            for c, a, p in (("tp", 0.0, 0.0), ("fn", 0.0, 1.0), ("fp", 1.0, 0.0), ("tn", 1.0, 1.0))
        ]
    )
    return confusion_counts(scored, *keys).select(*keys, F.inline(cells))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def f_measure(precision: Column, recall: Column, beta: float) -> Column:
    b2 = float(beta) ** 2
    return F.try_divide((1.0 + b2) * precision * recall, b2 * precision + recall)


def _label_columns() -> dict[float, dict[str, Column]]:
    """Metrics of each label over the columns of ``confusion_counts``."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def metrics(hit: Column, false_hit: Column, miss: Column, other: Column) -> dict[str, Column]:
        precision, recall = _ratio(hit, hit + false_hit), _ratio(hit, hit + miss)
        return {
            "examples": hit + miss,
            "fpr": _ratio(false_hit, false_hit + other),
            "tpr": recall,
            "recall": recall,
            "precision": precision,
            "f1": f_measure(precision, recall, 1.0),
        }

    return {0.0: metrics(tp, fp, fn, tn), 1.0: metrics(tn, fn, fp, tp)}


def _overall_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    accuracy = _ratio(tp + tn, tp + fp + fn + tn)
    return {
        "tp": tp,
        "fp": fp,
        "fn": fn,
        "tn": tn,
        "precision": precision,
        "recall": recall,
        "accuracy": accuracy,
        "test_error": 1.0 - accuracy,
        "f1": f_measure(precision, recall, 1.0),
        "f2": f_measure(precision, recall, 2.0),
    }


def per_label_metrics(counts: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, examples, fpr, tpr, recall, precision, f1) from the four cells."""
    rows = [
        F.struct(F.lit(label).alias("label"), *[c.alias(n) for n, c in columns.items()])
        for label, columns in _label_columns().items()
    ]
    return counts.select(*keys, F.inline(F.array(*rows)))


def binary_metrics(counts: DataFrame, *keys: str) -> DataFrame:
    """Overall rates, both F-measures and the two class-0 counters from the four cells."""
    return counts.select(
        *keys,
        *[c.alias(n) for n, c in _overall_columns().items()],
        (F.col("tp") + F.col("fp")).alias("predicted_0"),
        F.col("tp").alias("predicted_0_correct"),
    )


def evaluation_report(scored: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Long report (dataset, metric, label, value) of every set, in one pass over the rows."""

    def cell(metric: str, label: float | None, value: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.lit(label).cast("double").alias("label"),
            value.cast("double").alias("value"),
        )

    cells = [cell(n, label, c) for label, cols in _label_columns().items() for n, c in cols.items()]
    cells += [cell(n, None, c) for n, c in _overall_columns().items()]
    return confusion_counts(scored, dataset).select(dataset, F.inline(F.array(*cells)))


def score_curve(scored: DataFrame) -> DataFrame:
    """(score, pos, neg, tp, fp, p, n): counts at and above every distinct score.

    Rows are first summed by score, so a score that many rows share is one row. The
    running sums go by ranges of scores, each range adding the totals before it.
    """
    by_score = scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1.0).alias("pos"),
        F.count_if(F.col("label") != 1.0).alias("neg"),
    )
    curve = running_sums(by_score, F.desc("score"), tp="pos", fp="neg")
    return curve.withColumnsRenamed({"tp_total": "p", "fp_total": "n"})


def _curve_precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(_ratio(tp, tp + fp), F.lit(1.0))


def _curve_rate(hits: Column, all_: Column) -> Column:
    return F.coalesce(_ratio(hits, all_), F.lit(0.0))


def threshold_metrics(curve: DataFrame) -> DataFrame:
    precision = _curve_precision(F.col("tp"), F.col("fp"))
    recall = _curve_rate(F.col("tp"), F.col("p"))
    rates = curve.select(F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumns(
        {
            "f1": F.coalesce(f_measure(p, r, 1.0), F.lit(0.0)),
            "f2": F.coalesce(f_measure(p, r, 2.0), F.lit(0.0)),
        }
    )


def roc_curve(curve: DataFrame) -> DataFrame:
    """(fpr, tpr) by falling score, with the end points (0,0) and (1,1)."""
    points = curve.select(
        _curve_rate(F.col("fp"), F.col("n")).alias("fpr"), _curve_rate(F.col("tp"), F.col("p")).alias("tpr")
    )
    ends = curve.sparkSession.range(2).select(
        F.col("id").cast("double").alias("fpr"), F.col("id").cast("double").alias("tpr")
    )
    return points.unionByName(ends)


def pr_curve(curve: DataFrame) -> DataFrame:
    """(recall, precision) by falling score, opening at recall 0 with the first precision."""
    points = curve.select(
        _curve_rate(F.col("tp"), F.col("p")).alias("recall"),
        _curve_precision(F.col("tp"), F.col("fp")).alias("precision"),
    )
    start = curve.agg(
        F.max_by(_curve_precision(F.col("tp"), F.col("fp")), "score").alias("precision")
    ).select(F.lit(0.0).alias("recall"), "precision")
    return points.unionByName(start)


def curve_areas(curve: DataFrame) -> DataFrame:
    """Areas under both curves by trapezoids.

    The point before a score is its own running sum less its own counts, so no row
    needs its neighbour and the areas are plain sums.
    """
    pos, neg, tp, fp, p, n = (F.col(c) for c in ("pos", "neg", "tp", "fp", "p", "n"))
    now = _curve_precision(tp, fp)
    before = F.coalesce(_ratio(tp - pos, tp - pos + fp - neg), now)
    return curve.agg(
        F.sum(_curve_rate(neg, n) * _curve_rate(2 * tp - pos, 2 * p)).alias("area_under_roc"),
        F.sum(_curve_rate(pos, p) * (before + now) / 2.0).alias("area_under_pr"),
    )

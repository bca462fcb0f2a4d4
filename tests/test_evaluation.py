import pytest
from pyspark.mllib.evaluation import BinaryClassificationMetrics
from pyspark.sql import functions as F

from truthmill.operators import evaluation as ev

ROWS = [(0.9, 1.0), (0.9, 0.0), (0.8, 1.0), (0.4, 1.0), (0.4, 0.0), (0.4, 0.0), (0.1, 0.0), (0.0, 1.0)]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame(ROWS, "score double, label double")
    return df.withColumn("prediction", F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)).withColumn("dataset", F.lit("d"))


def test_confusion_cells_sum_to_all_rows(scored):
    cells = {(r.label, r.prediction): r.n for r in ev.confusion_matrix(scored).collect()}
    assert cells == {(0.0, 0.0): 3, (0.0, 1.0): 1, (1.0, 0.0): 2, (1.0, 1.0): 2}


def test_empty_cells_and_zero_denominators(scored):
    ones = scored.filter("label = 1 and prediction = 1")
    assert sorted(r.n for r in ev.confusion_matrix(ones).collect()) == [0, 0, 0, 2]
    row = ev.binary_metrics(ev.confusion_counts(ones)).first()
    assert (row.accuracy, row.precision, row.recall, row.f1) == (1.0, None, None, None)


def test_binary_metrics(scored):
    row = ev.binary_metrics(ev.confusion_counts(scored)).first()
    p, r = 3 / 5, 3 / 4
    assert (row.precision, row.recall, row.accuracy) == (p, r, 5 / 8)
    assert row.f1 == pytest.approx(2 * p * r / (p + r)) and row.f2 == pytest.approx(5 * p * r / (4 * p + r))
    assert (row.predicted_0, row.predicted_0_correct) == (5, 3)


def test_areas_match_the_library(spark, scored):
    curve = ev.score_curve(scored)
    row = ev.curve_areas(curve).first()
    library = BinaryClassificationMetrics(spark.sparkContext.parallelize(ROWS, 1))
    assert row.area_under_roc == pytest.approx(library.areaUnderROC)
    assert row.area_under_pr == pytest.approx(library.areaUnderPR)


def test_curves(scored):
    curve = ev.score_curve(scored)
    roc = sorted((r.fpr, r.tpr) for r in ev.roc_curve(curve).collect())
    assert roc[0] == (0.0, 0.0) and roc[-1] == (1.0, 1.0) and len(roc) == 7
    assert all(a[1] <= b[1] for a, b in zip(roc, roc[1:]))
    pr = ev.pr_curve(curve).collect()
    assert (0.0, 0.5) in [(r.recall, r.precision) for r in pr] and len(pr) == 6
    thresholds = {r.threshold: r for r in ev.threshold_metrics(curve).collect()}
    assert thresholds[0.4].recall == 3 / 4 and thresholds[0.4].precision == 3 / 6


def test_single_class_curve(scored):
    curve = ev.score_curve(scored.filter("label = 0"))
    assert all(r.tpr in (0.0, 1.0) for r in ev.roc_curve(curve).collect())
    assert ev.curve_areas(curve).first().area_under_pr == 0.0


def test_report_has_every_metric(scored):
    report = ev.evaluation_report(scored).collect()
    assert len(report) == 2 * 6 + 10 and {r.dataset for r in report} == {"d"}

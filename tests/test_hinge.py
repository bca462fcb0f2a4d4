import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from truthmill.operators import hinge


def plain_fit(rows, size, steps, reg=0.1, tolerance=0.001):
    """The fit written out over a dense table."""
    x = np.array([np.pad(v.toArray(), (0, size - v.size)) if v is not None else np.zeros(size) for _, v in rows])
    side = np.array([2 * label - 1 for label, _ in rows])
    w = np.zeros(size)
    for i in range(1, steps + 1):
        step = 1 / i**0.5
        active = side * (x @ w) < 1
        new = w + step * (side[active, None] * x[active]).sum(axis=0) / len(rows)
        new = np.sign(new) * np.maximum(abs(new) - reg * step, 0)
        moved, w = np.linalg.norm(new - w), new
        if moved < tolerance * max(np.linalg.norm(w), 1):
            return w, i
    return w, steps


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        label = float(i % 2)
        values = {int(j): float(v) for j, v in zip(rng.choice(40, 6, replace=False), rng.random(6))}
        values[0 if label else 1] = 2.0 + rng.random()
        rows.append((label, Vectors.sparse(40, values) if i % 3 else Vectors.dense(Vectors.sparse(40, values).toArray())))
    return rows


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], ["doc_id", "label", "features"]).repartition(5)


def test_gradient_adds_up_over_tasks(frame, data):
    w = np.linspace(-0.3, 0.3, 40)
    expected = np.zeros(40)
    for label, v in data:
        side = 2 * label - 1
        if side * v.toArray() @ w < 1:
            expected -= side * v.toArray()
    assert hinge.gradient(hinge.sparse_rows(frame), w) == pytest.approx(expected)


@pytest.mark.parametrize("steps", [1, 25, 100])
def test_fit_equals_the_plain_version(frame, data, steps):
    model = hinge.fit_hinge_l1(frame, 40, steps=steps, reg=0.05)
    weights, taken = plain_fit(data, 40, steps, reg=0.05)
    assert model.weights == pytest.approx(weights) and model.steps == taken
    assert 0 < np.count_nonzero(model.weights) < 40  # the penalty leaves weights at 0


def test_fit_equals_the_older_library(spark, frame, data):
    from pyspark.mllib.classification import SVMWithSGD
    from pyspark.mllib.linalg import Vectors as Old
    from pyspark.mllib.regression import LabeledPoint

    points = spark.sparkContext.parallelize([LabeledPoint(label, Old.dense(v.toArray())) for label, v in data], 3)
    theirs = SVMWithSGD.train(points, iterations=100, regParam=0.1, regType="l1")
    model = hinge.fit_hinge_l1(frame, 40)
    assert model.weights == pytest.approx(theirs.weights.toArray())
    scored = {r.doc_id: r.prediction for r in model.score(frame, "doc_id").collect()}
    assert [scored[i] for i in range(300)] == [float(theirs.predict(Old.dense(v.toArray()))) for _, v in data]
    assert sum(scored[i] == label for i, (label, _) in enumerate(data)) > 290


def test_odd_rows(spark, frame, data):
    odd = spark.createDataFrame([(900, None, Vectors.dense([1.0])), (901, 1.0, None), (902, 0.0, Vectors.sparse(0, {}))], frame.schema)
    model = hinge.fit_hinge_l1(frame.unionByName(odd), 40, steps=3, reg=0.05)
    rows = [*data, (1.0, None), (0.0, Vectors.sparse(0, {}))]
    assert model.weights == pytest.approx(plain_fit(rows, 40, 3, reg=0.05)[0])
    out = {r.doc_id: (r.label, r.score) for r in model.score(odd, "doc_id").collect()}
    assert out[900][0] is None and out[901] == (1.0, 0.0) and out[902] == (0.0, 0.0)
    none = hinge.fit_hinge_l1(frame.limit(0), 4)
    assert none.steps == 0 and none.weights.tolist() == [0, 0, 0, 0]


def test_soft_threshold():
    assert hinge.soft_threshold(np.array([0.3, -0.3, 0.05, -0.05, 0.0]), 0.1) == pytest.approx([0.2, -0.2, 0, 0, 0])


def test_rows_are_stored_as_their_entries(frame):
    row = hinge.sparse_rows(frame, "doc_id").filter("doc_id = 0").first()
    assert len(row["indices"]) == len(row["values"]) == 40
    assert hinge.sparse_rows(frame).select(F.max(F.size("indices"))).first()[0] == 40


@pytest.mark.parametrize("entries, slab", [(1, 7), (50, 16), (1 << 20, 1 << 16)])
def test_steps_read_blocks_and_add_slabs(frame, data, entries, slab, monkeypatch):
    """Rows are packed once into blocks of entries; a task lets out a row for each slab of weights, not for each weight."""
    monkeypatch.setattr(hinge, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(hinge, "SLAB", slab)
    blocks = hinge.packed(hinge.sparse_rows(frame))
    sides = sum(len(r.side) for r in blocks.collect()) // 8
    assert sides == 300 and (blocks.count() == 300 if entries == 1 else blocks.count() < 150)
    out = blocks.mapInArrow(hinge._partial_sums(np.zeros(40)), "slab long, pull binary").collect()
    assert len(out) <= 5 * -(-40 // slab)
    model = hinge.fit_hinge_l1(frame, 40, steps=4, reg=0.05)
    assert model.weights == pytest.approx(plain_fit(data, 40, 4, reg=0.05)[0])

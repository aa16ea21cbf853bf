"""Learners work in a session in which a result was observed."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from strandline.operators import ml_detectors

COUNTS = [(s, k, c) for s in range(60) for k, c in (("line", 1 + s % 3), ("odd", s % 2)) if c]


@pytest.fixture
def counted(spark):
    """Cells and labels, after a result of the session was observed."""
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 5
    cells = spark.createDataFrame(COUNTS, "seq_id long, key string, value long")
    return cells, cells.groupBy("seq_id").agg(F.max((F.col("key") == "odd").cast("int")).alias("label"))


def test_linear_svm_after_observation(counted):
    cells, labels = counted
    scored = ml_detectors.Classifier(ml_detectors.linear_svm(60), cells, labels).predict(cells)
    assert {r.seq_id: r.pred for r in scored.collect()} == {s: s % 2 for s in range(60)}


def test_logistic_regression_after_observation(counted):
    cells, labels = counted
    scored = ml_detectors.Classifier(ml_detectors.logistic_regression(60), cells, labels).predict(cells).collect()
    assert {r.seq_id: r.pred for r in scored} == {s: s % 2 for s in range(60)}
    assert all((r.probability > 0.5) == bool(r.pred) for r in scored)


def test_low_probability_after_observation(counted):
    cells, labels = counted
    model = ml_detectors.Classifier(ml_detectors.logistic_regression(60), cells, labels)
    scored = ml_detectors.low_probability(model.predict(cells)).collect()
    assert {r.seq_id: r.pred for r in scored} == {s: s % 2 for s in range(60)}
    assert all((1 - r.probability < 0.2) == bool(r.pred) for r in scored)

"""Feature vectors are made once and without Python."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from strandline.operators import ml_detectors
from strandline.operators.vector_detectors import CountMatrix

COUNTS = [(s, k, c) for s in range(60) for k, c in (("line", 1 + s % 3), ("odd", s % 2), ("far", 90 * (s == 59))) if c]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_vectors_without_python(spark):
    cells = spark.createDataFrame([*COUNTS, (60, "new", 5), (61, "line", None)], "seq_id long, key string, value long")
    matrix = CountMatrix(cells.where("key <> 'new'"))
    made = ml_detectors.feature_vectors(matrix, cells)
    assert "Python" not in plan_of(made) and "Aggregate" not in plan_of(made)
    got = {r.seq_id: r.x for r in made.select("seq_id", vector_to_array("features").alias("x")).collect()}
    names = ["far", "line", "odd"]
    for s in range(60):
        mine = {k: float(c) for t, k, c in COUNTS if t == s}
        assert got[s] == [mine.get(n, 0.0) for n in names]
    assert got[60] == [0.0, 0.0, 0.0] and np.isnan(got[61][1])


def test_classifier_learns_from_written_vectors(spark):
    cells = spark.createDataFrame(COUNTS, "seq_id long, key string, value long")
    labels = cells.groupBy("seq_id").agg(F.max((F.col("key") == "odd").cast("int")).alias("label"))
    model = ml_detectors.Classifier(ml_detectors.logistic_regression(60), cells, labels)
    assert {r.seq_id: r.pred for r in model.predict(cells).collect()} == {s: s % 2 for s in range(60)}

"""Forest scores: kept for the rows of the fit, equal rows of a batch walked once."""

import numpy as np
from pyspark.sql import functions as F

from strandline.operators import ml_detectors

COUNTS = [(s, k, c) for s in range(60) for k, c in (("line", 1 + s % 3), ("odd", s % 2), ("far", 90 * (s == 59))) if c]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forest_scores_of_equal_rows(spark):
    cells = spark.createDataFrame([*COUNTS, (60, "new", 5)], "seq_id long, key string, value long").withColumn("value", F.col("value").cast("double"))
    forest = ml_detectors.IsolationForest(cells, trees=20, contamination=0.02)
    kept = forest.predict(cells)
    assert "Pandas" not in plan_of(kept)
    again = forest.predict(cells.select("*"))
    assert {r.seq_id: r.score for r in kept.collect()} == {r.seq_id: r.score for r in again.collect()}
    scores = {r.seq_id: r.score for r in kept.collect()}
    for r in forest.matrix.rows(cells).collect():  # one row at a time, as a plain loop would
        x = np.zeros((1, forest.matrix.size))
        x[0, r.idx] = r.val
        depth = np.mean([ml_detectors._depths(x, t) for t in forest.trees], axis=0)[0]
        alone = 2.0 ** (-depth / ml_detectors._path(forest.sample))
        assert abs(alone - scores[r.seq_id]) < 1e-12
    assert scores[59] > scores[58]

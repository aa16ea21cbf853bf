"""Detectors from Spark ML on sparse count vectors, and a distributed isolation forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from strandline.operators.evaluate import exact_quantile
from strandline.operators.vector_detectors import CountMatrix, _dense
from strandline.session import written


def feature_vectors(matrix: CountMatrix, cells: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``seq_id, features`` (``label``): Spark ML sparse vectors of count rows, written once, so that no pass over them counts again."""
    rows = matrix.rows(cells)
    if labels is not None:
        rows = rows.join(labels.select("seq_id", F.col("label").cast("double")), "seq_id")
    # A sparse vector is stored as this structure, so the table is read back as vectors and no row goes through Python.
    stored = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(matrix.size).alias("size"), F.col("idx").alias("indices"),
        F.transform("val", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("values"),
    )
    made = rows.select("seq_id", stored.alias("features"), *rows.columns[3:])
    return written(made, StructType([StructField(f.name, VectorUDT() if f.name == "features" else f.dataType) for f in made.schema]))


def _without_summary(model):
    """``model`` without the summary of its training, which goes to the tasks with the model and holds the session.

    A session in which any result was observed cannot be sent.
    """
    if getattr(model, "hasSummary", False):
        model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


class Classifier:
    """A supervised Spark ML classifier on event counts; ``labels`` is ``seq_id, label``."""

    def __init__(self, estimator, cells: DataFrame, labels: DataFrame):
        self.matrix = CountMatrix(cells)
        self.model = _without_summary(estimator.fit(feature_vectors(self.matrix, cells, labels)))

    def predict(self, cells: DataFrame) -> DataFrame:
        scored = self.model.transform(feature_vectors(self.matrix, cells))
        keep = ["seq_id", F.col("prediction").cast("long").alias("pred")]
        if "probability" in scored.columns:
            keep.append(vector_to_array("probability").getItem(1).alias("probability"))
        return scored.select(*keep)


def logistic_regression(n: int, c: float = 100.0, tol: float = 0.01) -> LogisticRegression:
    """L2-regularised logistic regression; ``c`` is the inverse strength over the summed loss of ``n`` rows."""
    return LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, tol=tol, maxIter=100)


def decision_tree(depth: int = 30) -> DecisionTreeClassifier:
    """A tree of Gini splits; 30 is the largest depth Spark grows."""
    return DecisionTreeClassifier(impurity="gini", maxDepth=depth, seed=7)


def linear_svm(n: int, c: float = 1.0, tol: float = 0.1) -> LinearSVC:
    """Linear support vector machine. Spark offers the L2 penalty with the hinge loss."""
    return LinearSVC(regParam=1.0 / (c * n), tol=tol, maxIter=100)


def low_probability(scored: DataFrame, limit: float = 0.2) -> DataFrame:
    """Supervised decision on the probability of the normal class: below ``limit`` is an anomaly."""
    return scored.withColumn("pred", (1 - F.col("probability") < limit).cast("long"))


class IsolationForest:
    """Isolation forest: every tree is grown in its own task from a bounded seeded sample of the rows.

    Rows enter a tree's sample by hash: first a threshold on the hash keeps a few times the sample size, then the
    smallest hashes are taken, so the full table is filtered in place and only samples are shuffled. The trees are small
    tables (at most ``2 * sample`` nodes each) and are sent to all tasks for scoring.
    """

    def __init__(
        self, cells: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.03, seed: int = 7
    ):
        self.matrix = CountMatrix(cells)
        rows = written(self.matrix.rows(cells))
        self.n = rows.count()
        self.sample = min(sample, self.n)
        keep = min(1.0, 4.0 * self.sample / max(self.n, 1))
        limit = F.lit(min(int(-(1 << 63) + keep * ((1 << 64) - 1)), (1 << 63) - 1))
        # A row is multiplied only by the trees whose hash threshold it passes.
        hits = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(F.lit(seed), t, "seq_id") <= limit)
        drawn = rows.withColumn("tree", F.explode(hits)).withColumn("_h", F.xxhash64(F.lit(seed), "tree", "seq_id"))
        smallest = Window.partitionBy("tree").orderBy("_h", "seq_id")
        bags = drawn.withColumn("_r", F.row_number().over(smallest)).filter(F.col("_r") <= self.sample)
        size, depth = self.matrix.size, int(np.ceil(np.log2(max(self.sample, 2))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            _, x = next(_dense(pdf, size, len(pdf)))
            tree = int(pdf["tree"].iloc[0])
            return _grow(x, np.random.default_rng(seed * 100_003 + tree), depth).assign(tree=tree)

        grown = bags.select("tree", "_r", "idx", "val").groupBy("tree").applyInPandas(
            grow, "tree int, node int, feature int, cut double, low int, high int, size int"
        )
        self.trees = [t.sort_values("node") for _, t in grown.toPandas().groupby("tree")]
        self.fitted = cells, written(self._scores(rows))
        self.limit = exact_quantile(self.fitted[1], "score", 1 - contamination).first()["quantile"]

    def _scores(self, rows: DataFrame) -> DataFrame:
        trees, size, sample = self.trees, self.matrix.size, self.sample
        norm = _path(sample) or 1.0  # samples of one row have no paths to compare

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                # Equal rows of a batch walk down once.
                held = np.empty(len(batch), dtype=object)
                held[:] = [i.tobytes() + v.tobytes() for i, v in zip(batch["idx"], batch["val"])]
                codes = pd.factorize(held)[0]
                first = np.unique(codes, return_index=True)[1]
                depth = [np.mean([_depths(x, t) for t in trees], axis=0) for _, x in _dense(batch.iloc[first], size)]
                scores = np.power(2.0, -np.concatenate(depth) / norm) if depth else np.zeros(0)
                yield pd.DataFrame({"seq_id": batch["seq_id"], "score": scores[codes]})

        kind = rows.schema["seq_id"].dataType.simpleString()
        return rows.select("seq_id", "idx", "val").mapInPandas(score, f"seq_id {kind}, score double")

    def predict(self, cells: DataFrame) -> DataFrame:
        scores = self.fitted[1] if cells is self.fitted[0] else self._scores(self.matrix.rows(cells))
        return scores.withColumn("pred", (F.col("score") > F.lit(self.limit)).cast("long"))


def _path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> pd.DataFrame:
    """Node table of one tree: random feature among those that vary, random cut between its extremes."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, "")]
    while stack:
        members, level, parent, side = stack.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][3 if side == "low" else 4] = here
        block = x[members]
        varying = np.flatnonzero(block.max(axis=0) > block.min(axis=0)) if len(members) else np.array([])
        if level >= depth or len(members) <= 1 or not len(varying):
            nodes.append([here, -1, 0.0, -1, -1, len(members)])
            continue
        feature = int(rng.choice(varying))
        cut = rng.uniform(block[:, feature].min(), block[:, feature].max())
        nodes.append([here, feature, cut, -1, -1, len(members)])
        below = block[:, feature] <= cut
        stack.append((members[below], level + 1, here, "low"))
        stack.append((members[~below], level + 1, here, "high"))
    return pd.DataFrame(nodes, columns=["node", "feature", "cut", "low", "high", "size"])


def _depths(x: np.ndarray, tree: pd.DataFrame) -> np.ndarray:
    """Path length of every row in one tree, all rows walking down together."""
    feature, cut = tree["feature"].to_numpy(), tree["cut"].to_numpy()
    low, high = tree["low"].to_numpy(), tree["high"].to_numpy()
    tail = np.array([_path(s) for s in tree["size"]])
    at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
    rows = np.arange(len(x))
    while True:
        inner = feature[at] >= 0
        if not inner.any():
            return depth + tail[at]
        moving = rows[inner]
        node = at[moving]
        at[moving] = np.where(x[moving, feature[node]] <= cut[node], low[node], high[node])
        depth[moving] += 1
